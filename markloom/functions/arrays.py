"""Array functions of plotting scripts as native expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


CUMSUM_BLOCK = 64


def arange(start: Column, stop: Column, step: Column) -> Column:
    """start, start + step, ... below stop, each by multiplication; empty if there is none."""
    n = F.ceil((stop - start) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * step)).otherwise(F.array().cast("array<double>"))


def linspace(start: Column, stop: Column, n: int) -> Column:
    if n <= 1:
        return F.array(start.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * ((stop - start) / (n - 1)))


def full(n: Column, value: Column) -> Column:
    return F.array_repeat(value, n.cast("int"))


def repeat_each(xs: Column, n: Column) -> Column:
    return F.flatten(F.transform(xs, lambda x: F.array_repeat(x, n.cast("int"))))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), F.size(xs))


def smallest(xs: Column) -> Column:
    """NaN if there is one, as NumPy has it; null for no values."""
    return F.when(F.exists(xs, F.isnan), F.lit(float("nan"))).otherwise(F.array_min(xs))


def largest(xs: Column) -> Column:
    """NaN if there is one (it is Spark's largest value); null for no values."""
    return F.array_max(xs)


def cumsum(xs: Column) -> Column:
    """Running sums, added one by one. They are built in blocks, so that an element is copied CUMSUM_BLOCK times at most."""
    none = F.expr("cast(array() as array<double>)")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / CUMSUM_BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(xs, b * CUMSUM_BLOCK + 1, F.lit(CUMSUM_BLOCK)))
    last = lambda done, before: F.coalesce(F.try_element_at(done, F.lit(-1)), before)

    def block(state: Column, own: Column) -> Column:
        sums = F.aggregate(own, none, lambda done, x: F.concat(done, F.array(x + last(done, state["last"]))))
        return F.get(F.transform(F.array(sums), lambda done: F.struct(last(done, state["last"]).alias("last"), F.concat(state["done"], F.array(done)).alias("done"))), F.lit(0))

    start = F.struct(F.lit(0.0).alias("last"), F.expr("cast(array() as array<array<double>>)").alias("done"))
    return F.flatten(F.aggregate(blocks, start, block, lambda state: state["done"]))


def diff(xs: Column) -> Column:
    n = F.size(xs)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(xs, i) - F.get(xs, i - 1))).otherwise(F.slice(xs, 1, 0))


def log(x: Column) -> Column:
    """NaN below zero and minus infinity at zero, not null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).otherwise(log(x))


#: Functions of one number, and of two; outside their domain they give NaN.
MATH = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "sqrt": F.sqrt, "log": log, "log10": log10, "abs": F.abs, "arctan": F.atan, "arcsin": F.asin, "arccos": F.acos}
MATH_2 = {"arctan2": F.atan2}


def mapping(keys: Column, values: Column) -> Column:
    """dict(zip(keys, values)): of equal keys the last one's value counts."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    later = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]).alias("again")))
    return F.map_from_entries(F.transform(F.filter(later, lambda p: ~p["again"]), lambda p: F.struct(p["k"], p["v"])))


def keys(m: Column) -> Column:
    return F.map_keys(m)


def values(m: Column) -> Column:
    return F.map_values(m)


def items(m: Column) -> Column:
    return F.map_entries(m)


def get(m: Column, key: Column, default: Column) -> Column:
    return F.when(F.map_contains_key(m, key), F.try_element_at(m, key)).otherwise(default)


def reshape(xs: Column, rows: int, columns: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(xs, i * columns + 1, F.lit(columns)))


def meshgrid(xs: Column, ys: Column) -> Column:
    """struct<x, y> of two matrices."""
    return F.struct(F.transform(ys, lambda _: xs).alias("x"), F.transform(ys, lambda y: F.transform(xs, lambda _: y)).alias("y"))
