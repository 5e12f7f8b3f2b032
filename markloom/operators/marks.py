"""Marks as relational operators. Each takes rows and gives the rows of its mark table.

`by` holds the panel columns of a facet: they join every grouping and window key, so a facet is no loop. Null keys
drop out of groupings, absent cells are zero, and NaN counts as null (it is replaced at the source).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.filters import field
from ..plans.spec import AGGREGATES, Channel, SpecError, Unit

NONE = Channel()
DEFAULT_BINS = 10


def aggregate(name: str, value: str | None) -> Column:
    if name == "count" or value is None:
        return F.count(F.lit(1))
    x = field(value)
    return {"mean": F.avg(x), "sum": F.coalesce(F.sum(x), F.lit(0)), "min": F.min(x), "max": F.max(x)}[name]


#: Cells of the histogram that ranks are found in, for each factor of e in the values.
CELLS = 4096
#: A join on a group's key meets the group in so many parts.
SALTS = 32


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, cell, v, m: each distinct value of a group with its number of rows. Cells are in order of the values."""
    v = F.col(value).cast("double")
    cell = F.floor(F.least(F.log1p(F.abs(v)), F.lit(1e4)) * CELLS * F.signum(v)).cast("long")
    return rows.where(F.col(value).isNotNull()).select(*keys, cell.alias("cell"), v.alias("v")).groupBy(*keys, "cell", "v").agg(F.count(F.lit(1)).alias("m"))


def quantiles(counts: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """keys, n and q: exact quantiles with linear interpolation, from value_counts().

    The ranks are found in the counts of cells, and only the values of the cells that hold one are ranked, each cell by
    itself. So no task sees a group's values; it sees its cells, whose number goes with the logarithm of their range.
    """
    cells = counts.groupBy(*keys, "cell").agg(F.sum("m").alias("c"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto, n = F.sum("c").over(group.orderBy("cell")), F.sum("c").over(group)
    at = [side((F.col("n") - 1) * fraction) for fraction in fractions for side in (F.floor, F.ceil)]
    placed = cells.select(*keys, "cell", (upto - F.col("c")).alias("before"), upto.alias("upto"), n.alias("n"))
    holds = F.exists(F.array(*at), lambda r: (r >= F.col("before")) & (r < F.col("upto")))
    wanted = placed.where(holds).select(*keys, "cell", "before", "n")
    within = Window.partitionBy(*keys, "cell").orderBy("v")
    inside = counts.join(wanted, [*keys, "cell"]).withColumn("stop", F.col("before") + F.sum("m").over(within))
    found = [F.min(F.when((r >= F.col("stop") - F.col("m")) & (r < F.col("stop")), F.col("v"))).alias(f"r{i}") for i, r in enumerate(at)]
    picked = inside.groupBy(*keys, "n").agg(*found)
    between = []
    for k, fraction in enumerate(fractions):
        low, high = F.col(f"r{2 * k}"), F.col(f"r{2 * k + 1}")
        share = (F.col("n") - 1) * fraction - F.floor((F.col("n") - 1) * fraction)
        between.append(F.when(low == high, low).otherwise((1 - share) * low + share * high))
    return picked.select(*keys, "n", F.array(*between).alias("q"))


def medians(rows: DataFrame, keys: list[Column], value: str) -> DataFrame:
    """The key columns with the median as y; null for a group that has no values."""
    named = rows.select(*keys, field(value).alias("__v"))
    names = [c for c in named.columns if c != "__v"]
    middle = quantiles(value_counts(named, names, "__v"), names, [0.5]).select(*names, F.col("q")[0].alias("y"))
    return named.select(*names).distinct().join(middle, names, "left")


def histogram(rows: DataFrame, by: list[str], x: Channel) -> DataFrame:
    """Exactly N equal bins from the smallest to the largest value, the last one closed; empty bins count 0."""
    n = x.maxbins or DEFAULT_BINS
    values = rows.select(*by, field(x.field).cast("double").alias("v")).where("v is not null")
    ends = values.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.where("lo is not null").select(*by, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    # one row for each panel; without panels it is a single row
    # panels may be many, so the planner decides by their size
    with_ends = values.join(ends, by) if by else values.crossJoin(F.broadcast(ends))
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n)), F.lit(n - 1)).cast("int")
    counts = with_ends.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("y"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    width = (F.col("hi") - F.col("lo")) / n
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("x"), (F.col("lo") + (F.col("bin") + 1) * width).alias("x2"), F.coalesce("y", F.lit(0)).cast("long").alias("y"))


def aggregated_bar(rows: DataFrame, by: list[str], key: str, name: str, value: str | None) -> DataFrame:
    """R11."""
    rows = rows.where(field(key).isNotNull())
    if name == "median" and value is not None:
        return medians(rows, [*map(F.col, by), field(key).alias("x")], value)
    return rows.groupBy(*by, field(key).alias("x")).agg(aggregate(name, value).alias("y"))


def _grid(cells: DataFrame, by: list[str]) -> DataFrame:
    """Every x with every series of its panel; the cells are aggregated already, so both sides are distinct keys."""
    xs, series = cells.select(*by, "x").distinct(), cells.select(*by, "series").distinct()
    return xs.join(series, by) if by else xs.crossJoin(series)


def grouped_bar(rows: DataFrame, by: list[str], key: str, color: str, name: str, value: str | None) -> DataFrame:
    """Pairs that don't occur are 0; a null aggregate of a pair that does stays null."""
    keyed = rows.where(field(key).isNotNull() & field(color).isNotNull())
    keys = [*map(F.col, by), field(key).alias("x"), field(color).alias("series")]
    cells = medians(keyed, keys, value) if name == "median" and value is not None else keyed.groupBy(*keys).agg(aggregate(name, value).alias("y"))
    cells = cells.withColumn("__there", F.lit(True))
    return _grid(cells, by).join(cells, [*by, "x", "series"], "left").select(*by, "x", "series", F.when(F.col("__there"), F.col("y")).otherwise(F.lit(0)).alias("y"))


def raw_grouped_bar(rows: DataFrame, by: list[str], key: str, color: str, value: str, order: Column) -> DataFrame:
    """Sums by series and x with both in order of first appearance, and the middle of each bar.

    `order` says what comes first. Null keys keep their place, but match no rows, so their bars are 0.
    """
    keyed = rows.select(*by, field(key).alias("x"), field(color).alias("series"), field(value).alias("v"), order.alias("__o"))
    cells = keyed.groupBy(*by, "x", "series").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("y"), F.min("__o").alias("__o"))

    def ranked(name: str) -> DataFrame:
        # distinct keys only, one row each
        firsts = cells.groupBy(*by, name).agg(F.min("__o").alias("__f"))
        w = Window.partitionBy(*by).orderBy("__f") if by else Window.partitionBy(F.lit(0)).orderBy("__f")
        every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return firsts.select(*by, name, (F.row_number().over(w) - 1).alias(f"{name}_index"), F.count(F.lit(1)).over(every).alias(f"n_{name}"))

    xs, series = ranked("x"), ranked("series")
    grid = xs.join(series, by) if by else xs.crossJoin(series)
    present = cells.where("x is not null and series is not null").select(*by, "x", "series", "y")
    width = F.lit(0.8) / F.greatest(F.lit(1), F.col("n_series"))
    return grid.join(present, [*by, "x", "series"], "left").select(*by, "x", "series", F.coalesce("y", F.lit(0)).alias("y"), "x_index", "series_index", (F.col("x_index") + F.col("series_index") * width - 0.4 + width / 2).alias("position"))


def scatter(rows: DataFrame, by: list[str], ch: dict[str, Channel]) -> DataFrame:
    """Sizes and opacities relative to the panel's largest value, split by color or not."""
    panel = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    out = [field(ch["x"].field).alias("x"), field(ch["y"].field).alias("y")]

    def share(c: Channel) -> Column:
        v = field(c.field).cast("double")
        return v / F.greatest(F.lit(1.0), F.max(v).over(panel))

    size, opacity = ch.get("size", NONE), ch.get("opacity", NONE)
    color = ch.get("color", NONE).field
    if not by and (size.field or opacity.field):
        # one partial aggregate instead of a window over everything
        names = [c.field for c in (size, opacity) if c.field]
        rows = rows.crossJoin(F.broadcast(rows.agg(*(F.max(field(n).cast("double")).alias(f"__max_{n}") for n in dict.fromkeys(names)))))
        share = lambda c: field(c.field).cast("double") / F.greatest(F.lit(1.0), F.col(f"`__max_{c.field}`"))
    out.append((share(size) * 200 + 8 if size.field else F.lit(float(size.value or 24))).alias("size"))
    out.append((F.least(F.greatest(share(opacity), F.lit(0.0)), F.lit(1.0)) if opacity.field else F.lit(float(1.0 if opacity.value is None else opacity.value))).alias("opacity"))
    out.append((field(color) if color else F.lit(None).cast("string")).alias("series"))
    done = rows.select(*by, *out)
    return done.where("series is not null") if color else done


def raw(rows: DataFrame, by: list[str], ch: dict[str, Channel], extra: dict[str, Column] | None = None, order: Column | None = None) -> DataFrame:
    """A mark for each row. `ordinal` is the rows' order, in which a line goes from one to the next."""
    color = ch.get("color", NONE).field
    order = F.monotonically_increasing_id() if order is None else order
    done = rows.select(*by, field(ch["x"].field).alias("x"), (field(ch["y"].field) if ch.get("y", NONE).field else F.lit(0)).alias("y"), (field(color) if color else F.lit(None).cast("string")).alias("series"), order.alias("ordinal"), *(c.alias(k) for k, c in (extra or {}).items()))
    return done.where("series is not null") if color else done


def heatmap(rows: DataFrame, by: list[str], ch: dict[str, Channel]) -> DataFrame:
    """A cell for each x and y; a second row for a cell is an error, raised when the cell is computed."""
    cells = rows.where(field(ch["x"].field).isNotNull() & field(ch["y"].field).isNotNull()).groupBy(*by, field(ch["x"].field).alias("x"), field(ch["y"].field).alias("y")).agg(F.first(field(ch["color"].field)).alias("value"), F.count(F.lit(1)).alias("__n"))
    return cells.select(*by, "x", "y", F.when(F.col("__n") == 1, F.col("value")).otherwise(F.raise_error(F.lit("a heatmap cell has several rows"))).alias("value"))


def boxplot(rows: DataFrame, by: list[str], ch: dict[str, Channel], order: Column | None = None) -> DataFrame:
    """Linear quartiles, whiskers at the last points within 1.5 times the box, and the number of points beyond.

    `first` is the order of the group's first row, in which the boxes stand. The boxes meet their values in SALTS parts,
    so that no task has all of a group.
    """
    group = ch.get("x", NONE).field
    order = F.monotonically_increasing_id() if order is None else order
    keyed = rows.select(*by, (field(group) if group else F.lit("all")).alias("x"), field(ch["y"].field).cast("double").alias("y"), order.alias("__o")).where("x is not null")
    keys = [*by, "x"]
    counts = value_counts(keyed, keys, "y")
    boxes = quantiles(counts, keys, [0.25, 0.5, 0.75])
    boxes = boxes.select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = F.col("q3") - F.col("q1")
    inside = F.col("v").between(F.col("q1") - 1.5 * reach, F.col("q3") + 1.5 * reach)
    parted = counts.withColumn("__s", F.pmod(F.col("cell"), F.lit(SALTS)))
    met = parted.join(boxes.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "__s"])
    done = met.groupBy(*keys, "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.coalesce(F.sum(F.when(~inside, F.col("m"))), F.lit(0)).alias("n_outliers"))
    return done.join(keyed.groupBy(*keys).agg(F.min("__o").alias("first")), keys)


def outliers(rows: DataFrame, boxes: DataFrame, key: str, value: str) -> DataFrame:
    """The points beyond the whiskers."""
    return rows.select(field(key).alias("x"), field(value).cast("double").alias("y")).join(boxes.select("x", "low", "high"), "x").where("y < low or y > high").select("x", "y")


def pie(rows: DataFrame, by: list[str], ch: dict[str, Channel]) -> DataFrame:
    """A wedge for each row, with its share of the panel's total."""
    v = field(ch["theta"].field)
    color = ch.get("color", NONE).field
    done = rows.select(*by, (field(color).cast("string") if color else F.lit(None).cast("string")).alias("series"), v.alias("value"))
    total = done.groupBy(*by).agg(F.sum("value").alias("__t"))
    done = done.join(total, by) if by else done.crossJoin(F.broadcast(total))
    return done.select(*by, "series", "value", F.try_divide(F.col("value").cast("double"), F.col("__t")).alias("share"))


def _need(unit: Unit, *names: str) -> None:
    missing = [n for n in names if not unit.channels.get(n, NONE).field]
    if missing:
        raise SpecError(f"{unit.mark} needs {', '.join(missing)}")


def bar(rows: DataFrame, by: list[str], unit: Unit, order: Column) -> DataFrame:
    x, y = unit.channels.get("x", NONE), unit.channels.get("y", NONE)
    color = unit.channels.get("color", NONE).field
    if x.bin and y.aggregate == "count":
        return histogram(rows, by, x)
    known = [c.aggregate in AGGREGATES for c in (x, y)]
    if known[0] != known[1]:
        key, value, way = (x, y, "vertical") if known[1] else (y, x, "horizontal")
        if not key.field or (value.aggregate != "count" and not value.field):
            raise SpecError("an aggregated bar needs both fields")
        out = grouped_bar(rows, by, key.field, color, value.aggregate, value.field) if color else aggregated_bar(rows, by, key.field, value.aggregate, value.field)
        return out if way == "vertical" else out.select(*(F.col(c).alias({"x": "y", "y": "x"}.get(c, c)) for c in out.columns))
    _need(unit, "x", "y")
    return raw_grouped_bar(rows, by, x.field, color, y.field, order) if color else raw(rows, by, unit.channels, order=order)


def _fielded(*needed: str):
    def over(make: Callable) -> Callable:
        def run(rows: DataFrame, by: list[str], unit: Unit, order: Column) -> DataFrame:
            _need(unit, *needed)
            return make(rows, by, unit.channels, order)

        return run

    return over


def _any_order(make: Callable) -> Callable:
    return lambda rows, by, ch, order: make(rows, by, ch)


def _in_order(rows: DataFrame, by: list[str], ch: dict[str, Channel], order: Column) -> DataFrame:
    return raw(rows, by, ch, order=order)


MARKS: dict[str, Callable] = {
    "bar": bar,
    "point": _fielded("x", "y")(_any_order(scatter)),
    "circle": _fielded("x", "y")(_any_order(scatter)),
    "line": _fielded("x", "y")(_in_order),
    "area": _fielded("x", "y")(lambda rows, by, ch, order: raw(rows, by, ch, {"baseline": F.lit(0)}, order)),
    "tick": _fielded("x")(_in_order),
    "rect": _fielded("x", "y", "color")(_any_order(heatmap)),
    "boxplot": _fielded("y")(boxplot),
    "arc": _fielded("theta")(_any_order(pie)),
}


def draw(rows: DataFrame, by: list[str], unit: Unit, order: Column) -> DataFrame:
    """Dispatch by mark; an unknown one is an error before anything runs."""
    if unit.mark not in MARKS:
        raise SpecError(f"unknown mark {unit.mark}")
    return MARKS[unit.mark](rows, by, unit, order)
