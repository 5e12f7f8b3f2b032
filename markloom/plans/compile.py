"""From a chart spec to its mark table: one lazy DataFrame, and the axes as metadata."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.marks import draw
from ..sources import relations
from .filters import field as column
from .filters import fields_of, negates, predicate
from .spec import Concat, Facet, Layer, Plan, SpecError, Unit, plan


@dataclass
class MarkTable:
    df: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)


class Compiler:
    """`sources` names DataFrames (R: datasets, tables). `strict` makes what the language passes over an error."""

    def __init__(self, spark: SparkSession, sources: dict[str, DataFrame] | None = None, strict: bool = False, order_by: str | None = None):
        self.spark, self.sources, self.strict, self.order_by = spark, sources or {}, strict, order_by
        self.datasets: dict[str, list] = {}
        self._read: dict = {}

    def rows(self, unit: Unit) -> DataFrame:
        """The unit's source after its filters. Equal sources are one DataFrame, so that layers share a scan.

        Filters come twice where floats may hold NaN: on the columns as they are, which the scan takes up and which
        lets through all rows that pass, and on the columns with null for NaN, which says what passes. With a negation
        they come on the latter alone, as NaN exceeds all numbers where null doesn't.
        """
        source = unit.source
        key = (source.name, source.url, id(source.values)) if source.values or source.name or source.url else id(unit)
        if key not in self._read:
            self._read[key] = (relations.resolve(self.spark, unit.source, self.sources, self.datasets, _fields(unit)), unit.source)
        rows, tests, early = self._read[key][0], [], True
        for step in unit.transforms:
            test = predicate(step["filter"]) if isinstance(step, dict) and "filter" in step else None
            if test is None:
                if self.strict:
                    raise SpecError(f"transform {step!r} isn't supported")
                warnings.warn(f"transform {step!r} is passed over", stacklevel=2)
                continue
            early = early and not negates(step["filter"])
            tests.append(test)
        floats = relations.without_nan(rows) is not rows
        if early or not floats:
            for test in tests:
                rows = rows.where(test)
        clean = relations.without_nan(rows)
        if floats:
            for test in tests:
                clean = clean.where(test)
        return clean

    def order(self) -> Column:
        return column(self.order_by) if self.order_by else F.monotonically_increasing_id()

    def compile(self, node) -> DataFrame:
        if isinstance(node, SpecError):
            raise node
        if isinstance(node, Concat):
            return self.concat(node)
        if isinstance(node, Layer):
            return _stack([draw(self.rows(u), [], u, self.order()).withColumn("layer", F.lit(i)) for i, u in enumerate(node.children)])
        if isinstance(node, Facet):
            rows = self.rows(node.child)
            rows = rows.withColumn("panel", column(node.field) if node.field in rows.columns else F.lit(None).cast("string"))
            return draw(rows.where("panel is not null"), ["panel"], node.child, self.order())
        return draw(self.rows(node), [], node, self.order())


    def concat(self, node: Concat) -> DataFrame:
        """The panels by their number. One that can't be drawn is left out with a warning, or an error if strict."""
        parts = []
        for number, child in enumerate(node.children):
            try:
                parts.append(self.compile(child).withColumn("panel", F.lit(number)))
            except SpecError as wrong:
                if self.strict:
                    raise
                warnings.warn(f"panel {number} is left out: {wrong}", stacklevel=2)
        if not parts:
            raise SpecError("no panel can be drawn")
        return _stack(parts)


def _fields(unit: Unit) -> list[str]:
    """The fields that a unit reads, which a relation without rows has too."""
    tests = [t["filter"] for t in unit.transforms if isinstance(t, dict) and "filter" in t]
    return sorted({c.field for c in unit.channels.values() if c.field} | {f for t in tests for f in fields_of(t)})


def _stack(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns of the same name and another type meet as strings."""
    kinds: dict[str, set] = {}
    for p in parts:
        for name, kind in p.dtypes:
            kinds.setdefault(name, set()).add(kind)
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    meet = {n: "double" if k <= numeric else "string" for n, k in kinds.items() if len(k) > 1}
    out = None
    for p in parts:
        p = p.withColumns({n: p[n].cast(t) for n, t in meet.items() if n in p.columns})
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def axes(node) -> dict[str, Any]:
    """Labels, scales, limits and title; a layer takes those of its first child, a concatenation has a list."""
    if isinstance(node, SpecError):
        return {"error": str(node)}
    if isinstance(node, Concat):
        return {"grid": (node.rows, node.columns), "panels": [axes(c) for c in node.children]}
    if isinstance(node, Layer):
        return axes(node.children[0])
    if isinstance(node, Facet):
        return {"facet": node.direction, "field": node.field, **axes(node.child)}
    out: dict[str, Any] = {"title": node.title, "mark": node.mark}
    for name in ("x", "y"):
        if ch := node.channels.get(name):
            out[name] = {"label": ch.title, "log": ch.log, "domain": ch.domain}
    return out


def first_appearance(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """The panels of a facet in order of first appearance."""
    return df.groupBy(column(key).alias("panel")).agg(F.min(column(order_by)).alias("first"))


def compile_spec(spark: SparkSession, spec: Any, sources: dict[str, DataFrame] | None = None, strict: bool = False, order_by: str | None = None) -> MarkTable:
    """The mark table of a spec (dict, JSON or text with JSON)."""
    parsed: Plan = plan(spec)
    compiler = Compiler(spark, sources, strict, order_by)
    compiler.datasets = parsed.datasets
    return MarkTable(compiler.compile(parsed.root), axes(parsed.root))
