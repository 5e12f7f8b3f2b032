"""A drawing script for a spec with inline data: plain Python and matplotlib, made of text, never run here."""

from __future__ import annotations

import json
from typing import Any

from . import filters
from .spec import AGGREGATES, Channel, Concat, Facet, Layer, Plan, SpecError, Unit, parse_spec, plan

NONE = Channel()
PREAMBLE = '''\
import operator
import statistics

import matplotlib.pyplot as plt

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
COMPUTE = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod}
AGGREGATE = {"mean": statistics.fmean, "sum": sum, "count": len, "median": statistics.median, "min": min, "max": max}


def compare(op, a, b):
    return a is not None and b is not None and COMPARE[op](a, b)


def compute(op, a, b):
    return None if a is None or b is None or (op in "/%" and b == 0) else COMPUTE[op](a, b)


def values(rows, name, default=None):
    return [r.get(name, default) for r in rows]


def firsts(rows, name):
    return list(dict.fromkeys(values(rows, name)))


def split(rows, name):
    keys = sorted({r.get(name) for r in rows} - {None})
    return [(k, [r for r in rows if r.get(name) == k]) for k in keys]


def folded(rows, how, name):
    given = list(rows) if how == "count" or name is None else [v for v in values(rows, name) if v is not None]
    return AGGREGATE[how](given) if given or how in ("sum", "count") else None
'''


def _filter(test: Any) -> str | None:
    if isinstance(test, str):
        return filters.string_filter(test, filters.Source)
    if not isinstance(test, dict) or "field" not in test:
        return None
    on, x = filters.Source, filters.Source.field(test["field"])
    parts = [on.compared(op, x, repr(test[k])) for k, op in (("equal", "=="), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")) if k in test]
    if isinstance(test.get("oneOf"), list):
        parts.append(f"{x} in {test['oneOf']!r}")
    if isinstance(test.get("range"), list) and len(test["range"]) == 2:
        parts += [on.compared(op, x, repr(v)) for op, v in zip((">=", "<="), test["range"], strict=True)]
    return " and ".join(parts) or None


class Writer:
    def __init__(self, made: Plan):
        self.datasets, self.lines = made.datasets, []

    def add(self, *lines: str, depth: int = 0) -> None:
        self.lines += ["    " * depth + line for line in lines]

    def rows(self, unit: Unit) -> None:
        data = unit.source
        if data.values is None and data.name not in self.datasets and data.url is not None:
            reader = "list(csv.DictReader(file))" if data.url.lower().endswith(".csv") else "json.load(file)"
            self.add("import csv, json", f"with open({data.url!r}) as file:", f"    rows = {reader}")
        else:
            found = list(data.values) if data.values is not None else self.datasets.get(data.name, [])
            self.add(f"rows = {[r if isinstance(r, dict) else {'data': r} for r in found]!r}")
        for step in unit.transforms:
            test = _filter(step["filter"]) if isinstance(step, dict) and "filter" in step else None
            self.add(f"rows = [r for r in rows if {test}]" if test else f"# passed over: {json.dumps(step)}")

    def draw(self, unit: Unit, ax: str = "ax", depth: int = 0) -> None:
        make = getattr(self, f"on_{ {'circle': 'point'}.get(unit.mark, unit.mark) }", None)
        if make is None:
            raise SpecError(f"unknown mark {unit.mark}")
        self.ax, self.depth = ax, depth
        make(unit.channels.get("x", NONE), unit.channels.get("y", NONE), unit.channels.get("color", NONE).field, unit)

    def put(self, *lines: str) -> None:
        self.add(*(line.replace("AX", self.ax) for line in lines), depth=self.depth)

    def need(self, *channels: Channel) -> None:
        if not all(c.field for c in channels):
            raise SpecError("a field is missing")

    def series(self, color: str | None, *lines: str) -> None:
        """The lines for all rows, or for the rows of each color."""
        self.put(f"for name, part in {f'split(rows, {color!r})' if color else '[(None, rows)]'}:", *(f"    {line}" for line in lines))

    def on_bar(self, x: Channel, y: Channel, color: str | None, unit: Unit) -> None:
        if x.bin and y.aggregate == "count":
            self.put(f"AX.hist([v for v in values(rows, {x.field!r}) if v is not None], bins={x.maxbins or 10})")
            return
        known = [c.aggregate in AGGREGATES for c in (x, y)]
        if known[0] == known[1]:
            self.need(x, y)
            if not color:
                self.put(f"AX.bar(values(rows, {x.field!r}), values(rows, {y.field!r}))")
                return
            self.stacked(f"firsts(rows, {x.field!r})", f"firsts(rows, {color!r})", f"sum(r.get({y.field!r}) or 0 for r in rows if r.get({x.field!r}) == key and r.get({color!r}) == name)")
            return
        key, value, call = (x, y, "bar") if known[1] else (y, x, "barh")
        self.need(key)
        keys = f"[k for k, _ in split(rows, {key.field!r})]"
        if color:
            part = f"[r for r in rows if r.get({key.field!r}) == key and r.get({color!r}) == name]"
            self.stacked(keys, f"[k for k, _ in split(rows, {color!r})]", f"(folded({part}, {value.aggregate!r}, {value.field!r}) if {part} else 0)")
        else:
            self.put(f"groups = split(rows, {key.field!r})", f"AX.{call}([str(k) for k, _ in groups], [folded(g, {value.aggregate!r}, {value.field!r}) for _, g in groups])")

    def stacked(self, keys: str, names: str, height: str) -> None:
        self.put(f"keys, names = {keys}, {names}", "width = 0.8 / max(1, len(names))", "for i, name in enumerate(names):", "    at = [k + i * width - 0.4 + width / 2 for k in range(len(keys))]", f"    AX.bar(at, [{height} for key in keys], width, label=str(name))", "AX.set_xticks(range(len(keys)), [str(k) for k in keys])", "AX.legend()")

    def on_point(self, x: Channel, y: Channel, color: str | None, unit: Unit) -> None:
        self.need(x, y)
        for what, name in (("size", unit.channels.get("size", NONE).field), ("opacity", unit.channels.get("opacity", NONE).field)):
            self.put(f"top_{what} = max([1, *(v for v in values(rows, {name!r}) if v is not None)])" if name else f"top_{what} = None")
        size, opacity = unit.channels.get("size", NONE).field, unit.channels.get("opacity", NONE).field
        s = f"[(v or 0) / top_size * 200 + 8 for v in values(part, {size!r})]" if size else "24"
        alpha = f", alpha=[min(max((v or 0) / top_opacity, 0), 1) for v in values(part, {opacity!r})]" if opacity else ""
        self.series(color, f"AX.scatter(values(part, {x.field!r}), values(part, {y.field!r}), s={s}{alpha}, label=name)")

    def on_line(self, x: Channel, y: Channel, color: str | None, unit: Unit) -> None:
        self.need(x, y)
        self.series(color, f"AX.plot(values(part, {x.field!r}), values(part, {y.field!r}), label=name)")

    def on_area(self, x: Channel, y: Channel, color: str | None, unit: Unit) -> None:
        self.need(x, y)
        self.series(color, f"AX.fill_between(values(part, {x.field!r}), values(part, {y.field!r}), 0, alpha=0.5, label=name)")

    def on_tick(self, x: Channel, y: Channel, color: str | None, unit: Unit) -> None:
        self.need(x)
        ys = f"values(rows, {y.field!r})" if y.field else "[0] * len(rows)"
        self.put(f"AX.scatter(values(rows, {x.field!r}), {ys}, marker='|')")

    def on_rect(self, x: Channel, y: Channel, color: str | None, unit: Unit) -> None:
        self.need(x, y, unit.channels.get("color", NONE))
        self.put(f"xs, ys = sorted(firsts(rows, {x.field!r})), sorted(firsts(rows, {y.field!r}))", f"cells = {{(r[{y.field!r}], r[{x.field!r}]): r.get({color!r}) for r in rows}}", "assert len(cells) == len(rows), 'a heatmap cell has several rows'", "AX.imshow([[float('nan') if cells.get((b, a)) is None else cells[b, a] for a in xs] for b in ys])")

    def on_boxplot(self, x: Channel, y: Channel, color: str | None, unit: Unit) -> None:
        self.need(y)
        groups = f"[[v for v in values([r for r in rows if r.get({x.field!r}) == k], {y.field!r}) if v is not None] for k in firsts(rows, {x.field!r})]" if x.field else f"[[v for v in values(rows, {y.field!r}) if v is not None]]"
        self.put(f"AX.boxplot({groups})")

    def on_arc(self, x: Channel, y: Channel, color: str | None, unit: Unit) -> None:
        theta = unit.channels.get("theta", NONE)
        self.need(theta)
        self.put(f"AX.pie(values(rows, {theta.field!r}), labels={f'[str(v) for v in values(rows, {color!r})]' if color else None}, autopct='%.1f%%')")

    def axes(self, unit: Unit, ax: str = "ax", depth: int = 0) -> None:
        for name in ("x", "y"):
            ch = unit.channels.get(name)
            if ch is not None:
                made = [f"{ax}.set_{name}label({ch.title!r})" if ch.title else "", f"{ax}.set_{name}scale('log')" if ch.log else "", f"{ax}.set_{name}lim(*{ch.domain!r})" if ch.domain else ""]
                self.add(*filter(None, made), depth=depth)
        if unit.title:
            self.add(f"{ax}.set_title({unit.title!r})", depth=depth)

    def node(self, node, ax: str) -> None:
        for unit in node.children if isinstance(node, Layer) else [node]:
            if not isinstance(unit, Unit):
                raise SpecError("a panel has to be a unit or a layer")
            self.rows(unit)
            self.draw(unit, ax)
        self.axes(node.children[0] if isinstance(node, Layer) else node, ax)


def to_script(spec: Any) -> str:
    """R1-R6 as a script. Raises SpecError for what can't be drawn."""
    made = plan(spec)
    w, root = Writer(made), made.root
    w.add(*PREAMBLE.splitlines(), "", "")
    if isinstance(root, Concat):
        w.add(f"fig, axes = plt.subplots({root.rows}, {root.columns}, squeeze=False)")
        for i, child in enumerate(root.children):
            w.node(child, f"axes.flat[{i}]")
    elif isinstance(root, Facet):
        w.rows(root.child)
        n = f"1, max(1, len(panels))" if root.direction == "column" else "max(1, len(panels)), 1"
        w.add("every = rows", f"panels = firsts(every, {root.field!r})", f"fig, axes = plt.subplots({n}, squeeze=False)", "for ax, panel in zip(axes.flat, panels):", f"    rows = [r for r in every if panel is not None and r.get({root.field!r}) == panel]")
        w.draw(root.child, depth=1)
        w.axes(root.child, depth=1)
        w.add("    ax.set_title(str(panel))")
    else:
        w.add("fig, ax = plt.subplots()")
        w.node(root, "ax")
    w.add("plt.tight_layout()", "plt.show()", "")
    return "\n".join(w.lines)


def script_or_stub(text: Any) -> str:
    """The script of the spec in a text, or one that raises."""
    try:
        if parse_spec(text) is None:
            return "raise RuntimeError('no chart spec in the output')"
        return to_script(text)
    except (SpecError, filters.FilterError, IndexError, TypeError, AttributeError, KeyError) as error:
        return f"raise RuntimeError({f'the chart spec cannot be drawn: {error}'!r})"
