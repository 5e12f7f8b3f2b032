"""From a plotting script to a chart spec, by reading its syntax tree with a small evaluator; nothing is run.

Kept as they are in the language this reproduces: loops are read once and bind no variable, and the body of a
top-level loop or with-block counts twice; a conditional expression is its first branch; random draws all start from
seed 0; arrays meet element by element. Sizes are bounded, so a script can't ask for much memory.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import batched
from ..functions.pycode import called, parsed
from ..plans.spec import SPEC_KEYS, canonical, canonical_text, is_supported, parse_spec

#: Values that one evaluated expression may have; a script that makes more has no spec. A bound of memory, so a parameter.
MOST_VALUES = 1_000_000
#: Calls that draw, and those that subplots are read from.
DRAWING = frozenset(
    (
        "plot", "scatter", "bar", "barh", "hist", "imshow", "pcolormesh", "boxplot", "fill_between", "heatmap", "stem",
        "errorbar", "pie", "step", "stairs", "stackplot", "matshow", "semilogx", "semilogy", "loglog",
    )
)
PANEL_DRAWING = frozenset(
    (
        "plot", "scatter", "bar", "barh", "hist", "imshow", "pcolormesh", "boxplot", "fill_between", "stem", "errorbar",
        "pie", "step",
    )
)
CONSTANTS = {"pi": np.pi, "e": np.e, "inf": np.inf, "nan": np.nan}
Env = dict[str, Any]


class TooLarge(ValueError):
    pass


def plain(value: Any) -> Any:
    """Lists, numbers and strings in place of arrays and tuples."""
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, np.generic):
        return value.item()
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def bounded(n: Any) -> Any:
    if int(np.prod(np.atleast_1d(np.asarray(n, dtype=float)))) > MOST_VALUES:
        raise TooLarge
    return n


def as_list(value: Any) -> list | None:
    value = plain(value)
    return value if isinstance(value, list) else None


# --- values -------------------------------------------------------------------------------------------------------

POWER = ast.Pow
ARITHMETIC: dict[type, Callable] = {ast.Add: np.add, ast.Sub: np.subtract, ast.Mult: np.multiply, ast.Div: np.true_divide, ast.Mod: np.remainder, POWER: np.power}


def _arange(args: list) -> list:
    start, stop, step = (0, args[0], 1) if len(args) == 1 else (args[0], args[1], args[2] if len(args) > 2 else 1)
    bounded(abs((stop - start) / step) + 1)
    out, now = [], start
    while (step > 0 and now < stop) or (step < 0 and now > stop):
        out.append(now)
        now += step  # by repeated addition, with its drift
    return out


def _linspace(args: list) -> list:
    a, b, n = float(args[0]), float(args[1]), bounded(int(args[2]) if len(args) > 2 else 50)
    return [a] if n <= 1 else [a + i * ((b - a) / (n - 1)) for i in range(n)]


def _first(f: Callable) -> Callable:
    return lambda args, kw: f(args[0])


BUILTINS: dict[str, Callable] = {"len": _first(len), "int": _first(int), "float": _first(float), "str": _first(str), "range": lambda args, kw: list(range(*map(int, _ranged(args))))}
ARRAYS: dict[str, Callable] = {
    "zeros": lambda a, k: np.zeros(bounded(a[0]), **k),
    "ones": lambda a, k: np.ones(bounded(a[0]), **k),
    "full": lambda a, k: np.full(bounded(a[0]), *a[1:], **k),
    "repeat": lambda a, k: np.repeat(a[0], bounded(a[1]), **k),
    "meshgrid": lambda a, k: np.meshgrid(*a, **k),
    "cumsum": _first(np.cumsum),
    "diff": lambda a, k: np.diff(*a),
    "concatenate": lambda a, k: np.concatenate(*a, **k),
}
UFUNCS = {n: getattr(np, n) for n in ("sin", "cos", "tan", "exp", "sqrt", "log", "log10", "abs", "arctan2", "arctan", "arcsin", "arccos")}
METHODS: dict[str, Callable] = {n: (lambda n: lambda x, a, k: getattr(x, n)(*(a if n == "reshape" else ()), **(k if n in ("mean", "min", "max", "sum") else {})))(n) for n in ("flatten", "ravel", "reshape", "mean", "min", "max", "sum", "cumsum", "tolist")}


def _ranged(args: list) -> list:
    given = [a for a in args if a is not None]
    lo, hi, step = (0, given[0], 1) if len(given) == 1 else (given[0], given[1], given[2] if len(given) > 2 else 1)
    bounded(abs((hi - lo) / step) + 1)
    return given


def _size(value: Any) -> Any:
    return None if value is None else tuple(int(bounded(v)) for v in value) if isinstance(value, (list, tuple)) else int(bounded(value))


def _shape(args: list) -> Any:
    return _size(tuple(args)) if len(args) > 1 else _size(args[0]) if args else None


def _drawn(law: str, first: str, defaults: tuple[float, float]) -> Callable:
    def draw(rng: np.random.Generator, args: list, kw: dict) -> Any:
        given = [args[i] if i < len(args) and args[i] is not None else kw.get(n) for i, n in enumerate((first, "scale" if first != "low" else "high", "size"))]
        a, b = (d if g is None else g for g, d in zip(given, defaults, strict=False))
        return getattr(rng, law)(a, b, _size(given[2]))

    return draw


def _integers(rng: np.random.Generator, args: list, kw: dict) -> Any:
    low, high = (0, int(args[0])) if len(args) < 2 or args[1] is None else (int(args[0]), int(args[1]))
    return rng.integers(low, high, _size(args[2] if len(args) > 2 else kw.get("size")))


RANDOM: dict[str, Callable] = {
    "rand": lambda rng, a, k: rng.random(_shape(a)),
    "randn": lambda rng, a, k: rng.standard_normal(_shape(a)),
    "randint": _integers,
    "normal": _drawn("normal", "loc", (0.0, 1.0)),
    "uniform": _drawn("uniform", "low", (0.0, 1.0)),
    "gamma": _drawn("gamma", "shape", (1.0, 1.0)),
}


def dotted(node: ast.AST) -> str:
    return ".".join(filter(None, (dotted(node.value), node.attr))) if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


class Evaluator:
    """Values of expressions; None where there is none. Every failure inside an expression is a None."""

    def __init__(self) -> None:
        self.env: Env = {}

    def __call__(self, node: ast.AST | None) -> Any:
        if node is None:
            return None
        read = getattr(self, f"on_{type(node).__name__}", None)
        try:
            with np.errstate(all="ignore"):
                return read(node) if read else None
        except Exception:  # noqa: BLE001  whatever a script's values do, it only means that there is no value
            return None

    def on_Name(self, node: ast.Name) -> Any:
        return self.env.get(node.id)

    def on_Constant(self, node: ast.Constant) -> Any:
        return node.value

    def on_List(self, node: ast.List) -> Any:
        items = [self(x) for x in node.elts]
        return None if any(x is None for x in items) else items

    on_Tuple = on_List

    def on_Set(self, node: ast.Set) -> Any:
        return [self(x) for x in node.elts]

    def on_Dict(self, node: ast.Dict) -> Any:
        keys = [self(k) for k in node.keys]
        return None if any(k is None for k in keys) else dict(zip(keys, map(self, node.values), strict=True))

    def on_Subscript(self, node: ast.Subscript) -> Any:
        value = self(node.value)
        if isinstance(node.slice, ast.Slice):
            return value[slice(self(node.slice.lower), self(node.slice.upper), self(node.slice.step))]
        return value[self(node.slice)]

    def on_BinOp(self, node: ast.BinOp) -> Any:
        left, right = self(node.left), self(node.right)
        operation = ARITHMETIC.get(type(node.op))
        if left is None or right is None or operation is None:
            return None
        if isinstance(left, str) or isinstance(right, str):
            return left + right if isinstance(node.op, ast.Add) else None
        if not isinstance(left, list) and not isinstance(right, list):
            if isinstance(node.op, POWER) and isinstance(left, int) and isinstance(right, int) and (abs(left) > 1 << 31 or abs(right) > 64):
                raise TooLarge
            return {ast.Add: lambda: left + right, ast.Sub: lambda: left - right, ast.Mult: lambda: left * right, ast.Div: lambda: left / right, ast.Mod: lambda: left % right, POWER: lambda: left**right}[type(node.op)]()
        return plain(operation(np.asarray(left), np.asarray(right)))

    def on_UnaryOp(self, node: ast.UnaryOp) -> Any:
        value = self(node.operand)
        if isinstance(node.op, ast.UAdd) or value is None:
            return value
        return self.negative(value) if isinstance(node.op, ast.USub) else None

    def negative(self, value: Any) -> Any:
        return [self.negative(v) for v in value] if isinstance(value, list) else -value

    def on_IfExp(self, node: ast.IfExp) -> Any:
        return self(node.body)

    def on_Attribute(self, node: ast.Attribute) -> Any:
        if isinstance(node.value, ast.Name) and node.value.id in ("np", "numpy", "math") and node.attr in CONSTANTS:
            return CONSTANTS[node.attr]
        receiver = self(node.value)
        return receiver.get(node.attr) if isinstance(receiver, dict) else None

    def on_Call(self, node: ast.Call) -> Any:
        name = called(node)
        if name in ("array", "asarray", "list", "tuple") and node.args:
            return plain(self(node.args[0]))
        args = [self(a) for a in node.args]
        if name in ("arange", "linspace"):
            return None if not args or any(a is None for a in args) else (_arange if name == "arange" else _linspace)(args)
        return plain(self.call(node, name, args, {k.arg: self(k.value) for k in node.keywords if k.arg}))

    def call(self, node: ast.Call, name: str | None, args: list, kw: dict) -> Any:
        full, known = dotted(node.func), all(a is not None for a in args)
        if name in BUILTINS and args and (args[0] is not None or name == "range"):
            return BUILTINS[name](args, kw)
        if name == "dict" and not args:
            return {k: v for k, v in kw.items() if v is not None}
        receiver = self(node.func.value) if isinstance(node.func, ast.Attribute) else None
        if isinstance(receiver, dict):
            if name in ("keys", "values", "items"):
                return list(getattr(receiver, name)())
            return receiver.get(args[0], args[1] if len(args) > 1 else None) if name == "get" and args else None
        if name in ARRAYS and args:
            return ARRAYS[name](args, kw) if known and all(v is not None for v in kw.values()) else None
        if full in ("np.sum", "numpy.sum", "np.mean", "numpy.mean") and args:
            return getattr(np, name)(args[0])
        if name in UFUNCS and args:
            return UFUNCS[name](*(np.asarray(a) if isinstance(a, list) else a for a in args), **kw) if known else None
        if re.fullmatch(r"(np|numpy)\.random\.\w+", full):
            if name in ("rand", "randn", "randint") and not known:
                return None
            return RANDOM[name](np.random.default_rng(0), args, kw) if name in RANDOM else None
        if receiver is None or isinstance(receiver, str):
            return None
        if isinstance(receiver, list) and name in ("append", "copy"):
            return list(receiver) if name == "copy" else None
        if name in METHODS and (name != "reshape" or known):
            return METHODS[name](np.asarray(receiver), args, {k: v for k, v in kw.items() if v is not None})
        return None

    def keyword(self, node: ast.Call, name: str, default: Any = None) -> Any:
        found = next((self(k.value) for k in node.keywords if k.arg == name), None)
        return default if found is None else found

    def argument(self, node: ast.Call, at: int, name: str | None = None) -> Any:
        return self(node.args[at]) if at < len(node.args) else self.keyword(node, name) if name else None

    # --- statements ---

    def run(self, node: ast.AST, drawn: list[ast.Call]) -> None:
        """X3."""
        if isinstance(node, ast.Assign) and len(node.targets) == 1:
            self.assign(node.targets[0], node.value)
        elif isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name) and isinstance(node.op, ast.Add):
            now, more = self.env.get(node.target.id), self(node.value)
            if now is not None and more is not None:
                try:
                    self.env[node.target.id] = plain(np.asarray(now) + np.asarray(more))
                except (TypeError, ValueError):
                    pass
        elif isinstance(node, ast.Expr):
            if isinstance(node.value, ast.Call) and called(node.value) in DRAWING:
                drawn.append(node.value)
        elif isinstance(node, ast.For):
            for child in node.body:
                if isinstance(child, (ast.Expr, ast.Assign)):
                    self.run(child, drawn)
        elif isinstance(node, ast.With):
            for child in node.body:
                self.run(child, drawn)

    def assign(self, target: ast.AST, value_node: ast.AST) -> None:
        value = self(value_node)
        if isinstance(target, ast.Name) and value is not None:
            self.env[target.id] = value
        elif isinstance(target, (ast.Tuple, ast.List)) and isinstance(value, list) and len(value) == len(target.elts):
            self.env |= {t.id: v for t, v in zip(target.elts, value, strict=True) if isinstance(t, ast.Name)}
        elif isinstance(target, ast.Subscript) and isinstance(target.value, ast.Name) and isinstance(self.env.get(target.value.id), dict):
            key = self(target.slice)
            if key is not None and value is not None:
                self.env[target.value.id][key] = value


def statements(tree: ast.AST):
    """The top level in order, each compound statement followed by its own body."""
    for node in ast.iter_child_nodes(tree):
        yield node
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.For, ast.With, ast.If, ast.Try)):
            yield from node.body
        if isinstance(node, ast.If):
            yield from node.orelse


# --- charts -------------------------------------------------------------------------------------------------------


def chart(records: list | None, mark: Any, **encoding: Any) -> dict | None:
    """A unit spec; an encoding is field:type, or a channel as it is."""
    channels = {k: dict(zip(("field", "type"), v.split(":"), strict=True)) if isinstance(v, str) else v for k, v in encoding.items()}
    return None if records is None else {"data": {"values": records}, "mark": mark, "encoding": channels}


def pairs(xs: Any, ys: Any, x: str = "x", y: str = "y") -> list | None:
    """X13."""
    xs, ys = as_list(xs), as_list(ys)
    if ys is None:
        return None
    xs = list(range(len(ys))) if xs is None else xs
    return [{x: a, y: b} for a, b in zip(xs, ys, strict=True)] if len(xs) == len(ys) else None


XY = {"x": "x:quantitative", "y": "y:quantitative"}
SERIES = {"color": "series:nominal"}


class Charts:
    """The spec of one drawing call, or of several on one axis."""

    def __init__(self, value: Evaluator):
        self.value = value

    def one(self, call: ast.Call) -> dict | None:
        make = getattr(self, {"barh": "bar", "heatmap": "imshow", "pcolormesh": "imshow"}.get(called(call), called(call)), None)
        return make(call) if make else None

    def xy(self, call: ast.Call) -> list | None:
        """One argument is y, two are x and y."""
        if not call.args:
            return None
        first = self.value(call.args[0])
        return pairs(None, first) if len(call.args) == 1 else pairs(first, self.value(call.args[1]))

    def plot(self, call: ast.Call) -> dict | None:
        return chart(self.xy(call), "line", **XY)

    def step(self, call: ast.Call) -> dict | None:
        return chart(self.xy(call), {"type": "line", "interpolate": "step-after"}, **XY)

    def stem(self, call: ast.Call) -> dict | None:
        return chart(self.xy(call), {"type": "bar", "width": 2}, **XY)

    def stairs(self, call: ast.Call) -> dict | None:
        values = as_list(self.value.argument(call, 0))
        if values is None:
            return None
        edges = as_list(self.value.argument(call, 1, "edges"))
        middle = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)] if edges and len(edges) == len(values) + 1 else None
        return chart(pairs(middle, values), {"type": "line", "interpolate": "step-after"}, **XY)

    def _points(self, call: ast.Call) -> dict | None:
        x, y = self.value.argument(call, 0, "x"), self.value.argument(call, 1, "y")
        return None if x is None or y is None else chart(pairs(x, y), "point", **XY)

    errorbar = _points

    def scatter(self, call: ast.Call) -> dict | None:
        x, y, data = self.value.argument(call, 0, "x"), self.value.argument(call, 1, "y"), self.value.keyword(call, "data")
        if isinstance(x, str) and isinstance(y, str) and isinstance(data, dict) and as_list(data.get(x)) is not None and as_list(data.get(y)) is not None:
            return chart(pairs(data[x], data[y]), "point", **XY)
        return self._points(call)

    def bar(self, call: ast.Call) -> dict | None:
        x, y = self.value.argument(call, 0, "x"), self.value.argument(call, 1, "height")
        if x is None or y is None:
            return None
        along, up = {"field": "category", "type": "nominal"}, {"field": "value", "type": "quantitative"}
        return chart(pairs(x, y, "category", "value"), "bar", **({"x": up, "y": along} if called(call) == "barh" else {"x": along, "y": up}))

    def hist(self, call: ast.Call) -> dict | None:
        values = as_list(self.value.argument(call, 0))
        if values is None:
            return None
        bins = self.value.keyword(call, "bins")
        bin_ = {"maxbins": bins} if isinstance(bins, int) and not isinstance(bins, bool) else True
        return chart([{"value": v} for v in values], "bar", x={"field": "value", "type": "quantitative", "bin": bin_}, y={"aggregate": "count", "type": "quantitative"})

    def imshow(self, call: ast.Call) -> dict | None:
        at = len(call.args) - 1 if called(call) == "pcolormesh" and len(call.args) >= 3 else 0
        matrix = as_list(self.value.argument(call, at))
        if not matrix or not all(isinstance(row, list) for row in matrix):
            return None
        cells = [{"x": i, "y": j, "value": v} for j, row in enumerate(matrix) for i, v in enumerate(row)]
        return chart(cells, "rect", x="x:ordinal", y="y:ordinal", color="value:quantitative")

    def boxplot(self, call: ast.Call) -> dict | None:
        values = as_list(self.value.argument(call, 0))
        if values is None:
            return None
        groups = {f"group_{k}": g for k, g in enumerate(values, 1)} if values and all(isinstance(g, list) for g in values) else {"value": values}
        return chart([{"group": k, "value": v} for k, g in groups.items() for v in g], "boxplot", x="group:nominal", y="value:quantitative")

    def fill_between(self, call: ast.Call) -> dict | None:
        if len(call.args) < 2:
            return None
        x, low, high = (self.value.argument(call, k) for k in range(3))
        both = pairs(x, low)
        ends = as_list(high)
        if both is not None and ends is not None and len(ends) == len(both):
            return chart([{**r, "y2": v} for r, v in zip(both, ends, strict=True)], "area", **XY, y2={"field": "y2"})
        return chart(both, "area", **XY)

    def pie(self, call: ast.Call) -> dict | None:
        values = as_list(self.value.argument(call, 0))
        if values is None:
            return None
        names = as_list(self.value.keyword(call, "labels"))
        names = names if names is not None and len(names) == len(values) else [f"slice_{k}" for k in range(1, len(values) + 1)]
        return chart([{"category": str(n), "value": v} for n, v in zip(names, values, strict=True)], "arc", theta="value:quantitative", color="category:nominal")

    def stackplot(self, call: ast.Call) -> dict | None:
        x = as_list(self.value.argument(call, 0))
        if len(call.args) < 2 or x is None:
            return None
        ys = {k: as_list(self.value(a)) for k, a in enumerate(call.args) if k}
        rows = [{"x": a, "y": b, "series": f"series_{k}"} for k, y in ys.items() if y is not None for a, b in zip(x, y, strict=False)]
        return chart(rows or None, "area", x="x:quantitative", y={"field": "y", "type": "quantitative", "stack": True}, **SERIES)

    def named(self, calls: list[ast.Call]):
        return ((call, str(self.value.keyword(call, "label", f"series_{k}"))) for k, call in enumerate(calls, 1))

    def lines(self, calls: list[ast.Call]) -> dict | None:
        rows: list = []
        for call, name in self.named(calls):
            own = self.xy(call)
            if own is None:
                return None
            rows += [{**r, "series": name} for r in own]
        return chart(rows, "line", **XY, **SERIES)

    def scatters(self, calls: list[ast.Call]) -> dict | None:
        own = ((pairs(self.value.argument(c, 0, "x"), self.value.argument(c, 1, "y")), name) for c, name in self.named(calls))
        return chart([{**r, "series": name} for rows, name in own for r in rows or ()] or None, "point", **XY, **SERIES)

    def bars(self, calls: list[ast.Call]) -> dict | None:
        rows: list = []
        names: list | None = None
        for call, series in self.named(calls):
            x, y = (as_list(self.value.argument(call, k)) for k in (0, 1))
            if y is None or len(call.args) < 2:
                return None
            if names is None:
                names = x if x and all(isinstance(v, str) for v in x) else list(range(len(y)))
            if len(names) != len(y):
                return None
            rows += [{"category": n, "value": v, "series": series} for n, v in zip(names, y, strict=True)]
        return chart(rows, "bar", x="category:nominal", y="value:quantitative", **SERIES)

    def axis(self, calls: list[ast.Call]) -> dict | None:
        """X5."""
        kinds = {called(c) for c in calls}
        if len(calls) == 1:
            return self.one(calls[0])
        for only, several in (({"plot"}, self.lines), ({"bar"}, self.bars), ({"scatter"}, self.scatters)):
            if kinds == only:
                return several(calls)
        plots = [c for c in calls if called(c) == "plot"]
        if kinds == {"plot", "fill_between"}:
            return self.lines(plots) if len(plots) > 1 else self.one(plots[0])
        return next((s for s in map(self.one, calls) if s is not None), None)


def panel_of(axes: ast.AST) -> int | None:
    """The number in axs[2], axes[2], ax[2] or ax2."""
    match axes:
        case ast.Subscript(value=ast.Name(id="axs" | "axes" | "ax"), slice=ast.Constant(value=int(number))):
            return number
        case ast.Name(id=name) if name.startswith("ax") and name[2:].isdecimal():
            return int(name[2:])
    return None


def panels(tree: ast.AST, grid: tuple[int, int], charts: Charts) -> dict | None:
    """Two to six axes in one row or column, each with a chart."""
    rows, columns = grid
    if min(grid) > 1 or not 2 <= max(grid) <= 6:
        return None
    calls: dict[int, list] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and called(node) in PANEL_DRAWING and isinstance(node.func, ast.Attribute) and (at := panel_of(node.func.value)) is not None:
            calls.setdefault(at, []).append(node)
    specs = [charts.axis(calls[k]) for k in sorted(calls)]
    return {"hconcat" if columns > 1 else "vconcat": specs} if len(specs) >= 2 and None not in specs else None


def extract(code: str | None) -> dict | None:
    """The canonical spec of a script's chart, or None."""
    tree = parsed(code)
    if tree is None:
        return None
    value, drawn = Evaluator(), []
    for node in statements(tree):
        value.run(node, drawn)
    names: dict[str, Any] = {"title": None, "xlabel": None, "ylabel": None}
    grid: tuple[int, int] | None = None
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call):
            continue
        name = called(node) or ""
        what = name.removeprefix("set_")
        if what in names and node.args:
            names[what] = value(node.args[0]) or names[what]
        elif name == "set":
            names = {k: value.keyword(node, k, v) for k, v in names.items()}
        elif name == "subplots":
            sides = [value.keyword(node, n) or value.argument(node, k) or 1 for k, n in enumerate(("nrows", "ncols"))]
            grid = (int(sides[0]), int(sides[1])) if all(isinstance(s, (int, float)) for s in sides) else None
    if not drawn:
        return None
    charts = Charts(value)
    spec = charts.axis(drawn)
    if spec is None and grid is not None:
        spec = panels(tree, grid, charts)
    if spec is None:
        return None
    if names["title"]:
        spec["title"] = str(names["title"])
    for axis in ("x", "y"):  # X7
        if names[f"{axis}label"] and axis in spec.get("encoding", {}):
            spec["encoding"][axis]["title"] = str(names[f"{axis}label"])
    spec = canonical(spec)
    return spec if is_supported(spec) else None


def spec_of_sample(sample: dict) -> dict | None:
    """The first supported spec in a sample's spec fields, or else that of its code."""
    for key in SPEC_KEYS:
        if (spec := parse_spec(sample.get(key))) is not None and is_supported(spec):
            return canonical(spec)
    return extract(sample.get("code"))


def spec_of_code(code: str | None) -> str | None:
    """Code that is a spec itself, or the spec of the chart it draws."""
    spec = parse_spec(code) or extract(code)
    return canonical_text(spec, compact=True) if spec is not None else None


@batched("string")
def extract_udf(code: pd.Series) -> pd.Series:
    return code.map(lambda c: canonical_text(s, compact=True) if (s := extract(c)) is not None else None)


@batched("string")
def spec_of_code_udf(code: pd.Series) -> pd.Series:
    return code.map(spec_of_code)


@batched("string")
def _spec_of_samples(samples: pd.DataFrame) -> pd.Series:
    found = map(spec_of_sample, samples.to_dict("records"))
    return pd.Series([None if s is None else canonical_text(s, compact=True) for s in found], dtype=object)


def fill_specs(df: DataFrame) -> DataFrame:
    """Samples (code) with vega_spec: code that is a spec itself, or the spec of its chart; null where there is none."""
    return df.withColumn("vega_spec", spec_of_code_udf("code"))


def attach_specs(df: DataFrame) -> DataFrame:
    """Df with vega_lite_spec: the first supported spec among the spec columns it has, or that of its code."""
    names = [*(k for k in SPEC_KEYS if k in df.columns), "code"]

    return df.withColumn("vega_lite_spec", _spec_of_samples(F.struct(*(F.col(n).cast("string").alias(n) for n in names))))
