"""Scripts made from specs compile, and call the plotting library with the chart's values (a recorder stands in for it)."""

import sys
import types

import pytest

from markloom.plans.script import script_or_stub, to_script
from markloom.plans.spec import SpecError

ROWS = [{"k": "a", "c": "u", "v": 1}, {"k": "a", "c": "w", "v": 3}, {"k": "b", "c": "u", "v": 5}, {"k": None, "c": "u", "v": 7}]


def drawn(spec):
    calls = []

    class Axis:
        def __getattr__(self, name):
            return lambda *a, **k: calls.append((name, a))

    class Grid:
        def __init__(self, n):
            self.flat = [Axis() for _ in range(n)]

    def subplots(rows=1, columns=1, squeeze=True):
        return None, (Axis() if squeeze else Grid(rows * columns))

    plt = types.ModuleType("matplotlib.pyplot")
    plt.subplots, plt.tight_layout, plt.show = subplots, lambda: None, lambda: None
    package = types.ModuleType("matplotlib")
    package.pyplot = plt
    saved = {n: sys.modules.get(n) for n in ("matplotlib", "matplotlib.pyplot")}
    sys.modules |= {"matplotlib": package, "matplotlib.pyplot": plt}
    try:
        exec(compile(to_script(spec), "<made>", "exec"), {})  # our own text over literal data
    finally:
        for n, m in saved.items():
            sys.modules.pop(n) if m is None else sys.modules.__setitem__(n, m)
    return calls


def unit(mark, **encoding):
    return {"data": {"values": ROWS}, "mark": mark, "encoding": {k: v if isinstance(v, dict) else {"field": v} for k, v in encoding.items()}}


def first(spec):
    return next((name, args) for name, args in drawn(spec) if not name.startswith("set_"))


@pytest.mark.parametrize(
    "spec,call",
    [
        (unit("bar", x="k", y={"field": "v", "aggregate": "sum"}), ("bar", (["a", "b"], [4, 5]))),
        (unit("bar", y="k", x={"aggregate": "count"}), ("barh", (["a", "b"], [2, 1]))),
        (unit("bar", x="c", y="v"), ("bar", (["u", "w", "u", "u"], [1, 3, 5, 7]))),
        (unit("bar", x={"field": "v", "bin": {"maxbins": 3}}, y={"aggregate": "count"}), ("hist", ([1, 3, 5, 7],))),
        (unit("line", x="v", y="v"), ("plot", ([1, 3, 5, 7], [1, 3, 5, 7]))),
        (unit("point", x="v", y="v", color="k"), ("scatter", ([1, 3], [1, 3]))),
        (unit("area", x="v", y="v"), ("fill_between", ([1, 3, 5, 7], [1, 3, 5, 7], 0))),
        (unit("tick", x="v"), ("scatter", ([1, 3, 5, 7], [0, 0, 0, 0]))),
        (unit("arc", theta="v"), ("pie", ([1, 3, 5, 7],))),
        (unit("boxplot", y="v", x="c"), ("boxplot", ([[1, 5, 7], [3]],))),
        ({**unit("tick", x="v"), "transform": [{"filter": "datum.v > 1 && !(datum.k == 'b')"}]}, ("scatter", ([3, 7], [0, 0]))),
        ({**unit("tick", x="v"), "transform": [{"filter": {"field": "v", "range": [2, 5], "oneOf": [3, 9]}}]}, ("scatter", ([3], [0]))),
    ],
)
def test_calls(spec, call):
    assert first(spec) == call


def test_grouped_bars_fill_absent_cells():
    calls = [a for n, a in drawn(unit("bar", x="k", color="c", y={"field": "v", "aggregate": "mean"})) if n == "bar"]
    assert [list(a[1]) for a in calls] == [[1, 5], [3, 0]]


def test_composition():
    bar = unit("bar", x="k", y={"field": "v", "aggregate": "max"})
    assert [n for n, _ in drawn({"vconcat": [bar, bar]}) if n == "bar"] == ["bar", "bar"]
    faceted = {**bar, "encoding": {**bar["encoding"], "column": {"field": "c"}}}
    assert [a for n, a in drawn(faceted) if n == "bar"] == [(["a", "b"], [1, 5]), (["a"], [3])]


def test_what_cannot_be_drawn():
    with pytest.raises(SpecError):
        to_script(unit("blob", x="k"))
    assert script_or_stub("x").startswith("raise") and script_or_stub(unit("rect", x="k")).startswith("raise")
    assert "passed over" in to_script({**unit("tick", x="v"), "transform": [{"fold": ["a"]}]})
