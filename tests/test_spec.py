import json

import pytest

from markloom.plans import spec as S
from markloom.plans.compile import compile_spec
from markloom.plans.filters import FilterError, string_filter

ROWS = [{"k": "a", "c": "u", "v": 1.0}, {"k": "a", "c": "w", "v": 3.0}, {"k": "b", "c": "u", "v": 5.0}, {"k": None, "c": "u", "v": 7.0}, {"k": "b", "c": "u", "v": None}]


def unit(mark, **encoding):
    return {"data": {"values": ROWS}, "mark": mark, "encoding": {k: v if isinstance(v, dict) else {"field": v} for k, v in encoding.items()}}


def table(spark, spec, *columns, **more):
    return sorted((tuple(r) for r in compile_spec(spark, spec, **more).df.select(*columns).collect()), key=str)


@pytest.mark.parametrize(
    "text",
    ['{"mark": "bar", "encoding": {}}', 'x\n```json\n{"mark": "bar", "encoding": {}}\n```', "{'mark': 'bar', 'encoding': {}}", 'so: {"mark": "bar", "encoding": {}} there', json.dumps('{"mark": "bar", "encoding": {}}'), '{"spec": {"mark": "bar", "encoding": {}}}', '{"no": {"mark": "bar", "encoding": {}}}'],
)
def test_parse_is_tolerant(text):
    assert S.parse_spec(text) == {"mark": "bar", "encoding": {}}


@pytest.mark.parametrize("text", ["", None, "[]", '{"mark": "bar"}', '{"mark": ', "prose"])
def test_parse_gives_none(text):
    assert S.parse_spec(text) is None


def test_parse_reads_a_literal_behind_prose():
    assert S.parse_spec("Here is the spec: {'mark': 'bar', 'encoding': {}}") == {"mark": "bar", "encoding": {}}
    # an object inside another one counts one level down, not deeper
    assert S.parse_spec({"spec": {"spec": {"mark": "bar", "encoding": {}}}}) is None


def test_inequality_and_negation_keep_rows_with_nulls(spark):
    rows = [{"v": 1.0, "w": "a"}, {"v": None, "w": "b"}, {"v": 3.0, "w": None}, {"v": float("nan"), "w": "c"}]
    for text, kept in (("datum.v != 3", 3), ("datum.v == 3", 1), ("!(datum.v > 2)", 3), ("datum.w != 'a'", 3), ("!(datum.w == 'a') && datum.v > 2", 1), ("!(datum.v != 3)", 1)):
        spec = {"data": {"values": rows}, "transform": [{"filter": text}], "mark": "tick", "encoding": {"x": {"field": "v"}}}
        assert compile_spec(spark, spec).df.count() == kept, text


def test_concat_children_are_independent(spark):
    child = {"mark": "tick", "encoding": {"x": {"field": "v"}}}
    own = {**child, "data": {"values": [{"v": 1}, {"v": 2}]}}
    spec = {"data": {"values": ROWS}, "hconcat": [child, own, {"mark": "nonsense", "encoding": {}, "data": {"values": ROWS}}, "no chart"]}
    with pytest.warns(UserWarning):
        chart = compile_spec(spark, spec)
    assert sorted(r.panel for r in chart.df.collect()) == [1, 1] and "error" in chart.meta["panels"][3]
    with pytest.raises(S.SpecError):
        compile_spec(spark, spec, strict=True)


def test_lines_keep_the_order_of_rows(spark):
    rows = [{"x": k % 7, "y": k, "c": "ab"[k % 2]} for k in range(40)]
    spec = {"data": {"values": rows}, "mark": "line", "encoding": {"x": {"field": "x"}, "y": {"field": "y"}, "color": {"field": "c"}}}
    for more in ({}, {"order_by": "y"}):
        got = compile_spec(spark, spec, **more).df.orderBy("ordinal").collect()
        assert [r.y for r in got] == list(range(40))


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_are_exact(spark, seed):
    import numpy as np

    from markloom.operators import marks

    rng = np.random.default_rng(seed)
    groups = {"a": rng.normal(size=101) * 10.0 ** rng.integers(-5, 6), "b": rng.integers(0, 3, 50).astype(float), "c": np.array([7.0]), "d": np.array([1e-9, -1e300, 1e300, -0.0]), "e": np.full(9, -2.5)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("f", None)], "k string, v double")
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.n, list(r.q)) for r in marks.quantiles(marks.value_counts(df, ["k"], "v"), ["k"], fractions).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k][0] == len(vs) and got[k][1] == pytest.approx(np.quantile(vs, fractions).tolist(), rel=1e-12)
    middle = {r.k: r.y for r in marks.medians(df, [df.k], "v").collect()}
    assert middle["f"] is None and middle["b"] == np.median(groups["b"])


def test_canonical_and_flatten():
    spec = {"mark": "bar", "b": [{"y": 1, "x": None}], "a": {}}
    assert S.canonical(S.canonical(spec)) == S.canonical(spec)
    assert json.loads(S.canonical_text(spec)) == spec
    assert S.flatten(spec) == {"mark": '"bar"', "b[0].y": "1", "b[0].x": "null"}
    assert S.flatten(3) == {"": "3"}


@pytest.mark.parametrize(
    "spec,kind",
    [
        ({"mark": "point"}, "scatter"),
        ({"mark": {"type": "line", "interpolate": "step-after"}}, "step"),
        ({"mark": "line", "encoding": {"color": {"field": "c"}}}, "multi-line"),
        ({"mark": "line"}, "line"),
        ({"mark": "bar", "encoding": {"y": {"bin": True}}}, "histogram"),
        ({"mark": "bar", "encoding": {"xOffset": {}}}, "grouped-bar"),
        ({"mark": "bar"}, "bar"),
        ({"mark": "rect"}, "heatmap"),
        ({"mark": "boxplot"}, "boxplot"),
        ({"mark": "arc"}, "pie"),
        ({"mark": "area"}, "area"),
        ({"mark": "tick"}, None),
        ({"layer": [{"mark": "line"}, {"mark": "line"}]}, "multi-line"),
        ({"layer": [{"mark": "rule"}, {"mark": "bar"}]}, "scatter"),
        ({"hconcat": [{"mark": "bar"}, {"mark": "tick"}]}, None),
        ({"hconcat": []}, None),
    ],
)
def test_kind(spec, kind):
    assert S.kind_of(spec) == kind


def test_aggregates_drop_null_keys_and_fill_absent_cells(spark):
    assert table(spark, unit("bar", x="k", y={"field": "v", "aggregate": "sum"}), "x", "y") == [("a", 4.0), ("b", 5.0)]
    assert table(spark, unit("bar", x="k", y={"field": "v", "aggregate": "count"}), "x", "y") == [("a", 2), ("b", 2)]
    assert table(spark, unit("bar", x="k", color="c", y={"field": "v", "aggregate": "mean"}), "x", "series", "y") == [("a", "u", 1.0), ("a", "w", 3.0), ("b", "u", 5.0), ("b", "w", 0.0)]


def test_raw_grouped_bar_keeps_first_appearance(spark):
    rows = [{"k": "z", "c": "q", "v": 1, "o": 0}, {"k": "a", "c": "p", "v": 2, "o": 1}, {"k": "z", "c": "q", "v": 5, "o": 2}]
    spec = {"data": {"values": rows}, "mark": "bar", "encoding": {"x": {"field": "k"}, "y": {"field": "v"}, "color": {"field": "c"}}}
    got = table(spark, spec, "x", "series", "y", "x_index", "position", order_by="o")
    assert got == [("a", "p", 2, 1, pytest.approx(1.2)), ("a", "q", 0, 1, pytest.approx(0.8)), ("z", "p", 0, 0, pytest.approx(0.2)), ("z", "q", 6, 0, pytest.approx(-0.2))]


def test_histogram_closes_the_last_bin_and_widens_a_flat_one(spark):
    spec = lambda vs: {"data": {"values": [{"v": v} for v in vs]}, "mark": "bar", "encoding": {"x": {"field": "v", "bin": {"maxbins": 2}}, "y": {"aggregate": "count"}}}
    assert table(spark, spec([0, 1, 2]), "bin", "y") == [(0, 1), (1, 2)]
    assert table(spark, spec([3, 3]), "x", "x2", "y") == [(2.5, 3.0, 0), (3.0, 3.5, 2)]


def test_heatmap_rejects_a_second_row_for_a_cell(spark):
    spec = {"data": {"values": [{"x": 1, "y": 1, "v": 1}] * 2}, "mark": "rect", "encoding": {"x": {"field": "x"}, "y": {"field": "y"}, "color": {"field": "v"}}}
    with pytest.raises(Exception, match="several rows"):
        compile_spec(spark, spec).df.collect()


def test_composition(spark):
    bar = unit("bar", x="k", y={"field": "v", "aggregate": "max"})
    assert table(spark, {"hconcat": [bar, bar]}, "panel", "x", "y") == [(0, "a", 3.0), (0, "b", 5.0), (1, "a", 3.0), (1, "b", 5.0)]
    faceted = {**bar, "encoding": {**bar["encoding"], "row": {"field": "c"}}}
    assert table(spark, faceted, "panel", "x", "y") == [("u", "a", 1.0), ("u", "b", 5.0), ("w", "a", 3.0)]
    layers = {"data": {"values": ROWS}, "layer": [{"mark": "tick", "encoding": {"x": {"field": "v"}}}, {k: v for k, v in bar.items() if k != "data"}]}
    assert compile_spec(spark, layers).df.where("layer = 0").count() == 5


def test_errors_and_passed_over_transforms(spark):
    with pytest.raises(S.SpecError):
        compile_spec(spark, unit("blob", x="k"))
    with pytest.raises(S.SpecError):
        compile_spec(spark, unit("point", x="k"))
    both = unit("bar", x="k", y="v", row="c", column="c")
    with pytest.raises(S.SpecError):
        compile_spec(spark, both)
    odd = {**unit("bar", x="k", y="v"), "transform": [{"calculate": "1", "as": "q"}]}
    with pytest.warns(UserWarning):
        assert compile_spec(spark, odd).df.count() == 5
    with pytest.raises(S.SpecError):
        compile_spec(spark, odd, strict=True)


def test_axes_are_metadata_and_do_not_filter(spark):
    made = compile_spec(spark, unit("point", x={"field": "v", "scale": {"type": "log", "domain": [2, 4]}, "title": ["a", "b"]}, y="v"))
    assert made.df.count() == 5
    assert made.meta["x"] == {"label": "a b", "log": True, "domain": (2, 4)}


@pytest.mark.parametrize("text,n", [("datum.v > 1 && datum.v < 6", 2), ("datum.v == 1 || datum.v == 5", 2), ("!(datum['v'] > 1)", 2), ("datum.v * 2 + 1 >= 7", 3), ("datum.k == 'a'", 2)])
def test_filter_grammar(spark, text, n):
    spec = {**unit("tick", x="v"), "transform": [{"filter": text}]}
    assert compile_spec(spark, spec).df.count() == n


@pytest.mark.parametrize("text", ["__import__('os')", "datum.v >", "datum.v ; 1", "f(1)"])
def test_filter_rejects_other_code(spark, text):
    with pytest.raises((FilterError, IndexError)):
        string_filter(text)


def test_filter_reaches_the_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    spec = {"data": {"name": "l"}, "transform": [{"filter": "datum.l_quantity > 10"}], "mark": "bar", "encoding": {"x": {"field": "l_returnflag"}, "y": {"field": "l_extendedprice", "aggregate": "sum"}}}
    df = compile_spec(spark, spec, {"l": lines}).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan


def test_nan_is_missing(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", float("nan"))], "k string, v double")
    spec = {"data": {"name": "r"}, "mark": "bar", "encoding": {"x": {"field": "k"}, "y": {"field": "v", "aggregate": "sum"}}}
    assert table(spark, spec, "x", "y", sources={"r": rows}) == [("a", 1.0), ("b", 0.0)]
    above = {**spec, "transform": [{"filter": "datum.v > 0"}]}
    assert table(spark, above, "x", "y", sources={"r": rows}) == [("a", 1.0)]
