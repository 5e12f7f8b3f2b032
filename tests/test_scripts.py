import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.functions import images, metrics, pycode, scripts
from markloom.operators import augment, corpus, dataset, extract, report

GOOD = "import numpy as np\nimport matplotlib.pyplot as plt\nplt.plot([1, 2], [3, 4])\n"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<double>'}" for k, v in values.items()))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "code,reason",
    [
        (GOOD, None),
        ("  \n", "blank"),
        ("#" * 18001, "long"),
        (GOOD + "import argparse", "complex"),
        (GOOD + "open('x')", "external"),
        (GOOD + "import torch", "imports"),
        (GOOD + "plt.pause(1)", "blocking"),
        (GOOD + "sns.relplot()", "seaborn"),
        ("x = 1", "no plot"),
        ("plt.plot(", "no plot"),
        (GOOD + "plt.subplots()\nplt.subplot(1)", "axes"),
    ],
)
def test_skip_reasons(spark, code, reason):
    df = spark.createDataFrame([(code,)], "code string").withColumn("f", pycode.script_facts("code"))
    assert df.select(corpus.skip_reason(F.col("code"), F.col("f"))).first()[0] == reason


def test_facts():
    got = pycode.facts("from . import x\nimport a.b\nf()\nax.plot()\nax.plot()\nplt.show(block=True)")
    assert got["calls"] == ["f", "plot", "show"] and got["method_calls"] == ["plot", "plot", "show"] and got["imports"] == ["a"] and got["blocking"]
    assert pycode.facts("input(")["blocking"] and not pycode.facts("x(")["blocking"]


def test_comments_and_repair():
    assert pycode.remove_comments('a = "#1"  # c\n\n\n\n# d\n"""doc"""\nb = 2') .split() == ["a", "=", '"#1"', "b", "=", "2"]
    assert pycode.repair("a = 1\nb = 2\nc = (") == "a = 1\nb = 2"
    assert pycode.repair("a = (\nb\nc") == "a = (\nb\nc"
    assert pycode.repair(None) == ""


def test_repair_finds_the_longest_run():
    code = "import a\nfor i in x:\n    y = f(i,\n          2)\n    if y:\n        s = \"\"\"p\nq\"\"\"\n\nz = {\n  1: 2,\n}\nw = [k\n  for k in z]\ndef g():\n    return 1\ntry:\n    g()\nfinally:\n    h()"
    for end in range(1, len(code)):
        for least in (0.1, 0.6):
            cut = code[:end].strip()
            lines = [x for x in cut.splitlines() if x.strip()]
            runs = [r for n in range(max(1, int(len(lines) * least)), len(lines)) if pycode.parsed(r := "\n".join(lines[:n]).rstrip()) is not None]
            assert pycode.repair(code[:end], least) == (cut if pycode.parsed(cut) is not None else runs[-1] if runs else cut)


@pytest.mark.parametrize("text,code", [("assistant\n```python\nx\n```\n```\ny\n```", "y"), (" z ", "z"), (None, ""), ("model\nq", "q")])
def test_extract_code(spark, text, code):
    assert one(spark, scripts.extract_code(F.col("t")), t=text) == code


def test_imports_and_backend(spark):
    assert one(spark, scripts.ensure_imports(F.col("t")), t="np.pi") == "import numpy as np\nnp.pi"
    assert one(spark, scripts.for_execution(F.col("t")), t="x = 1 ") == "import matplotlib\nmatplotlib.use('Agg')\nx = 1\nplt.show()\n"
    for code in ("np.pi\nplt.show()", "x = 1 ", "pd.x; sns.y"):
        assert one(spark, scripts.for_execution(F.col("t")), t=code) == augment.runnable(code)


@pytest.mark.parametrize(
    "code,kind,n",
    [
        ("plt.plot([1, 2], [3, 4])", "line", 2),
        ("x = np.linspace(0, 1, 5)\nplt.plot(x, np.sin(x) * 2)", "line", 5),
        ("plt.plot([1]); plt.plot([2, 3])", "multi-line", 3),
        ("ax.scatter(x=[1], y=[2])", "scatter", 1),
        ("d = {'a': [1, 2], 'b': [3, 4]}\nplt.scatter('a', 'b', data=d)", "scatter", 2),
        ("plt.bar(['a', 'b'], [1, 2])", "bar", 2),
        ("plt.bar(['a'], [1])\nplt.bar(['a'], [2])", "grouped-bar", 2),
        ("plt.hist([1, 2, 2], bins=4)", "histogram", 3),
        ("plt.imshow([[1, 2], [3, 4]])", "heatmap", 4),
        ("plt.boxplot([[1, 2], [3]])", "boxplot", 3),
        ("plt.fill_between([1, 2], [0, 1], [2, 3])", "area", 2),
        ("plt.pie([1, 2], labels=['a', 'b'])", "pie", 2),
        ("plt.step([1, 2], [3, 4])", "step", 2),
        ("plt.stairs([1, 2], [0, 1, 2])", "step", 2),
        ("plt.stackplot([1, 2], [1, 2], [3, 4])", "area", 4),
        ("plt.errorbar([1], [2])", "scatter", 1),
        ("for i in range(3):\n    ax.plot([1, 2])", "multi-line", 4),
    ],
)
def test_extract(code, kind, n):
    from markloom.plans.spec import kind_of

    spec = extract.extract(code)
    assert kind_of(spec) == kind and len(spec["data"]["values"]) == n


def test_extract_subplots_labels_and_limits():
    spec = extract.extract("fig, axs = plt.subplots(1, 2)\naxs[0].semilogy([1])\naxs[0].plot([1, 2])\naxs[1].bar(['a'], [1])")
    assert spec is not None
    spec = extract.extract("plt.plot([1, 2])\nplt.title('T')\nplt.xlabel('X')")
    assert spec["title"] == "T" and spec["encoding"]["x"]["title"] == "X"
    for code in ("plt.loglog([1])", "plt.plot(np.zeros(10**12))", "plt.plot([9**9**9])", "plt.plot(", "x = 1", None):
        assert extract.extract(code) is None
    assert len(extract._arange([0, 1, 0.1])) == 11
    a = extract.extract("plt.plot(np.random.rand(3))\nplt.plot(np.random.rand(3))")["data"]["values"]
    assert [r["y"] for r in a[:3]] == [r["y"] for r in a[3:]]


def test_augment_is_seeded_and_valid():
    code = GOOD.replace("[3, 4])", "[3, 4], color='red', alpha=0.5)")
    first = [augment.augmented(code, random.Random(augment.variant_seed("p", v, 0))) for v in range(5)]
    assert first == [augment.augmented(code, random.Random(augment.variant_seed("p", v, 0))) for v in range(5)]
    assert all(c and pycode.compiles(c) and c != code for c in first) and len(set(first)) > 1


def test_augment_parts():
    assert augment.colors("color='r', c=\"b\", color='tab:x'") == ["r", "b"]
    assert augment.map_colors("color='r'", {"r": "g"}) == "color='g'"
    assert augment.fix_legends("ax.legend(ncol=2, loc='nowhere')  # é") == "ax.legend(ncol=2, loc='upper right')  # é"
    assert augment.fix_legends("ax.legend(loc='best')") == "ax.legend(loc='best')"
    assert augment.fix_legends("fig.legend(loc='best')") == "fig.legend(loc='upper right')"
    assert augment.clamp_alpha("alpha=1.5") == "alpha=1.0"
    assert augment.clamp_alpha("é = plot(x, alpha=-2, beta=3)") == "é = plot(x, alpha=0.0, beta=3)"
    assert augment.drop_unsupported("f(a, hatchcolor='r')") == "f(a)"
    assert augment.insert("ax.plot(x)", "m=1") == "ax.plot(x, m=1)"
    assert augment.insert("t = 'é'; ax.plot('ü', (x),  # why, é\n)", "m=1") == "t = 'é'; ax.plot('ü', (x),  # why, é\nm=1)"
    assert augment.insert("plot()", "m=1") == "plot(m=1)" and augment.insert("plot((", "m=1") == "plot(("
    assert augment.with_keyword("sns.set_theme(style=f(1, 2), x=3)", "sns.set_theme", "style", "'w'") == "sns.set_theme(style='w', x=3)"
    assert augment.with_keyword("sns.set_theme()", "sns.set_theme", "style", "'w'") == "sns.set_theme(style='w')"
    assert augment.color_maps([], random.Random(0)) == [] and augment.color_maps(list("abcdefghijk"), random.Random(0)) == []
    assert len(augment.pool("scatter(")) == len(augment.pool("")) + 1


def sequential(rows):
    a, b, out = set(), set(), []
    for o, x, y in sorted(rows):
        if x is not None and x not in a and (y is None or y not in b):
            out.append(o)
            a.add(x)
            b.add(y) if y is not None else None
    return out


@pytest.mark.parametrize("finish_rows", [0, 5, 1000])
def test_two_key_dedup_is_the_sequential_one(spark, finish_rows):
    rng = random.Random(3)
    for n in (0, 3, 60):
        rows = [(i, rng.choice([None, *map(str, range(9))]), rng.choice([None, *map(str, range(9))])) for i in range(n)]
        df = spark.createDataFrame(rows, "o long, a string, b string")
        assert sorted(r.o for r in corpus.two_key_dedup(spark, df, "a", "b", "o", finish_rows).collect()) == sequential(rows)
    chain = spark.createDataFrame([(1, "i1", "c1"), (2, "i2", "c1"), (3, "i2", "c2")], "o long, a string, b string")
    assert sorted(r.o for r in corpus.two_key_dedup(spark, chain, "a", "b", "o", finish_rows).collect()) == [1, 3]


def test_two_key_dedup_ends_long_chains(spark):
    rows = [(k, f"a{(k + 1) // 2}", f"b{k // 2}") for k in range(500)]
    got = corpus.two_key_dedup(spark, spark.createDataFrame(rows, "o long, a string, b string"), "a", "b", "o", 490)
    assert sorted(r.o for r in got.collect()) == sequential(rows)


def test_streaming_dedup(spark, tmp_path, monkeypatch):
    from markloom.streaming.dedup import append_unique

    schema = "o long, a string, b string"
    monkeypatch.setattr("markloom.streaming.dedup.COMPACT", 2)
    for k, rows in enumerate([[(1, "x", "p"), (2, "x", "q")], [(3, "y", "p"), (4, "z", "r")], [(5, "x", "s"), (6, "w", "r"), (7, "v", None), (8, "u", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"file://{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in/*")
        append_unique(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/c", "a", "b", "o").awaitTermination()
    assert sorted(r.o for r in spark.read.json(f"file://{tmp_path}/out/*").collect()) == [1, 4, 7, 8]
    assert sorted(x.name for x in (tmp_path / "out_keys").iterdir()) == ["batch=0", "batch=1", "batch=2", "upto=1"]


def test_good_variants(spark):
    rows = [("p", 0, 0, "c1", "s1", False, True, "s0"), ("p", 0, 1, "c1", "s2", False, True, "s0"), ("p", 0, 2, "c2", "s1", False, True, "s0"), ("p", 1, 0, "c3", "s0", False, True, "s0"), ("p", 1, 1, "c4", None, False, True, "s0"), ("p", 1, 2, "c5", "s5", False, False, "s0")]
    # a code whose first image isn't taken may come again, and a dull image makes nothing seen
    rows += [("p", 2, 0, "c6", "s6", True, True, None), ("p", 2, 1, "c6", "s6", False, True, None), ("p", 2, 2, "c7", "s7", False, True, None)]
    df = spark.createDataFrame(rows, "path string, variant_idx int, attempt_idx int, code_sig string, image_sig string, low_information boolean, different boolean, original_sig string")
    assert sorted((r.variant_idx, r.attempt_idx) for r in corpus.good_variants(df).collect()) == [(0, 0), (2, 1), (2, 2)]


def test_metrics():
    assert metrics.edit_similarity("abc", "abc") == 1.0
    assert metrics.bleu("a b c d", "a b c d") == pytest.approx(1.0) and metrics.bleu("a", "b") == 0.0 and metrics.bleu("a", "") == 0.0
    spec = '{"mark": "bar", "encoding": {"x": {"field": "a"}}}'
    assert set(metrics.ir_scores(spec, spec).values()) == {True, 1.0}
    assert metrics.ir_scores(spec, None)["ir_tree_similarity"] == 0.0


def test_overlap_and_scores(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"], False), ([], ["a"], True)], "r array<string>, g array<string>, ok boolean")
    got = df.select(metrics.call_overlap(F.col("r"), F.col("g")).alias("o"), metrics.on_success(F.col("ok"), F.lit(0.7)).alias("s")).collect()
    assert (got[0].o.api_sim, got[0].o.jaccard, got[0].o.missed, got[0].o.extra, got[0].s) == (0.5, pytest.approx(1 / 3), ["b"], ["c"], 0.0)
    assert (got[1].o.api_sim, got[1].s) == (0.0, 0.7)


def test_images(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (60, 70)).astype(float)
    assert images.ssim(a, a) == pytest.approx(1.0) and not images.is_different(a, a + 0.0)
    assert images.is_different(a, 255 - a) and images.is_different(a[:3], a)
    assert len(images.signature(a)) == 256 and images.signature(None) is None
    df = spark.createDataFrame([([[0] * 60] * 60,), ([[int(v) for v in r] for r in a],), (None,), ([[1] * 49] * 60,)], "pixels array<array<int>>")
    got = [(r.low_information, r.good_enough) for r in corpus.image_facts(df).collect()]
    assert got == [(True, False), (False, True), (True, False), (True, False)]


def test_split_is_exact(spark):
    got = corpus.exact_split(spark.range(1003), "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 601, "test": 402}
    some = spark.range(10).selectExpr("if(id < 4, null, id) as id")
    got = corpus.exact_split(some, "id").collect()
    assert sorted(r.split for r in got) == ["test"] * 4 + ["train"] * 6 and {r.split for r in got if r.id is None} == {"test"}


def test_conversations(spark):
    spec = '{"mark":"bar","encoding":{}}'
    rows = [("i", "c", None), ("j", "c", spec), ("k", None, None), (None, "c", None), ("l", "c" * 4000, None)]
    df = spark.createDataFrame(rows, "image string, code string, vega_spec string")
    told = dataset.conversations(df, {"spec": "S", "code": "C"})
    assert "ordinal" in told.columns and dataset.conversations(df.withColumn("ord", F.lit(7)), {"spec": "S", "code": "C"}, "ord").first().ordinal == 7
    kept = dataset.with_drop_reason(told, "S", most_tokens=5000, count_tokens=lambda texts: [len(t) for t in texts])
    few = dataset.with_drop_reason(told, "S", most_tokens=4, count_tokens=lambda texts: [len(t) // (t[0] == "C") for t in texts])
    assert {r.image: r.drop_reason for r in few.collect()} == {"i": None, "j": None, "l": "code length"}
    third = told.withColumn("messages", F.concat("messages", F.array(F.element_at("messages", 1))))
    assert {r.image: r.drop_reason for r in dataset.with_drop_reason(third, "S").collect()}["l"] == "code length"
    got = {r.image: (r.instruction, len(r.target_text), r.drop_reason) for r in kept.collect()}
    assert got == {"i": ("C", 1, None), "j": ("S", len('{"encoding":{},"mark":"bar"}'), None), "l": ("C", 4000, "code length")}
    assert told.select(dataset.first_of(F.col("messages"), "text")).first()[0] == "C"


def test_generated_code(spark):
    df = spark.createDataFrame([("```python\nx = 1\n```", "code"), ('{"mark": "bar", "data": {}}', "spec"), ("no", "spec")], "t string, k string")
    got = [r[0] for r in df.select(dataset.generated_code(F.col("t"), F.col("k"))).collect()]
    assert got[0] == "x = 1" and got[1].startswith("raise RuntimeError('the chart spec") and got[2] == "raise RuntimeError('no chart spec in the output')"
    pair = spark.createDataFrame([('{"mark": "tick", "data": {"values": [{"a": 1}]}, "encoding": {"x": {"field": "a"}}}', None), (None, "c")], "v string, c string")
    got = [r[0] for r in pair.select(dataset.reference_code(F.col("v"), F.col("c"))).collect()]
    assert "AX" not in got[0] and "scatter" in got[0] and got[1] == "c"


def test_loss(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.5), (3, 0.5), (4, 1.0), (5, None)], "step long, loss double")
    row = report.loss_summary(df).first()
    assert (row.first_loss, row.last_loss, row.min_loss, row.min_step, row.n_points, row.reduction_pct) == (2.0, 1.0, 0.5, 2, 4, 50.0)
    fit = spark.createDataFrame([(x, 2.0 * x * x - 3 * x + 1) for x in range(6)], "step long, loss double")
    assert report.quadratic_trend(fit) == pytest.approx((2.0, -3.0, 1.0))


def test_compare_with_an_empty_run(spark):
    schema = "run string, execution_success boolean, " + ", ".join(f"{m} double" for m in report.METRICS)
    df = spark.createDataFrame([("a", True, *[0.5] * 6), ("b", False, *[0.0] * 6)], schema)
    got = {r.metric: (r.base, r.new, r.relative) for r in report.compare(df, "a", "b").collect()}
    assert got["ssim"] == (0.5, 0.0, -100.0) and got["success_rate"] == (1.0, 0.0, -100.0)
    assert report.run_summary(df).where("run = 'a'").first().std_ssim is None


def test_specs_of_samples(spark):
    spec = '{"mark":"bar","encoding":{}}'
    rows = [("plt.plot([1, 2])", None, spec), (spec, None, None), ("x = 1", '{"mark":"tick","data":{}}', None)]
    df = spark.createDataFrame(rows, "code string, vega_spec string, spec string")
    got = extract.attach_specs(df).select("vega_lite_spec").collect()
    assert got[0][0] == '{"encoding":{},"mark":"bar"}' and got[1][0] is None and got[2][0] is None
    filled = [r.vega_spec for r in extract.fill_specs(df.select("code")).collect()]
    assert '"line"' in filled[0] and filled[1] == '{"encoding":{},"mark":"bar"}' and filled[2] is None


def test_running_sums_and_maps(spark):
    from markloom.functions import arrays

    rng = np.random.default_rng(0)
    rows = [(n, rng.normal(size=n).tolist()) for n in (0, 1, 63, 64, 65, 300)]
    got = spark.createDataFrame(rows, "n int, xs array<double>").select("n", arrays.cumsum(F.col("xs")).alias("c")).collect()
    assert {r.n: list(r.c) for r in got} == {n: np.cumsum(xs).tolist() for n, xs in rows}
    one = spark.range(1).select(
        arrays.smallest(F.array(F.lit(1.0), F.lit(float("nan")))).alias("s"),
        arrays.log10(F.lit(-1.0)).alias("l"),
        arrays.mapping(F.array(*map(F.lit, "abab")), F.array(*map(F.lit, range(4)))).alias("m"),
    ).first()
    assert np.isnan(one.s) and np.isnan(one.l) and one.m == {"a": 2, "b": 3}
