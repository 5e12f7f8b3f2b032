import pytest

from markloom.sources import relations, sinks


def test_scripts_and_samples(spark, tmp_path):
    (tmp_path / "s/d").mkdir(parents=True)
    (tmp_path / "s/d/a.py").write_text("x = 1\n")
    (tmp_path / "s/b.txt").write_text("no")
    got = relations.scripts(spark, f"file://{tmp_path}/s").collect()
    assert [(r.path.rsplit("/", 1)[1], r.code) for r in got] == [("a.py", "x = 1\n")]
    df = spark.createDataFrame([("i", "c", None), ("j", "d", '{"x":1.0}')], "image string, code string, vega_spec string")
    sinks.write_samples(df, f"file://{tmp_path}/j")
    sinks.write_samples(df.limit(1), f"file://{tmp_path}/j", append=True)
    assert relations.samples(spark, f"file://{tmp_path}/j").count() == 3
    (tmp_path / "k.json").write_text('{"image": "i", "vega_lite_spec": {"mark": "bar", "data": {"v": 1.0}}}\n')
    again = sinks.rewrite_samples(spark, f"file://{tmp_path}/k.json", f"file://{tmp_path}/l", lambda rows: rows.withColumn("code", rows.image))
    assert [(r.code, r.vega_lite_spec) for r in again.collect()] == [("i", '{"mark": "bar", "data": {"v": 1.0}}')]
    with pytest.raises(ValueError):
        sinks.rewrite_samples(spark, "a/", "a", lambda rows: rows)


def test_urls_and_inline(spark, tmp_path):
    (tmp_path / "t.CSV").write_text("a,b\n1,x\n")
    assert relations.from_url(spark, f"file://{tmp_path}/t.CSV").first().asDict() == {"a": 1, "b": "x"}
    rows = relations.without_nan(relations.inline(spark, [{"a": 1}, {"a": 2.5, "b": "x"}, {"a": float("nan")}])).collect()
    assert rows[2].a is None
    assert rows[0].asDict() == {"a": 1.0, "b": None}
    assert relations.inline(spark, []).count() == 0


def test_spec_and_error_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p/a.png", "{}"), (None, "{}"), ("b", None)], "image string, spec string")
    named = df.withColumn("name", sinks.spec_name(df.spec, df.image))
    assert [r.name for r in named.collect()] == ["a", "bf21a9e8fbc5", "b"]
    bar = '{"mark": "bar", "encoding": {}}'
    more = named.select("name", "spec").unionByName(spark.createDataFrame([(f"n{k}", bar) for k in range(40)], "name string, spec string"))
    sinks.write_specs(more, f"file://{tmp_path}/specs", 4)
    assert len(list((tmp_path / "specs").glob("bucket=*"))) == 4
    assert sinks.read_spec(spark, f"file://{tmp_path}/specs", "n7", 4) == bar and sinks.read_spec(spark, f"file://{tmp_path}/specs", "a", 4) is None
    done, skipped = sinks.converted_and_skipped(df)
    assert (done.count(), skipped.count()) == (2, 1)
    errors = spark.createDataFrame([(2, "e"), (1, "e"), (3, None), (4, "f")], "o long, error string")
    assert sorted(r.o for r in sinks.first_errors(errors, "error", "o").collect()) == [1, 4]


def test_run_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", True, 0.5), ("b", False, 0.0)], "image string, execution_success boolean, ssim double")
    sinks.write_run(df, f"file://{tmp_path}/run")
    results, every, good = relations.saved_run(spark, f"file://{tmp_path}/run")
    assert (results.count(), every.count(), good.count()) == (2, 2, 1)
