"""The catalogue: queries over the engine's operators with equal DuckDB SQL where SQL can say it."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays, images, metrics, pycode, scripts
from .operators import augment, corpus, dataset, extract, marks, overlap, report
from .plans.compile import compile_spec
from .sources import relations, sinks
from .sources.shared import own_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


def chart(name: str, tables: str | tuple[str, ...], spec: dict, sql: str, columns: list[str], round_to: dict[str, int] | None = None, order_by: str | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """A query that compiles a spec over tables and gives the named columns of its mark table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = {t: prepare(table(spark, sf_dir, t)) for t in ((tables,) if isinstance(tables, str) else tables)}
        df = compile_spec(spark, json.dumps(spec), sources, order_by=order_by).df.select(*columns)
        return df.withColumns({n: F.round(F.col(n), p) for n, p in (round_to or {}).items()})

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = run, sql


def f(name: str, **more) -> dict:
    return {"field": name, **more}


# --- bars -----------------------------------------------------------------------------------------------------------

chart(
    "bar_sum_filtered",
    "lineitem",
    {"data": {"name": "lineitem"}, "transform": [{"filter": "datum.l_quantity > 10"}], "mark": "bar", "encoding": {"x": f("l_returnflag"), "y": f("l_extendedprice", aggregate="sum")}},
    "SELECT l_returnflag AS x, round(sum(l_extendedprice), 2) AS y FROM lineitem WHERE l_quantity > 10 GROUP BY 1",
    ["x", "y"],
    {"y": 2},
)
for _agg, _sql in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"), ("count", "count")):
    chart(
        f"bar_{_agg}",
        "lineitem",
        {"data": {"name": "lineitem"}, "mark": "bar", "encoding": {"x": f("l_linestatus"), "y": f("l_extendedprice", aggregate=_agg)}},
        f"SELECT l_linestatus AS x, {f'round({_sql}(l_extendedprice), 4)' if _agg != 'count' else 'count(*)'} AS y FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1",
        ["x", "y"],
        {"y": 4} if _agg != "count" else None,
    )
chart(
    "bar_horizontal",
    "orders",
    {"data": {"name": "orders"}, "mark": "bar", "encoding": {"x": f("o_totalprice", aggregate="mean"), "y": f("o_orderpriority")}},
    "SELECT o_orderpriority AS y, round(avg(o_totalprice), 4) AS x FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1",
    ["x", "y"],
    {"x": 4},
)
chart(
    "grouped_bar_agg",
    "orders",
    {"data": {"name": "orders"}, "mark": "bar", "encoding": {"x": f("o_orderstatus"), "y": f("o_totalprice", aggregate="sum"), "color": f("o_orderpriority")}},
    """WITH c AS (SELECT o_orderstatus x, o_orderpriority series, sum(o_totalprice) y FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2)
    SELECT a.x, b.series, round(coalesce(c.y, 0), 2) AS y FROM (SELECT DISTINCT x FROM c) a CROSS JOIN (SELECT DISTINCT series FROM c) b LEFT JOIN c ON c.x = a.x AND c.series = b.series""",
    ["x", "series", "y"],
    {"y": 2},
)
chart(
    "grouped_bar_raw",
    "lineitem",
    {"data": {"name": "lineitem"}, "mark": "bar", "encoding": {"x": f("l_returnflag"), "y": f("l_quantity"), "color": f("l_linestatus")}},
    """WITH r AS (SELECT l_returnflag x, l_linestatus series, l_quantity v, l_orderkey o FROM lineitem),
    c AS (SELECT x, series, sum(v) y FROM r GROUP BY 1, 2),
    xs AS (SELECT x, row_number() OVER (ORDER BY min(o)) - 1 AS i FROM r GROUP BY x), ss AS (SELECT series, row_number() OVER (ORDER BY min(o)) - 1 AS j, count(*) OVER () AS k FROM r GROUP BY series)
    SELECT xs.x, ss.series, coalesce(c.y, 0) AS y, CAST(i AS INTEGER) AS x_index, CAST(j AS INTEGER) AS series_index, round(i + j * (0.8 / k) - 0.4 + 0.8 / k / 2, 6) AS position FROM xs CROSS JOIN ss LEFT JOIN c ON c.x = xs.x AND c.series = ss.series""".replace("l_orderkey o", "CAST(l_orderkey AS BIGINT) * 1000 + l_linenumber * 10 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END o"),
    ["x", "series", "y", "x_index", "series_index", "position"],
    {"position": 6},
    order_by="__order",
    prepare=lambda rows: rows.withColumn("__order", F.col("l_orderkey").cast("long") * 1000 + F.col("l_linenumber") * 10 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)),
)
chart("bar_raw", "nation", {"data": {"name": "nation"}, "mark": "bar", "encoding": {"x": f("n_name"), "y": f("n_regionkey")}}, "SELECT n_name AS x, n_regionkey AS y FROM nation", ["x", "y"])

# --- histograms -----------------------------------------------------------------------------------------------------


def _histogram_sql(table_: str, column: str, n: int) -> str:
    return f"""WITH v AS (SELECT CAST({column} AS DOUBLE) v FROM {table_} WHERE {column} IS NOT NULL),
    e AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END hi FROM v),
    b AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / {n})), {n - 1}) AS INTEGER) bin, count(*) y FROM v, e GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / {n}), 6) AS x, round(lo + (i + 1) * ((hi - lo) / {n}), 6) AS x2, coalesce(y, 0) AS y FROM e CROSS JOIN range({n}) t(i) LEFT JOIN b ON b.bin = i"""


for _name, _table, _column, _bins in (("histogram_20", "lineitem", "l_quantity", 20), ("histogram_default", "events", "value", None)):
    chart(
        _name,
        _table,
        {"data": {"name": _table}, "mark": "bar", "encoding": {"x": f(_column, bin={"maxbins": _bins} if _bins else True), "y": {"aggregate": "count"}}},
        _histogram_sql(_table, _column, _bins or 10),
        ["bin", "x", "x2", "y"],
        {"x": 6, "x2": 6},
    )

# --- points, lines, cells, boxes, wedges ------------------------------------------------------------------------------

chart(
    "scatter_sized",
    "part",
    {"data": {"name": "part"}, "mark": "circle", "encoding": {"x": f("p_size"), "y": f("p_retailprice"), "size": f("p_retailprice"), "opacity": f("p_size"), "color": f("p_brand")}},
    """SELECT p_size AS x, p_retailprice AS y, round(p_retailprice / greatest(1, max(p_retailprice) OVER ()) * 200 + 8, 6) AS size,
    round(least(greatest(p_size / greatest(1.0, CAST(max(p_size) OVER () AS DOUBLE)), 0.0), 1.0), 6) AS opacity, p_brand AS series FROM part WHERE p_brand IS NOT NULL""",
    ["x", "y", "size", "opacity", "series"],
    {"size": 6, "opacity": 6},
)
chart("line_multi", "events", {"data": {"name": "events"}, "mark": "line", "encoding": {"x": f("event_id"), "y": f("value"), "color": f("event_type")}}, "SELECT event_id AS x, value AS y, event_type AS series FROM events WHERE event_type IS NOT NULL", ["x", "y", "series"])
chart("area_baseline", "events", {"data": {"name": "events"}, "mark": "area", "encoding": {"x": f("event_id"), "y": f("value")}}, "SELECT event_id AS x, value AS y, 0 AS baseline FROM events", ["x", "y", "baseline"])
chart("tick_marks", "events", {"data": {"name": "events"}, "mark": "tick", "encoding": {"x": f("value")}}, "SELECT value AS x, 0 AS y FROM events", ["x", "y"])
chart(
    "boxplot_stats",
    "orders",
    {"data": {"name": "orders"}, "mark": "boxplot", "encoding": {"x": f("o_orderstatus"), "y": f("o_totalprice")}},
    """WITH q AS (SELECT o_orderstatus x, count(*) n, quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.5) m, quantile_cont(o_totalprice, 0.75) q3 FROM orders GROUP BY 1)
    SELECT x, n, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
    max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (o_totalprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM orders JOIN q ON x = o_orderstatus GROUP BY ALL""",
    ["x", "n", "q1", "median", "q3", "low", "high", "n_outliers"],
    {"q1": 4, "median": 4, "q3": 4},
)


@query("SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS value FROM lineitem GROUP BY 1, 2")
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return compile_spec(spark, {"data": {"name": "cells"}, "mark": "rect", "encoding": {"x": f("l_returnflag"), "y": f("l_linestatus"), "color": f("n")}}, {"cells": cells}).df


@query("WITH n AS (SELECT r_name, count(*) c FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1) SELECT r_name AS series, c AS value, round(c / sum(c) OVER (), 6) AS share FROM n")
def pie_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("c"))
    return rounded(compile_spec(spark, {"data": {"name": "n"}, "mark": "arc", "encoding": {"theta": f("c"), "color": f("r_name")}}, {"n": nations}).df, "share", places=6)


# --- composition and filters ------------------------------------------------------------------------------------------

chart(
    "facet_bar",
    "lineitem",
    {"data": {"name": "lineitem"}, "mark": "bar", "encoding": {"x": f("l_returnflag"), "y": f("l_quantity", aggregate="sum"), "column": f("l_linestatus")}},
    "SELECT l_linestatus AS panel, l_returnflag AS x, sum(l_quantity) AS y FROM lineitem WHERE l_linestatus IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1, 2",
    ["panel", "x", "y"],
)
chart(
    "facet_histogram",
    "orders",
    {"data": {"name": "orders"}, "mark": "bar", "encoding": {"x": f("o_totalprice", bin={"maxbins": 8}), "y": {"aggregate": "count"}, "row": f("o_orderstatus")}},
    """WITH e AS (SELECT o_orderstatus p, min(o_totalprice) lo, max(o_totalprice) hi FROM orders GROUP BY 1),
    b AS (SELECT o_orderstatus p, CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 8)), 7) AS INTEGER) bin, count(*) y FROM orders JOIN e ON p = o_orderstatus GROUP BY 1, 2)
    SELECT e.p AS panel, CAST(i AS INTEGER) AS bin, coalesce(y, 0) AS y FROM e CROSS JOIN range(8) t(i) LEFT JOIN b ON b.p = e.p AND bin = i""",
    ["panel", "bin", "y"],
)
chart(
    "layer_union",
    "orders",
    {"data": {"name": "orders"}, "layer": [{"mark": "bar", "encoding": {"x": f("o_orderstatus"), "y": f("o_totalprice", aggregate="max")}}, {"mark": "bar", "encoding": {"x": f("o_orderstatus"), "y": f("o_totalprice", aggregate="min")}}]},
    "SELECT 0 AS layer, o_orderstatus AS x, max(o_totalprice) AS y FROM orders GROUP BY 2 UNION ALL SELECT 1, o_orderstatus, min(o_totalprice) FROM orders GROUP BY 2",
    ["layer", "x", "y"],
)
chart(
    "hconcat_union",
    ("orders", "lineitem"),
    {"hconcat": [{"data": {"name": "orders"}, "mark": "bar", "encoding": {"x": f("o_orderstatus"), "y": f("o_orderkey", aggregate="count")}}, {"data": {"name": "lineitem"}, "mark": "bar", "encoding": {"x": f("l_returnflag"), "y": f("l_orderkey", aggregate="count")}}]},
    "SELECT 0 AS panel, o_orderstatus AS x, count(*) AS y FROM orders GROUP BY 2 UNION ALL SELECT 1, l_returnflag, count(*) FROM lineitem GROUP BY 2",
    ["panel", "x", "y"],
)
chart(
    "filter_object",
    "part",
    {"data": {"name": "part"}, "transform": [{"filter": f("p_size", gt=5, lte=40)}, {"filter": f("p_brand", oneOf=["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"])}, {"filter": f("p_retailprice", range=[900, 1500])}], "mark": "point", "encoding": {"x": f("p_partkey"), "y": f("p_size")}},
    "SELECT p_partkey AS x, p_size AS y FROM part WHERE p_size > 5 AND p_size <= 40 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') AND p_retailprice BETWEEN 900 AND 1500",
    ["x", "y"],
)
chart(
    "filter_logic",
    "lineitem",
    {"data": {"name": "lineitem"}, "transform": [{"filter": "datum.l_quantity < 5 && datum.l_discount > 0.05 || !(datum['l_returnflag'] != 'R') && datum.l_linenumber == 1"}], "mark": "bar", "encoding": {"x": f("l_linestatus"), "y": {"aggregate": "count"}}},
    "SELECT l_linestatus AS x, count(*) AS y FROM lineitem WHERE l_quantity < 5 AND l_discount > 0.05 OR NOT (l_returnflag != 'R') AND l_linenumber = 1 GROUP BY 1",
    ["x", "y"],
)


chart(
    "filter_inequality",
    "events",
    {"data": {"name": "events"}, "transform": [{"filter": "datum.kind != 'a' && !(datum.value > 0)"}, {"calculate": "datum.value * 2", "as": "twice"}], "mark": "tick", "encoding": {"x": f("event_id")}},
    "SELECT event_id AS x, 0 AS y FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END END AS kind FROM events) WHERE (kind <> 'a' OR kind IS NULL) AND coalesce(NOT (value > 0), true)",
    ["x", "y"],
    prepare=lambda rows: rows.withColumn("kind", F.when(F.col("event_id") % 3 > 0, F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"))),
)
chart(
    "filter_bounds",
    "orders",
    {"data": {"name": "orders"}, "transform": [{"filter": f("o_orderstatus", equal="O")}, {"filter": f("o_totalprice", gte=1000)}, {"filter": f("o_orderkey", lt=5000)}], "mark": "tick", "encoding": {"x": f("o_orderkey"), "y": f("o_totalprice")}},
    "SELECT o_orderkey AS x, o_totalprice AS y FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_orderkey < 5000",
    ["x", "y"],
)
chart(
    "vconcat_grid",
    ("orders", "part"),
    {"vconcat": [{"data": {"name": "orders"}, "mark": "bar", "encoding": {"x": f("o_orderstatus"), "y": f("o_orderkey", aggregate="count")}}, {"mark": "bar", "encoding": {"x": f("p_brand"), "y": {"aggregate": "count"}}}, {"data": {"name": "part"}, "mark": "bar", "encoding": {"x": f("p_brand"), "y": {"aggregate": "count"}}}]},
    "SELECT 0 AS panel, o_orderstatus AS x, count(*) AS y FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2 UNION ALL SELECT 2, p_brand, count(*) FROM part WHERE p_brand IS NOT NULL GROUP BY 2",
    ["panel", "x", "y"],
)
chart(
    "grouped_bar_median",
    "orders",
    {"data": {"name": "orders"}, "mark": "bar", "encoding": {"x": f("o_orderstatus"), "y": f("o_totalprice", aggregate="median"), "color": f("o_orderpriority")}},
    """WITH c AS (SELECT o_orderstatus x, o_orderpriority series, median(o_totalprice) y FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2)
    SELECT a.x, b.series, round(coalesce(c.y, 0), 4) AS y FROM (SELECT DISTINCT x FROM c) a CROSS JOIN (SELECT DISTINCT series FROM c) b LEFT JOIN c ON c.x = a.x AND c.series = b.series""",
    ["x", "series", "y"],
    {"y": 4},
)


@query(
    """WITH r AS (SELECT o_orderpriority AS x, o_totalprice * o_totalprice AS y FROM orders), q AS (SELECT x AS p, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM r GROUP BY 1)
    SELECT x, y FROM r JOIN q ON p = x WHERE y NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""
)
def boxplot_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") * F.col("o_totalprice")).alias("v"))
    boxes = compile_spec(spark, {"data": {"name": "o"}, "mark": "boxplot", "encoding": {"x": f("o_orderpriority"), "y": f("v")}}, {"o": rows}).df
    return marks.outliers(rows, boxes, "o_orderpriority", "v")


@query("SELECT event_type AS series, event_id AS x, value AS y, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS step FROM events WHERE event_type IS NOT NULL")
def line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of each line in the order in which it goes through them."""
    spec = {"data": {"name": "events"}, "mark": "line", "encoding": {"x": f("event_id"), "y": f("value"), "color": f("event_type")}}
    lines = compile_spec(spark, spec, {"events": table(spark, sf_dir, "events")}, order_by="event_id").df
    return lines.select("series", "x", "y", F.row_number().over(Window.partitionBy("series").orderBy("ordinal")).alias("step"))


@query("SELECT v.k AS x, sum(v.n) AS y FROM (VALUES ('a', 1.5), ('b', 2.0), ('a', 3.0), (NULL, 9.0)) v(k, n) WHERE v.k IS NOT NULL GROUP BY 1 UNION ALL SELECT 'set', 7.0")
def inline_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline rows, a dataset of the spec, and no rows at all."""
    child = {"mark": "bar", "encoding": {"x": f("k"), "y": f("n", aggregate="sum")}}
    own = {**child, "data": {"values": [{"k": "a", "n": 1.5}, {"k": "b", "n": 2}, {"k": "a", "n": 3}, {"n": 9}]}}
    spec = {"hconcat": [own, {**child, "data": {"name": "more"}}, child], "datasets": {"more": [{"k": "set", "n": 7}]}}
    return compile_spec(spark, spec).df.select("x", F.col("y").cast("double").alias("y"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS x, count(*) AS y FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1")
def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties as a JSON file that the spec names by its URL."""
    url = f"{own_dir(spark)}/{uuid.uuid4().hex}.jsonl"
    table(spark, sf_dir, "events").select("props").where("props is not null").write.text(url)
    counts = compile_spec(spark, {"data": {"url": url}, "mark": "bar", "encoding": {"x": f("k"), "y": {"aggregate": "count"}}}).df
    return counts.groupBy((F.col("x") % 10).cast("long").alias("x")).agg(F.sum("y").alias("y"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 10")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written by the CSV sink and read by its URL."""
    url = f"{own_dir(spark)}/{uuid.uuid4().hex}.csv"
    sinks.write_csv(table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_brand", "p_size"), url)
    rows = relations.from_url(spark, url)
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.col("p_size").cast("long").alias("p_size"))


# --- corpus -----------------------------------------------------------------------------------------------------------

_NORMAL = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha1({_NORMAL}) AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scripts.fingerprint(scripts.collapse_space(F.col("text"))).alias("fingerprint"))


@query(f"SELECT doc_id, length({_NORMAL}) AS n FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(scripts.collapse_space(F.col("text"))).cast("long").alias("n"))


def _contains(column: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles) + ")"


@query(f"SELECT doc_id, {_contains('text', scripts.EXTERNAL_DATA)} AS external, {_contains('text', scripts.COMPLEX)} AS too_complex, NOT {_contains('text', scripts.SEABORN_MARKS)} OR NOT {_contains('text', scripts.FIGURE_LEVEL)} AS seaborn_ok FROM documents")
def substring_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", scripts.external_data(code).alias("external"), scripts.too_complex(code).alias("too_complex"), scripts.supported_seaborn(code).alias("seaborn_ok"))


@query("SELECT doc_id, CASE WHEN length(text) > 3000 THEN 'code length' ELSE NULL END AS drop_reason FROM documents")
def length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.coalesce("text", F.lit(""))
    samples = table(spark, sf_dir, "documents").select("doc_id", F.lit("i.png").alias("image"), code.alias("code"), F.lit(None).cast("string").alias("vega_spec"))
    return dataset.with_drop_reason(dataset.conversations(samples, INSTRUCTIONS), INSTRUCTIONS[dataset.SPEC_TASK]).select("doc_id", "drop_reason")


@query(
    f"""SELECT coalesce(CASE WHEN length(trim(text, ' \t\n\r')) = 0 OR text IS NULL THEN 'blank' WHEN length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) > 18000 THEN 'long' WHEN {_contains('text', scripts.COMPLEX)} THEN 'complex'
    WHEN {_contains('text', scripts.EXTERNAL_DATA)} THEN 'external' WHEN {_contains('text', scripts.SEABORN_MARKS)} AND {_contains('text', scripts.FIGURE_LEVEL)} THEN 'seaborn' END, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1"""
)
def skip_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = corpus.skip_reason(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1(CAST(doc_id AS VARCHAR) || '42'), doc_id) k, count(*) OVER () n FROM documents) SELECT doc_id, CASE WHEN k <= floor(n * 0.6) THEN 'train' ELSE 'test' END AS split FROM r")
def exact_split_60_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT p_partkey, CAST(v AS INTEGER) AS variant_idx, CAST(a AS INTEGER) AS attempt_idx FROM part CROSS JOIN range(5) t(v) CROSS JOIN range(3) u(a)")
def task_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.expand(table(spark, sf_dir, "part").select("p_partkey"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def anti_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.without_failed(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@query("SELECT source, count(DISTINCT text) AS n_failed FROM documents GROUP BY 1")
def failed_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.failed_by_group(table(spark, sf_dir, "documents"), "source", "text")


@query("SELECT DISTINCT source, lang FROM documents WHERE lang IS NOT NULL")
def failed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.failed_names(table(spark, sf_dir, "documents"), "source", "lang")


@query("SELECT page_id, '/copy' || substr(url, 7) AS path FROM pages WHERE starts_with(url, 'https://')")
def re_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where(F.startswith("url", F.lit("https://")))
    return pages.select("page_id", corpus.re_rooted(F.col("url"), "https:/", "/copy/").alias("path"))


_IMPORTS = (("import numpy as np", "contains({0}, 'np.')"), ("import matplotlib.pyplot as plt", "(contains({0}, 'plt.') OR contains({0}, 'matplotlib'))"), ("import seaborn as sns", "contains({0}, 'sns.')"), ("import pandas as pd", "contains({0}, 'pd.')"))
_HEAD = " || ".join(f"CASE WHEN {used.format('c')} AND NOT contains(c, '{line}') THEN '{line}' || chr(10) ELSE '' END" for line, used in _IMPORTS)


@query(
    f"""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'x = np.pi' WHEN 1 THEN 'plt.plot([1])' || chr(10) || 'sns.set_theme()' WHEN 2 THEN 'import numpy as np' || chr(10) || 'np.e' ELSE 'y = pd.NA; plt.show()' END || ' # ' || p_brand AS c FROM part),
    h AS (SELECT id, {_HEAD} || c AS c FROM c)
    SELECT id, c AS with_imports, CASE WHEN contains(c, 'plt.show()') THEN 'import matplotlib' || chr(10) || 'matplotlib.use(''Agg'')' || chr(10) || c ELSE 'import matplotlib' || chr(10) || 'matplotlib.use(''Agg'')' || chr(10) || c || chr(10) || 'plt.show()' || chr(10) END AS runnable FROM h"""
)
def sanitized_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    body = F.when(kind == 0, "x = np.pi").when(kind == 1, "plt.plot([1])\nsns.set_theme()").when(kind == 2, "import numpy as np\nnp.e").otherwise("y = pd.NA; plt.show()")
    code = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(body, F.lit(" # "), "p_brand").alias("code"))
    return code.select("id", scripts.ensure_imports(F.col("code")).alias("with_imports"), scripts.for_execution(F.col("code")).alias("runnable"))


@query("SELECT p_partkey AS id, (SELECT string_agg('v' || i || ' = ' || i, chr(10) ORDER BY i) FROM range(p_size) t(i)) AS code FROM part WHERE p_size > 0")
def repaired_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated code with an unfinished last line, which goes if enough is left."""
    lines = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.concat(F.lit("v"), i, F.lit(" = "), i))
    torn = F.concat(F.array_join(lines, "\n"), F.lit("\nax.plot(("))
    return table(spark, sf_dir, "part").where("p_size > 0").select(F.col("p_partkey").alias("id"), pycode.repair_udf(torn).alias("code"))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def first_error_per_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.first_errors(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query(
    """WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, sha1(text) AS a, coalesce(CAST(n_chars AS VARCHAR), 'own ' || doc_id) AS b FROM documents WHERE text IS NOT NULL),
    r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS a, CAST([] AS VARCHAR[]) AS b, CAST(NULL AS BIGINT) AS doc_id
    UNION ALL SELECT d.i, CASE WHEN list_contains(r.a, d.a) OR list_contains(r.b, d.b) THEN r.a ELSE list_append(r.a, d.a) END, CASE WHEN list_contains(r.a, d.a) OR list_contains(r.b, d.b) THEN r.b ELSE list_append(r.b, d.b) END,
    CASE WHEN list_contains(r.a, d.a) OR list_contains(r.b, d.b) THEN NULL ELSE d.doc_id END FROM r JOIN d ON d.i = r.i + 1)
    SELECT doc_id FROM r WHERE doc_id IS NOT NULL"""
)
def greedy_two_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("text_sig"), "n_chars")
    return corpus.two_key_dedup(spark, docs, "text_sig", "n_chars", "doc_id").select("doc_id")


# --- images (an embedding as one row of pixels) -------------------------------------------------------------------------


@query(
    """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e, list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) s FROM embeddings)
    SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x >= (s[32] + s[33]) / 2 THEN '1' ELSE '0' END), '') AS bits FROM m"""
)
def signature_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", images.signature_bits(F.col("embedding")).alias("bits"))


@query(
    """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: round((CAST(x AS DOUBLE) + 1) * 128)) v FROM embeddings)
    SELECT vec_id, list_aggregate(v, 'stddev_pop') < 10 OR list_max(v) - list_min(v) < 25 OR len(list_filter(v, lambda x: x < 248)) / 64.0 < 0.01 AS low_information FROM p"""
)
def low_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.transform("embedding", lambda x: F.round((x.cast("double") + 1) * 128))
    return table(spark, sf_dir, "embeddings").select("vec_id", images.low_information(pixels).alias("low_information"))


# --- conversations and generated text -----------------------------------------------------------------------------------


INSTRUCTIONS = {dataset.SPEC_TASK: "Give the chart spec.", dataset.CODE_TASK: "Give the code."}


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as the answer of a training conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("conv_id", F.lit(".png")).alias("image"), F.col("text").alias("code"), F.lit(None).cast("string").alias("vega_spec"))
    return dataset.conversations(turns, INSTRUCTIONS, "turn")


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations WHERE text IS NOT NULL")
def conversation_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = dataset.first_of(F.col("messages"), "text", "assistant")
    return _told(spark, sf_dir).select("conv_id", F.col("ordinal").alias("turn"), "role", F.length(answer).cast("long").alias("n_chars"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def last_assistant_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = dataset.first_of(F.col("messages"), "text", "assistant")
    told = _told(spark, sf_dir).where("role = 'assistant'").select("conv_id", F.struct("ordinal", answer.alias("text")).alias("last"))
    return told.groupBy("conv_id").agg(F.max("last")["text"].alias("text"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL")
def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as JSON lines in two goes, and read again."""
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    told = rows.select(F.concat_ws(" ", "conv_id", "turn", "role").alias("image"), F.col("text").alias("code"), F.col("conv_id").cast("string").alias("vega_lite_spec"))
    sinks.write_samples(told.where(rows.turn % 2 == 0), path)
    sinks.write_samples(told.where(rows.turn % 2 != 0), path, append=True)
    parts = F.split("image", " ")
    return relations.samples(spark, path).select(F.col("vega_lite_spec").cast("long").alias("conv_id"), parts[1].cast("int").alias("turn"), parts[2].alias("role"), F.col("code").alias("text"))


@query("""SELECT page_id, trim(CASE WHEN len(b) > 0 THEN b[-1] ELSE t END, ' ' || chr(9) || chr(10) || chr(13)) AS code FROM (SELECT page_id, trim(url, ' ') t, regexp_extract_all('```python' || chr(10) || url || chr(10) || '```', '```(?:python)?\\s*([\\s\\S]*?)```', 1) b FROM pages)""")
def fence_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```python\n"), F.col("url"), F.lit("\n```"))
    return table(spark, sf_dir, "pages").select("page_id", scripts.extract_code(fenced).alias("code"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


@query(
    """WITH n AS (SELECT count(*) AS n FROM benchmark), i AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS b FROM benchmark),
    p AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS d, b FROM documents, n JOIN i ON i.k = doc_id % n.n)
    SELECT doc_id, len(list_intersect(b, d)) AS matched, round(CASE WHEN len(b) > 0 THEN len(list_intersect(b, d)) / CAST(len(b) AS DOUBLE) ELSE 0 END, 6) AS recall,
    round(CASE WHEN len(list_distinct(list_concat(b, d))) > 0 THEN len(list_intersect(b, d)) / CAST(len(list_distinct(list_concat(b, d))) AS DOUBLE) ELSE 0 END, 6) AS jaccard FROM p"""
)
def token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the item that its id falls to."""
    overlap = metrics.call_overlap(_words(F.col("item")), _words(F.col("text")))
    return _pairs(spark, sf_dir).select("doc_id", F.size(overlap["matched"]).cast("long").alias("matched"), F.round(overlap["api_sim"], 6).alias("recall"), F.round(overlap["jaccard"], 6).alias("jaccard"))


#: Items whose words are broadcast at once.
RECALL_ITEMS = 1024


@query(
    """WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) w FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) w FROM benchmark)
    SELECT doc_id, item_id, len(list_intersect(b.w, d.w)) AS matched, round(CASE WHEN len(b.w) > 0 THEN len(list_intersect(b.w, d.w)) / CAST(len(b.w) AS DOUBLE) ELSE 0 END, 6) AS recall,
    round(CASE WHEN len(list_distinct(list_concat(b.w, d.w))) > 0 THEN len(list_intersect(b.w, d.w)) / CAST(len(list_distinct(list_concat(b.w, d.w))) AS DOUBLE) ELSE 0 END, 6) AS jaccard FROM d, b"""
)
def token_recall_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _words(F.col("text")).alias("words"))
    items = table(spark, sf_dir, "benchmark").select("item_id", _words(F.col("text")).alias("words"))
    return overlap.all_pairs(spark, docs, items, RECALL_ITEMS).withColumns({n: F.round(n, 6) for n in ("recall", "jaccard")})


# --- reports ------------------------------------------------------------------------------------------------------------

_SCORED = """(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS run, quality = 1 AS execution_success, (doc_id % 97) / 97.0 AS ssim, (doc_id % 89) / 89.0 AS bleu, (doc_id % 83) / 83.0 AS edit_sim, (doc_id % 79) / 79.0 AS api_sim FROM labels)"""
_RESULTS = f"""(SELECT *, CASE WHEN execution_success THEN bleu * 0.4 + edit_sim * 0.3 + api_sim * 0.3 ELSE 0 END AS code_score, CASE WHEN execution_success THEN ssim * 0.5 + (bleu * 0.4 + edit_sim * 0.3 + api_sim * 0.3) * 0.5 ELSE 0 END AS overall FROM {_SCORED})"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two runs with made-up metric values, scored by the engine's formulas."""
    share = lambda n: (F.col("doc_id") % n) / float(n)
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "base").otherwise("tuned").alias("run"), (F.col("quality") == 1).alias("execution_success"), share(97).alias("ssim"), share(89).alias("bleu"), share(83).alias("edit_sim"), share(79).alias("api_sim"))
    code = metrics.code_score(F.col("bleu"), F.col("edit_sim"), F.col("api_sim"))
    ok = F.col("execution_success")
    return rows.withColumns({"code_score": metrics.on_success(ok, code), "overall": metrics.on_success(ok, metrics.overall(F.col("ssim"), code))})


@query(f"SELECT doc_id, round(code_score, 6) AS code_score, round(overall, 6) AS overall FROM {_RESULTS}")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_results(spark, sf_dir).select("doc_id", "code_score", "overall"), "code_score", "overall", places=6)


@query(
    f"SELECT run, count(*) AS n_rows, count(*) FILTER (execution_success) AS n_success, round(count(*) FILTER (execution_success) * 100.0 / count(*), 6) AS success_pct, "
    + ", ".join(f"round(avg({m}) FILTER (execution_success), 6) AS mean_{m}, round(stddev_samp({m}) FILTER (execution_success), 6) AS std_{m}" for m in report.METRICS)
    + f" FROM {_RESULTS} GROUP BY 1"
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = report.run_summary(_results(spark, sf_dir))
    return rounded(summary.withColumn("success_pct", F.col("success_pct").cast("double")), *(c for c in summary.columns if c not in ("run", "n_rows", "n_success")), places=6)


_COMPARE = " UNION ALL ".join(f"SELECT '{m}' AS metric, avg({e}) FILTER (run = 'base' AND {w}) AS base, avg({e}) FILTER (run = 'tuned' AND {w}) AS new FROM r" for m, e, w in [(m, m, "execution_success") for m in report.METRICS] + [("success_rate", "CAST(execution_success AS INTEGER)", "true")])
_COMPARED = f"WITH r AS {_RESULTS}, c AS ({_COMPARE}) SELECT metric, base, new, new - base AS absolute, CASE WHEN base > 0 THEN (new - base) / base * 100 ELSE 0 END AS relative FROM c"


@query(f"SELECT metric, round(base, 6) AS base, round(new, 6) AS new, round(absolute, 6) AS absolute, round(relative, 4) AS relative FROM ({_COMPARED})")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(report.compare(_results(spark, sf_dir), "base", "tuned"), "base", "new", "absolute", places=6), "relative")


@query(f"SELECT metric, round(relative, 4) AS relative, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY relative DESC, metric) AS INTEGER) AS rank FROM ({_COMPARED})) WHERE rank <= 2")
def rank_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.rank_improvements(report.compare(_results(spark, sf_dir), "base", "tuned")).select("metric", "relative", "rank"), "relative")


@query(
    """WITH l AS (SELECT event_id AS step, value AS loss FROM events WHERE value IS NOT NULL)
    SELECT arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss, arg_min(loss, step) - arg_max(loss, step) AS reduction, round((arg_min(loss, step) - arg_max(loss, step)) / arg_min(loss, step) * 100, 6) AS reduction_pct,
    min(loss) AS min_loss, (SELECT min(step) FROM l WHERE loss = (SELECT min(loss) FROM l)) AS min_step, count(*) AS n_points FROM l"""
)
def loss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return rounded(report.loss_summary(log), "reduction_pct", places=6)


def _det(*rows: str) -> str:
    a, b, c = (r.split() for r in rows)
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


@query(
    f"""WITH l AS (SELECT CAST(event_id AS DOUBLE) / (SELECT max(event_id) FROM events) x, value y FROM events WHERE value IS NOT NULL),
    m AS (SELECT CAST(count(*) AS DOUBLE) s0, sum(x) s1, sum(x * x) s2, sum(x * x * x) s3, sum(x * x * x * x) s4, sum(y) t0, sum(x * y) t1, sum(x * x * y) t2 FROM l), d AS (SELECT *, {_det("s0 s1 s2", "s1 s2 s3", "s2 s3 s4")} AS det FROM m)
    SELECT CAST(s0 AS BIGINT) AS s0, round(s1, 3) AS s1, round(s2, 3) AS s2, round(s3, 3) AS s3, round(s4, 3) AS s4, round(t0, 3) AS t0, round(t1, 3) AS t1, round(t2, 3) AS t2,
    round({_det("s0 s1 t0", "s1 s2 t1", "s2 s3 t2")} / det, 4) AS a, round({_det("s0 t0 s2", "s1 t1 s3", "s2 t2 s4")} / det, 4) AS b, round({_det("t0 s1 s2", "t1 s2 s3", "t2 s3 s4")} / det, 4) AS c FROM d"""
)
def loss_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments and the fit that comes from them."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).first()[0]
    log = events.select((F.col("event_id").cast("double") / float(last or 1)).alias("step"), F.col("value").alias("loss"))
    fit = report.quadratic_trend(log) or (None, None, None)
    sums = report.moments(log).withColumns({n: F.lit(v).cast("double") for n, v in zip("abc", fit, strict=True)}).withColumn("s0", F.col("s0").cast("long"))
    return rounded(rounded(sums, "s1", "s2", "s3", "s4", "t0", "t1", "t2", places=3), "a", "b", "c")


# --- native array functions -----------------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT p_partkey, p_size, list_transform(range(p_size % 7), lambda i: CAST(p_size AS DOUBLE) + i * 0.5) AS steps, list_transform(range(1, 1 + p_size % 5), lambda i: CAST(i AS DOUBLE)) AS few FROM part)
    SELECT p_partkey, CAST(len(steps) AS BIGINT) AS n_steps, steps[-1] AS last_step, round(list_sum(few), 6) AS total, (p_size % 5) * (p_size % 5 + 1) / 2.0 AS last_cumsum, array_to_string([p_size, p_size, p_size + 1, p_size + 1], ',') AS repeated FROM a"""
)
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    few = F.when(size % 5 > 0, F.transform(F.sequence(F.lit(1), F.greatest(size % 5, F.lit(1))), lambda i: i.cast("double"))).otherwise(F.array().cast("array<double>"))
    start = size.cast("double")
    steps = arrays.arange(start, start + (size % 7) * 0.5, F.lit(0.5))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.size(steps).cast("long").alias("n_steps"),
        F.try_element_at(steps, F.lit(-1)).alias("last_step"),
        F.when(size % 5 > 0, arrays.total(few)).alias("total"),
        F.coalesce(F.try_element_at(arrays.cumsum(few), F.lit(-1)), F.lit(0.0)).alias("last_cumsum"),
        F.array_join(arrays.repeat_each(F.array(size, size + 1), F.lit(2)), ",").alias("repeated"),
    )


@query(
    """WITH a AS (SELECT p_partkey, p_size, CAST(p_size - 25 AS DOUBLE) / 20 AS x FROM part)
    SELECT p_partkey, round(sin(x), 9) AS sin, round(cos(x), 9) AS cos, round(tan(x), 9) AS tan, round(exp(x), 9) AS exp, round(CASE WHEN x >= 0 THEN sqrt(x) END, 9) AS sqrt, round(CASE WHEN x > 0 THEN ln(x) END, 9) AS log, round(CASE WHEN x > 0 THEN log10(x) END, 9) AS log10, abs(x) AS abs,
    round(atan(x), 9) AS arctan, round(CASE WHEN abs(x) <= 1 THEN asin(x) END, 9) AS arcsin, round(CASE WHEN abs(x) <= 1 THEN acos(x) END, 9) AS arccos, round(atan2(x, 2.0), 9) AS arctan2, x = 0 AS log_is_infinite FROM a"""
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("p_size") - 25).cast("double") / 20
    bare = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    out = {name: F.round(bare(f_(x)), 9) for name, f_ in arrays.MATH.items()}
    out |= {name: F.round(f_(x, F.lit(2.0)), 9) for name, f_ in arrays.MATH_2.items()} | {"abs": F.abs(x)}
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in out.items()), (arrays.log(x) == float("-inf")).alias("log_is_infinite"))


@query(
    """WITH a AS (SELECT p_partkey, p_size, [CAST(p_size AS DOUBLE), 0.5, -p_size / 4.0] AS xs FROM part)
    SELECT p_partkey, list_min(xs) AS smallest, list_max(xs) AS largest, CAST(2 AS INTEGER) AS n_keys, 3 AS a, p_size AS b, -1 AS c, 'a=3,b=' || p_size AS items,
    round(xs[1] + xs[2] + xs[3], 9) AS last_sum, p_size * 7 * (p_size * 7 + 1) / 2 AS long_sum, p_size * 7 AS n_sums FROM a"""
)
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("int")
    xs = F.array(size.cast("double"), F.lit(0.5), -size / 4.0)
    m = arrays.mapping(F.array(*map(F.lit, "aba")), F.array(F.lit(1), size, F.lit(3)))
    pairs = F.array_join(F.array_sort(F.transform(arrays.items(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    steps = F.transform(F.sequence(F.lit(1), size * 7), lambda i: i.cast("double"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        arrays.smallest(xs).alias("smallest"),
        arrays.largest(xs).alias("largest"),
        F.size(arrays.keys(m)).alias("n_keys"),
        *(arrays.get(m, F.lit(k), F.lit(-1)).alias(k) for k in "abc"),
        pairs.alias("items"),
        F.round(F.element_at(arrays.cumsum(xs), -1), 9).alias("last_sum"),
        F.element_at(arrays.cumsum(steps), -1).alias("long_sum"),
        F.size(arrays.cumsum(steps)).alias("n_sums"),
    )


# --- row-wise Python operators over generated scripts -------------------------------------------------------------------------


def _spread(df: DataFrame, key: str, each: int = 1) -> DataFrame:
    """Rows of a small file, which is one task, over all cores, `each` tasks a core, for what each row costs in Python. `df` is a scan: its partitions are known."""
    tasks = each * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() < tasks else df


def _scripts(spark: SparkSession, sf_dir: str, each: int = 1) -> DataFrame:
    """A plotting script for each part."""
    body = "import numpy as np\nimport matplotlib.pyplot as plt\n# part %s\nx = np.arange(0, %s)\nplt.plot(x, x * %s, color='red', alpha=0.5)\nplt.title('%s')\nplt.show()\n"
    part = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey", each)
    return part.select(F.col("p_partkey").alias("id"), F.format_string(body, "p_partkey", F.col("p_size") + 2, "p_size", "p_brand").alias("code"))


def _lines(*lines: str) -> str:
    """SQL for lines of text; {x} stands for a column."""
    return "format('" + "\\n".join(lines).replace("'", "''").replace("\\n", "' || chr(10) || '") + "'"


_CLEAN = _lines("import numpy as np", "import matplotlib.pyplot as plt", "", "x = np.arange(0, {})", "plt.plot(x, x * {}, color='red', alpha=0.5)", "plt.title('{}')", "plt.show()", "") + ", p_size + 2, p_size, p_brand)"
_CODE = _lines("import numpy as np", "import matplotlib.pyplot as plt", "# part {}", "x = np.arange(0, {})", "plt.plot(x, x * {}, color='red', alpha=0.5)", "plt.title('{}')", "plt.show()", "") + ", p_partkey, p_size + 2, p_size, p_brand)"
_QUANTITATIVE = '"encoding":{"x":{"field":"x","type":"quantitative"},"y":{"field":"y","type":"quantitative"}}'
_SPEC = """('{"data":{"values":[' || (SELECT string_agg('{"x":' || i || ',"y":' || i * p_size || '}', ',' ORDER BY i) FROM range(p_size + 2) t(i)) || ']},""" + _QUANTITATIVE + ""","mark":"line","title":"' || p_brand || '"}')"""


@query(f"SELECT p_partkey AS id, 0 AS n_axes, 'arange,plot,show,title' AS calls, {_CLEAN} AS code FROM part")
def script_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.clean(_scripts(spark, sf_dir)).withColumn("facts", pycode.script_facts("code")).select("id", "facts.n_axes", F.array_join("facts.calls", ",").alias("calls"), "code")


@query(f"SELECT p_partkey AS id, {_SPEC} AS spec FROM part")
def spec_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scripts(spark, sf_dir).select("id", extract.extract_udf("code").alias("spec"))


#: A script of each kind, with one number, and the spec of its chart.
KINDS = (
    ("labels = ['a', 'b', 'c']\nplt.bar(labels, [{0}, {0} + 1, {0} * 2])\nplt.xlabel('kind')", '{"data":{"values":[{"category":"a","value":N},{"category":"b","value":N+1},{"category":"c","value":N*2}]},"encoding":{"x":{"field":"category","title":"kind","type":"nominal"},"y":{"field":"value","type":"quantitative"}},"mark":"bar"}'),
    ("x = np.arange(2)\nplt.plot(x, x + {0}, label='up')\nplt.plot(x, x - {0}, label='down')", '{"data":{"values":[{"series":"up","x":0,"y":N},{"series":"up","x":1,"y":N+1},{"series":"down","x":0,"y":0-N},{"series":"down","x":1,"y":1-N}]},"encoding":{"color":{"field":"series","type":"nominal"},"x":{"field":"x","type":"quantitative"},"y":{"field":"y","type":"quantitative"}},"mark":"line"}'),
    ("values = [{0}, 2, 3, {0}, 5][1:4]\nplt.hist(values, bins={0})\nplt.title('t')", '{"data":{"values":[{"value":2},{"value":3},{"value":N}]},"encoding":{"x":{"bin":{"maxbins":N},"field":"value","type":"quantitative"},"y":{"aggregate":"count","type":"quantitative"}},"mark":"bar","title":"t"}'),
    ("plt.imshow([[{0}, 1], [2, 3]])", '{"data":{"values":[{"value":N,"x":0,"y":0},{"value":1,"x":1,"y":0},{"value":2,"x":0,"y":1},{"value":3,"x":1,"y":1}]},"encoding":{"color":{"field":"value","type":"quantitative"},"x":{"field":"x","type":"ordinal"},"y":{"field":"y","type":"ordinal"}},"mark":"rect"}'),
    ("plt.boxplot([[{0}, 1], [3, {0} - 1]])", '{"data":{"values":[{"group":"group_1","value":N},{"group":"group_1","value":1},{"group":"group_2","value":3},{"group":"group_2","value":N-1}]},"encoding":{"x":{"field":"group","type":"nominal"},"y":{"field":"value","type":"quantitative"}},"mark":"boxplot"}'),
)


def _spec_sql(spec: str) -> str:
    return "'" + re.sub(r"(?<=:)(?:0-N|1-N|N(?:[+*-]\d)?)(?=[,}])", lambda m: f"' || ({m[0].replace('N', 'p_size')}) || '", spec) + "'"


@query(f"SELECT p_partkey AS id, CASE p_partkey % {len(KINDS)} " + " ".join(f"WHEN {k} THEN {_spec_sql(spec)}" for k, (_, spec) in enumerate(KINDS)) + " END AS spec FROM part")
def spec_extract_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs of bars, lines, a histogram, a heatmap and boxes."""
    part = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    code = F.lit(None).cast("string")
    for k, (body, _) in enumerate(KINDS):
        text = F.replace(F.lit("import numpy as np\nimport matplotlib.pyplot as plt\n" + body), F.lit("{0}"), F.col("p_size").cast("string"))
        code = F.when(F.col("p_partkey") % len(KINDS) == k, text).otherwise(code)
    return part.select(F.col("p_partkey").alias("id"), code.alias("code")).select("id", extract.extract_udf("code").alias("spec"))


@query("SELECT p_partkey AS id, 'line' AS kind, true AS supported FROM part")
def spec_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec_extract(spark, sf_dir).withColumn("c", metrics.classify_udf("spec")).select("id", "c.*")


@query(
    """WITH n AS (SELECT p_partkey AS id, CAST(2 * (p_size + 2) + 6 AS DOUBLE) AS n FROM part)
    SELECT id, false AS ir_exact_match, (n - 1) / n AS ir_field_precision, (n - 1) / n AS ir_field_recall, round((n - 1) / n, 12) AS ir_field_f1, 0.5 + 0.5 * ((n - 1) / (n + 1)) AS ir_tree_similarity FROM n"""
)
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = spec_extract(spark, sf_dir)
    scored = specs.withColumn("s", metrics.ir_scores_udf("spec", F.regexp_replace("spec", "line", "point"))).select("id", "s.*")
    return rounded(scored, "ir_field_f1", places=12)


@query()
def augment_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = corpus.expand(_scripts(spark, sf_dir, each=4).withColumn("path", F.col("id").cast("string")))
    return augment.variants(tasks).select("id", "variant_idx", "attempt_idx", F.sha1(F.col("new_code").cast("binary")).alias("code_sig"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text with that of an item: those whose ids agree modulo the number of items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    numbered = items.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_id")) - 1)
    n = items.count()
    docs = _spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.withColumn("k", F.pmod(F.col("doc_id"), F.lit(max(n, 1)))).join(numbered, "k")


@query()
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", metrics.edit_similarity_udf("text", "item").alias("edit_sim"))


_WORDS_OF = "list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda x: x <> '')"
_GRAMS_OF = "SELECT doc_id, o, g, count(*) AS n FROM (SELECT doc_id, o, unnest(list_transform(range(1, greatest(len({0}) - o + 2, 1)), lambda i: array_to_string({0}[i : i + o - 1], chr(1)))) AS g FROM p, range(1, 5) t(o)) GROUP BY ALL"


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM benchmark), i AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, text AS item FROM benchmark),
    p AS (SELECT doc_id, {_WORDS_OF.format("text")} AS a, {_WORDS_OF.format("item")} AS b FROM documents, n JOIN i ON i.k = doc_id % n.n),
    x AS ({_GRAMS_OF.format("a")}), y AS ({_GRAMS_OF.format("b")}), m AS (SELECT doc_id, o, sum(least(x.n, y.n)) AS h FROM x JOIN y USING (doc_id, o, g) GROUP BY ALL),
    h AS (SELECT doc_id, len(a) AS la, len(b) AS lb, {", ".join(f"coalesce(max(h) FILTER (o = {k}), 0) AS h{k}" for k in (1, 2, 3, 4))} FROM p LEFT JOIN m USING (doc_id) GROUP BY ALL)
    SELECT doc_id, round(CASE WHEN h1 = 0 THEN 0.0 ELSE CASE WHEN lb > la THEN 1.0 ELSE exp(1 - CAST(la AS DOUBLE) / lb) END * exp(({" + ".join(f"ln(CASE WHEN h{k} = 0 THEN 0.1 ELSE h{k} END / CAST(greatest(1, lb - {k - 1}) AS DOUBLE))" for k in (1, 2, 3, 4))}) / 4) END, 9) AS bleu FROM h"""
)
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pairs(spark, sf_dir).select("doc_id", metrics.bleu_udf("text", "item").alias("bleu")), "bleu", places=9)


@query()
def evaluate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _scripts(spark, sf_dir).select("id", F.lit("i.png").alias("image"), "code", F.col("code").alias("ref_code"), F.regexp_replace("code", "plot", "scatter").alias("generated_code"))
    rows = code.withColumns({"ref_spec": extract.extract_udf("ref_code"), "generated_spec": extract.extract_udf("generated_code"), "ssim": F.lit(0.5), "execution_success": F.col("id") % 3 > 0})
    return report.evaluate(rows).select("id", *report.METRICS, "ir_exact_match", "ir_field_f1", "ir_tree_similarity")


@query(
    f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Give the chart spec.' ELSE 'Give the code.' END AS instruction, CASE WHEN p_partkey % 2 = 0 THEN {_SPEC} ELSE {_CODE} END AS target_text,
    p_partkey || '.png' AS first_image, CASE WHEN p_partkey % 2 = 1 AND length({_CODE}) > 120 THEN 'code length' END AS drop_reason FROM part"""
)
def training_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _scripts(spark, sf_dir).select("id", F.concat(F.col("id").cast("string"), F.lit(".png")).alias("image"), "code", F.when(F.col("id") % 2 == 0, extract.extract_udf("code")).alias("vega_spec"))
    checked = dataset.with_drop_reason(dataset.conversations(samples, INSTRUCTIONS), INSTRUCTIONS[dataset.SPEC_TASK], most_code=120)
    return checked.select("id", "instruction", "target_text", dataset.first_of(F.col("messages"), "image").alias("first_image"), "drop_reason")
