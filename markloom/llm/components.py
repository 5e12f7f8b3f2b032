"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_shared, write_shared

MAX_ROUNDS = 60


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge in `edges` (a, b: long); root is the smallest node reachable.

    Each round links every node's neighbours to the smallest one (large star on larger neighbours, small star on
    smaller ones); the minimum is a partial aggregate, so a hub costs one row a task, and the join back on a hub is
    split by AQE. The number of rounds grows with the squared logarithm of the nodes. Every round is written to the
    shared folder and the one before it deleted. Null nodes and loops are left out; no edges give no rows.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = write_shared(spark, now, "edges")
    before = _mark(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MAX_ROUNDS):
        fresh = write_shared(spark, _small_star(_large_star(now)), "edges")
        drop_shared(spark, now)
        now, mark = fresh, _mark(fresh)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
