"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows are numbered and lie in P partitions by a hash of their number. How many rows partition i sends to shard j is
drawn first, row by row of the matrix, from the multivariate hypergeometric law: the number that a uniformly random
permutation would send. Each partition then permutes its rows and sends its first A[i,0] to shard 0, the next A[i,1] to
shard 1 and so on; a shard permutes what it gets once more, which gives the slots. Only numbers, ids, sizes and checksums
move, never texts; shuffled() then moves each text once.

A permutation is the order by a keyed hash of the row's number, so copies of a text or an id are spread as any rows are,
and no group of them is hot. Numbers are drawn when the sizes are written, and stay. A shard's slots come from pieces of
its hash range, each ranked by itself and offset by the pieces before, so no task holds a shard. A null text has size 8
and a null checksum. Null and repeated ids are rows like any other, and no rows give no rows. Texts may be of any length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import write_shared

SHARDS = 24
PARTITION_ROWS = 20_000
#: Bound of the matrix: MAX_PARTITIONS x shards counts on the driver and in a broadcast (4 MB at 24 shards).
MAX_PARTITIONS = 4096
SEED = 7


def communication_matrix(have: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Counts by partition and shard; rows sum to `have`, columns to sizes that differ by one at most."""
    total = int(have.sum())
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    rng = np.random.default_rng([seed, total, shards])
    out = np.zeros((len(have), shards), np.int64)
    for i, n in enumerate(have):
        # drawn shard by shard: the conditional laws of the multivariate one, also for totals beyond its limits
        rest, todo = int(left.sum()), int(n)
        for j in range(shards):
            rest -= int(left[j])
            out[i, j] = rng.hypergeometric(int(left[j]), rest, todo) if 0 < todo and left[j] and rest else min(todo, int(left[j]))
            todo -= int(out[i, j])
        left -= out[i]
    return out


def assign(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, partition_rows: int = PARTITION_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row."""
    raw = F.col("text").cast("binary")
    thin = docs.select("doc_id", (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    return place(spark, write_shared(spark, thin, "sizes"), shards, partition_rows, seed).drop("row")


def place(spark: SparkSession, thin: DataFrame, shards: int, partition_rows: int = PARTITION_ROWS, seed: int = SEED) -> DataFrame:
    """The written frame `thin`, whose column row has a number for each row, with shard and slot."""
    parts = int(np.clip(-(-thin.count() // partition_rows), 1, MAX_PARTITIONS))
    keyed = thin.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(parts)).cast("int"))
    have = np.zeros(parts, np.int64)
    for row in keyed.groupBy("part").count().collect():  # at most MAX_PARTITIONS rows
        have[row["part"]] = row["count"]
    matrix = communication_matrix(have, shards, seed)
    ends = np.cumsum(matrix, axis=1)
    bounds = spark.createDataFrame([(i, ends[i].tolist()) for i in range(parts)], "part int, ends array<long>")
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row")
    placed = keyed.withColumn("place", F.row_number().over(local)).join(F.broadcast(bounds), "part")
    shard = F.size(F.filter("ends", lambda e: e < F.col("place")))
    sent = write_shared(spark, placed.select(*thin.columns, "part", "place", shard.alias("shard")), "sent")
    return slots(spark, sent, shards, parts, seed)


def slots(spark: SparkSession, sent: DataFrame, shards: int, parts: int, seed: int) -> DataFrame:
    """The second permutation: rows in order of a fresh hash, slot 0 on, within each shard."""
    pieces = max(1, min(MAX_PARTITIONS, -(-parts // shards) * 2))
    fresh = F.xxhash64(F.lit(seed + 2), "part", "place")
    piece = F.floor((fresh / F.lit(2.0**64) + 0.5) * pieces).cast("int")
    keyed = sent.withColumn("fresh", fresh).withColumn("piece", F.least(piece, F.lit(pieces - 1)))
    counts = keyed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy("shard", "piece").orderBy("fresh", "part", "place")
    ranked = keyed.withColumn("rank", F.row_number().over(own)).join(before.select("shard", "piece", "before"), ["shard", "piece"])
    own_columns = [c for c in sent.columns if c not in ("part", "place", "shard")]
    return ranked.select(*own_columns, "shard", (F.coalesce("before", F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"))


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def shuffled(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, piece_rows: int = PARTITION_ROWS) -> DataFrame:
    """All columns of the documents with __shard and __slot: the exchange that moves the texts.

    The documents are written once with a number for each row, which the placed numbers are joined to. A shard comes in
    pieces of `piece_rows` consecutive slots, sorted, so no task holds a shard.
    """
    numbered = write_shared(spark, docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    placed = place(spark, write_shared(spark, numbered.select(F.col("__row").alias("row")), "rows"), shards)
    placed = placed.select(F.col("row").alias("__row"), F.col("shard").cast("int").alias("__shard"), F.col("slot").alias("__slot"))
    piece = F.floor(F.col("__slot") / piece_rows)
    return numbered.join(placed, "__row").repartition("__shard", piece).sortWithinPartitions("__shard", "__slot").select(*docs.columns, "__shard", "__slot")
