"""Two-key dedup of a stream into an appended sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import two_key_dedup
from ..sources.shared import listed

#: Batches after which the keys are written together.
COMPACT = 16


def append_unique(stream: DataFrame, path: str, checkpoint: str, first: str, second: str, order_by: str, **trigger) -> StreamingQuery:
    """K5 with SNK2: each micro-batch is deduped by itself and against the keys of what the sink holds, then appended.

    A batch's rows that share a key with an earlier batch go before the batch's own rows compete, as in one pass over
    the rows in order of arrival. A batch that runs again finds its rows there and adds none twice. The kept keys lie
    beside the sink in a table of their own, a small one for each batch and from time to time one for all before, so
    that a batch reads two columns and few files, never the sink.
    """
    keys = f"{path.rstrip('/')}_keys"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        earlier, fresh = seen_keys(spark, keys, number), rows
        if earlier is not None:
            for name, key in ((first, "a"), (second, "b")):
                old = earlier.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"))
                fresh = fresh.join(old, F.col(name).cast("string") == F.col("__k"), "left_anti")
        out = f"{path}/batch={number}"
        two_key_dedup(spark, fresh, first, second, order_by).write.mode("overwrite").json(out)
        kept = spark.read.schema(rows.schema).json(out).select(F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b"))
        kept.write.mode("overwrite").parquet(f"{keys}/batch={number}")
        if number % COMPACT == COMPACT - 1:
            seen_keys(spark, keys, number + 1).write.mode("overwrite").parquet(f"{keys}/upto={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def seen_keys(spark: SparkSession, keys: str, before: int) -> DataFrame | None:
    """The keys (a, b) kept by batches before a number: the last compaction and the batches after it."""
    numbers: dict[str, list[int]] = {"upto": [], "batch": []}
    for name in listed(spark, keys):
        kind, _, number = name.partition("=")
        if kind in numbers and int(number) < before and listed(spark, f"{keys}/{name}").count("_SUCCESS"):
            numbers[kind].append(int(number))
    last = max(numbers["upto"], default=-1)
    paths = [f"{keys}/upto={last}"] * (last >= 0) + [f"{keys}/batch={n}" for n in sorted(numbers["batch"]) if n > last]
    return spark.read.schema("a string, b string").parquet(*paths) if paths else None
