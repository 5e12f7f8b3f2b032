"""Shared storage and small helpers of the corpus operators.

What they write lies below spark.checkpoint.dir; markloom.sources.shared.clean_up() deletes it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, own_dir

#: Broadcast variables and collected tables stay below this size; beyond it another way is taken.
BROADCAST_LIMIT_BYTES = 64 << 20
#: Whole texts that a Python worker gets at once.
TEXT_ROWS = 1000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """From now on Python gets no more than `rows` rows at once. Spark's 10,000 whole texts have no useful bound in bytes.

    The setting is read when a plan is made, which for a lazy result is after the operator has returned; so it stays.
    A smaller one of the caller's is left alone.
    """
    if int(spark.conf.get(BATCH_ROWS)) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


@contextmanager
def number_batches(spark: SparkSession, rows: int = 10_000) -> Iterator[None]:
    """While plans over short rows are made and run."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def trim() -> None:
    """Gives what a Python worker has freed back to the system; workers live on from stage to stage."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def write_shared(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends there, so a lost executor costs a reread only."""
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def write_bucketed(spark: SparkSession, df: DataFrame, name: str, buckets: int, columns: list[str], sort_by: list[str] | None = None, partition_by: str | None = None, compression: str = "zstd") -> DataFrame:
    """The same as a table bucketed by `columns`, so that joins and groups on them move nothing."""
    key = uuid.uuid4().hex
    path, table_name = f"{own_dir(spark)}/{key}/{name}", f"markloom_{name}_{key}"
    writer = df.write.format("parquet").option("compression", compression).option("path", path).bucketBy(buckets, *columns)
    writer = writer.sortBy(*sort_by) if sort_by else writer
    (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(table_name)
    out = spark.table(table_name)
    out.shared_path, out.shared_table = path, table_name
    return out


def drop_shared(spark: SparkSession, df: DataFrame) -> None:
    """Deletes what write_shared() or write_bucketed() wrote, once nothing reads it any more."""
    if table_name := getattr(df, "shared_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {table_name}")
    if path := getattr(df, "shared_path", None):
        delete(spark, path.rsplit("/", 1)[0])


def text_bytes(col: str = "text"):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = [k for k in range(8) if planes[k].any()]
    top = (used[-1] + 1) if used else 0
    body = planes[:top].tobytes()
    return len(values).to_bytes(4, "little") + bytes([top]) + body


def unpack_sorted(blob: bytes) -> np.ndarray:
    n, top = int.from_bytes(blob[:4], "little"), blob[4]
    planes = np.zeros((8, n), np.uint8)
    if top:
        planes[:top] = np.frombuffer(blob, np.uint8, offset=5).reshape(top, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def crc_mod(doc_id, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def bucket_keys(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket of a table bucketed by a long, a number that falls into it: tasks that take turns fill all alike."""
    found: dict[int, int] = {}
    first, step = 0, 64 * buckets
    while len(found) < buckets:
        ids = spark.range(first, first + step, 1, 1)
        found |= dict(ids.groupBy(F.pmod(F.hash("id"), F.lit(buckets))).agg(F.min("id")).collect())
        first += step
    return [found[b] for b in range(buckets)]
