"""Sinks. They write folders, as Spark does; a rewrite goes to a new path that the caller then uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import classify_udf
from . import relations


def write_samples(df: DataFrame, path: str, append: bool = False) -> None:
    """SNK1, SNK2: JSON lines; null fields are left out."""
    df.write.mode("append" if append else "overwrite").json(path)


def rewrite_samples(spark: SparkSession, source: str, target: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SRC3: the samples of one folder, changed, in another one, which is returned; the first stays as it is."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a rewrite needs a folder of its own")
    write_samples(change(relations.samples(spark, source)), target)
    return relations.samples(spark, target)


def write_run(results: DataFrame, folder: str) -> None:
    """SNK3: all rows, the successful ones, and the results as JSON."""
    flat = results.select(*(F.col(n) for n, t in results.dtypes if not t.startswith(("array", "struct", "map"))))
    flat.write.mode("overwrite").csv(f"{folder}/all", header=True)
    flat.where("execution_success").write.mode("overwrite").csv(f"{folder}/successful", header=True)
    results.write.mode("overwrite").json(f"{folder}/results")


def write_csv(df: DataFrame, path: str) -> None:
    """SNK4."""
    df.write.mode("overwrite").csv(path, header=True)


def spec_name(spec_text: Column, image: Column) -> Column:
    """SNK5: the image's stem, or the first 12 digits of the spec's SHA-1."""
    stem = F.regexp_replace(F.element_at(F.split(image, "[/\\\\]"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.when(F.length(stem) > 0, stem), F.substring(F.sha1(spec_text), 1, 12))


def write_specs(df: DataFrame, path: str, buckets: int = 16) -> None:
    """SNK5: the supported specs (columns name, spec) as rows, in `buckets` folders by a hash of the name.

    A name's spec is read by its bucket, so there is no file or folder for each of them.
    """
    fit = df.where("spec is not null").select("name", "spec").where(classify_udf("spec")["supported"])
    fit.withColumn("bucket", bucket_of(F.col("name"), buckets)).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def bucket_of(name: Column, buckets: int = 16) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def read_spec(spark: SparkSession, path: str, name: str, buckets: int = 16) -> str | None:
    """The spec of one name, from its bucket alone."""
    rows = spark.read.schema("name string, spec string, bucket int").json(path)
    found = rows.where((F.col("bucket") == bucket_of(F.lit(name), buckets)) & (F.col("name") == name)).first()
    return found.spec if found else None


def converted_and_skipped(df: DataFrame, spec: str = "spec") -> tuple[DataFrame, DataFrame]:
    """SNK6."""
    return df.where(F.col(spec).isNotNull()), df.where(F.col(spec).isNull())


def first_errors(df: DataFrame, error: str, order_by: str) -> DataFrame:
    """SNK7: the first row of each distinct message."""
    first = df.where(F.col(error).isNotNull()).groupBy(F.col(error).alias("__e")).agg(F.min(order_by).alias("__o"))
    joined = df.join(first, (F.col(error) == F.col("__e")) & (F.col(order_by) == F.col("__o"))).drop("__e", "__o")
    return joined.withColumn("__k", F.row_number().over(Window.partitionBy(error).orderBy(order_by))).where("__k = 1").drop("__k")
