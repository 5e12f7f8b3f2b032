"""Frames that are written to the folder all executors share, so that lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local session that has none gets a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='markloom-')}"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """What this session writes is below this folder."""
    return f"{shared_dir(spark)}/markloom/{spark.sparkContext.applicationId}"


def settle(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes `df` and reads it back: a lost executor then costs a reread only."""
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder on any file system; none if it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def clean_up(spark: SparkSession) -> None:
    """Deletes all that this session has written there. Results are lazy and may read it: save them first."""
    for row in spark.sql("SHOW TABLES LIKE 'markloom_*'").collect():
        spark.sql(f"DROP TABLE IF EXISTS {row.tableName}")
    delete(spark, own_dir(spark))
