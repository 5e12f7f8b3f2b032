"""Where a chart's rows and a corpus's scripts come from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import SPEC_KEYS

#: Fields of a sample. All that may hold its spec are read, as text, so that numbers keep their notation.
SAMPLE = ", ".join(f"{name} string" for name in ("image", "code", *SPEC_KEYS, "vega_lite_spec_path"))


def resolve(spark: SparkSession, source, named: dict[str, DataFrame], datasets: dict[str, list], fields: list[str] = ()) -> DataFrame:
    """SRC4-SRC7: inline values, a dataset of the spec, a DataFrame given by name, a URL, or no rows at all (of `fields`)."""
    if source.values:
        return inline(spark, list(source.values))
    if source.values is None and source.name is not None:
        if datasets.get(source.name):
            return inline(spark, datasets[source.name])
        if source.name in named:
            return named[source.name]
    if source.values is None and source.url is not None:
        return from_url(spark, source.url)
    return spark.createDataFrame([], ", ".join(f"`{n}` double" for n in ("__empty", *fields)))


def inline(spark: SparkSession, values: list) -> DataFrame:
    """SRC4, SRC5: records (or bare values, as column data) with types inferred over all of them."""
    rows = [v if isinstance(v, dict) else {"data": v} for v in values]
    if not rows:
        return spark.createDataFrame([], "__empty int")
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {n: _type([r.get(n) for r in rows]) for n in names}
    cast = {"double": lambda v: float(v), "bigint": int, "boolean": bool, "string": lambda v: v if isinstance(v, str) else json.dumps(v)}
    data = [tuple(None if r.get(n) is None else cast[kinds[n]](r[n]) for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def _type(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    return "boolean" if kinds == {bool} else "bigint" if kinds == {int} else "double" if kinds and kinds <= {int, float} else "string"


def without_nan(df: DataFrame) -> DataFrame:
    """NaN is a missing value in charts."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in floats}) if floats else df


def from_url(spark: SparkSession, url: str) -> DataFrame:
    """SRC6: .csv is CSV, anything else JSON (an array or lines)."""
    if url.lower().endswith(".csv"):
        return spark.read.csv(url, header=True, inferSchema=True)
    return spark.read.json(url, multiLine=True) if url.lower().endswith(".json") else spark.read.json(url)


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC1: path, base and code of every .py file below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.lit(folder).alias("base"), F.col("value").alias("code"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: JSON lines of samples; a spec that is an object there becomes its text."""
    return spark.read.schema(SAMPLE).json(path)


def saved_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC8: results, all rows and successful rows of a saved run."""
    read = lambda name: spark.read.csv(f"{folder}/{name}", header=True, inferSchema=True)
    return spark.read.json(f"{folder}/results"), read("all"), read("successful")
