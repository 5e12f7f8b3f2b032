"""The corpus pipeline: five stages over documents, each of which decides what the next one sees.

A stage keeps all columns of its documents, whatever their names, but for the last one, which gives what training reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm import decontaminate, lines, pieces, simhash, toxicity
from markloom.llm.common import table, write_shared


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten documents or more go; n_chars follows the text."""
    return _with_length(lines.drop_common_lines(spark, docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.keep_one(spark, docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows go; n_chars follows the text."""
    return _with_length(decontaminate.remove_contaminated(spark, docs, table(spark, sf_dir, "benchmark")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: what training reads."""
    encoded = pieces.encode(spark, docs)
    return encoded.selectExpr("doc_id", "cast(size(ids) as long) as n_tokens", "ids", "round_trip")


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", cut_benchmark_passages),
    ("sentencepiece", tokenise),
]

#: The classifier, the components and the tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = write_shared(spark, docs, name.replace(" ", "_"))
    return docs
