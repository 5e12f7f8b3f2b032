"""Corpus operators: script filters, splits, expansion and dedup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images, pycode, scripts
from ..sources.shared import settle

VARIANTS, ATTEMPTS = 5, 3
MOST_CHARACTERS = 18_000
#: Rows that one task goes through in order.
FINISH_ROWS = 100_000


def skip_reason(code: Column, facts: Column | None = None) -> Column:
    """The first reason to leave a script out, or null. Without `facts` only the reasons that its text tells."""
    blank = F.length(F.regexp_replace(F.coalesce(code, F.lit("")), r"(?U)\s", "")) == 0
    stripped = F.length(F.regexp_replace(code, r"(?U)^\s+|\s+$", ""))
    reason = F.when(blank, "blank").when(stripped > MOST_CHARACTERS, "long").when(scripts.too_complex(code), "complex")
    if facts is not None:
        reason = reason.when(facts["blocking"], "blocking")
    reason = reason.when(scripts.external_data(code), "external")
    if facts is not None:
        safe = F.array(*map(F.lit, sorted(pycode.SAFE_MODULES)))
        reason = reason.when(F.size(F.array_except(facts["imports"], safe)) > 0, "imports")
    reason = reason.when(~scripts.supported_seaborn(code), "seaborn")
    if facts is not None:
        drawing = F.array(*map(F.lit, sorted(pycode.PLOT_METHODS | pycode.SEABORN_METHODS)))
        reason = reason.when(~F.arrays_overlap(facts["calls"], drawing), "no plot").when(facts["n_axes"] > 1, "axes")
    return reason


def clean(df: DataFrame) -> DataFrame:
    """K2: the scripts to keep (column code), without comments. What text tells is filtered before anything is parsed."""
    kept = df.where(skip_reason(F.col("code")).isNull()).withColumn("__facts", pycode.script_facts("code"))
    kept = kept.where(skip_reason(F.col("code"), F.col("__facts")).isNull()).drop("__facts")
    return kept.withColumn("code", pycode.remove_comments_udf("code"))


def with_sample(df: DataFrame) -> DataFrame:
    """C11: rows that have both an image and code."""
    return df.where((F.length("image") > 0) & (F.length("code") > 0))


def exact_split(df: DataFrame, key: str, share: float = 0.6, seed: str = "42") -> DataFrame:
    """K1: df with `split`: exactly floor(share * n) rows are "train", picked by a seeded hash of the key.

    The rank is by histogram: rows are counted by the first three digits of their hash, the digits before the cut are
    train as a whole, and only the rows of the digits at the cut are ranked. No task sees more than 1/4096 of the rows.
    """
    # rows without a key come last, behind all hexadecimal digits
    keyed = df.withColumn("__h", F.coalesce(F.sha1(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), F.lit("ggg"))).withColumn("__b", F.substring("__h", 1, 3))
    counts = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("n"))
    running = counts.select("__b", "n", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__b")).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    # at most 4097 rows
    quota = running.select("__b", "n", F.greatest(F.lit(0), F.least("n", F.floor(F.col("all") * share) - (F.col("upto") - F.col("n")))).alias("__take"))
    ranked = keyed.join(F.broadcast(quota), "__b")
    cut = ranked.where("__take > 0 and __take < n").withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)))
    whole = ranked.where("__take <= 0 or __take >= n").withColumn("__r", F.lit(1))
    both = whole.unionByName(cut)
    return both.withColumn("split", F.when(F.col("__r") <= F.col("__take"), "train").otherwise("test")).drop("__h", "__b", "__take", "__r", "n")


def expand(df: DataFrame, variants: int = VARIANTS, attempts: int = ATTEMPTS) -> DataFrame:
    """K3: a row for each variant and attempt."""
    out = df.withColumn("variant_idx", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    return out.withColumn("attempt_idx", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))


def good_variants(df: DataFrame) -> DataFrame:
    """K4: per path and variant, in order of the attempts: those with a new code fingerprint and a telling image that is neither the original's nor near it nor one seen before.

    Columns: path, variant_idx, attempt_idx, code_sig, image_sig, low_information, different (Q3 against the original),
    original_sig. Only an attempt that is taken makes its code and image seen. The signatures come from columns computed
    before, so a group is a few short rows (as many as attempts).
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, looks, kept = set(), set(), []
        for row in pdf.sort_values("attempt_idx").itertuples():
            dull = row.low_information or pd.isna(row.image_sig) or row.image_sig == row.original_sig or not row.different
            if dull or row.code_sig in codes or row.image_sig in looks:
                continue
            codes.add(row.code_sig)
            looks.add(row.image_sig)
            kept.append(row.Index)
        return pdf.loc[kept]

    return df.groupBy("path", "variant_idx").applyInPandas(pick, df.schema)


def two_key_dedup(spark: SparkSession, df: DataFrame, first: str, second: str, order_by: str, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """K5: in order of `order_by`, a row is kept if neither of its keys is in a row kept before; rows without `first` go.

    The order decides, so this isn't one dedup after another. Per round a row is kept if it is the smallest live one
    for both its keys; then all live rows that share a key with a kept one go. Each round keeps at least the smallest
    row of every group of connected rows. Rounds are written to the shared folder, so the plan stays short. Both
    minima are partial aggregates. As soon as no more than `finish_rows` rows are live, one task goes through them in
    order, which ends long chains too. Rows with a null `second` have a key of their own; order_by must be unique.
    """
    own = F.concat(F.lit("\0"), F.col(order_by).cast("string"))
    live = settle(spark, df.where(F.col(first).isNotNull()).select(F.col(order_by).alias("o"), F.col(first).cast("string").alias("a"), F.coalesce(F.col(second).cast("string"), own).alias("b")))
    kept = []
    while live.limit(finish_rows + 1).count() > finish_rows:
        by_a = live.groupBy("a").agg(F.min("o").alias("ma"))
        by_b = live.groupBy("b").agg(F.min("o").alias("mb"))
        won = settle(spark, live.join(by_a, "a").join(by_b, "b").where("o = ma and o = mb").select("o", "a", "b"))
        kept.append(won.select("o"))
        live = settle(spark, live.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti").select("o", "a", "b"))

    def in_order(rest: pd.DataFrame) -> pd.DataFrame:
        firsts, seconds, taken = set(), set(), []
        for row in rest.sort_values("o").itertuples(index=False):
            if row.a not in firsts and row.b not in seconds:
                firsts.add(row.a)
                seconds.add(row.b)
                taken.append(row.o)
        return pd.DataFrame({"o": pd.Series(taken, dtype=rest.o.dtype)})

    last = live.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(in_order, live.select("o").schema)
    for won in kept:
        last = last.unionByName(won)
    return df.join(last.select(F.col("o").alias(order_by)), order_by, "left_semi")


def without_failed(df: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """K6: rows whose key isn't among the failed ones."""
    return df.join(failed.select(key), key, "left_anti")


def failed_names(df: DataFrame, group: str, name: str) -> DataFrame:
    """K7: the distinct failed names of each group, a row each."""
    return df.where(F.col(name).isNotNull()).select(group, name).distinct()


def failed_by_group(df: DataFrame, group: str, name: str) -> DataFrame:
    """K7: the number of distinct failed names by group; a null name counts none."""
    return df.groupBy(group).agg(F.count_distinct(name).alias("n_failed"))


def re_rooted(path: Column, base: str, target: str) -> Column:
    """K2, K9: the path below another root; a script keeps its whole relative path, so equal names don't meet."""
    return F.concat(F.lit(target.rstrip("/")), F.substring(path, len(base.rstrip("/")) + 1, 1 << 20))


def image_facts(df: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Q1, Q2 and Q4 of a column of decoded images."""
    flat = F.flatten(F.col(pixels))
    return df.withColumns({"image_sig": images.signature_udf(pixels), "low_information": images.low_information(flat), "good_enough": images.good_enough(F.col(pixels))})
