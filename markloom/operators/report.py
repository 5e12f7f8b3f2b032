"""Evaluation of runs: scores, summaries, comparison of two runs, ranking, and training loss."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, pycode
from . import corpus

METRICS = ("ssim", "bleu", "edit_sim", "api_sim", "code_score", "overall")


def evaluate(rows: DataFrame) -> DataFrame:
    """M7, M8: rows (image, code, ref_code, generated_code, ref_spec, generated_spec, ssim, execution_success) with all scores.

    Rows without image or code are left out. A failed execution scores 0, except for the scores of its spec.
    """
    kept = corpus.with_sample(rows)
    calls = kept.withColumns({"__a": pycode.script_facts("ref_code"), "__b": pycode.script_facts("generated_code")})
    overlap = metrics.call_overlap(F.col("__a.method_calls"), F.col("__b.method_calls"))
    scored = calls.withColumns({"bleu": metrics.bleu_udf("ref_code", "generated_code"), "edit_sim": metrics.edit_similarity_udf("ref_code", "generated_code"), "api_sim": overlap["api_sim"], "__ir": metrics.ir_scores_udf("ref_spec", "generated_spec")})
    scored = scored.withColumn("code_score", metrics.code_score(F.col("bleu"), F.col("edit_sim"), F.col("api_sim")))
    scored = scored.withColumn("overall", metrics.overall(F.coalesce("ssim", F.lit(0.0)), F.col("code_score")))
    counted = {m: metrics.on_success(F.coalesce("execution_success", F.lit(False)), F.coalesce(m, F.lit(0.0))) for m in METRICS}
    return scored.withColumns(counted).select("*", "__ir.*").drop("__a", "__b", "__ir")


def run_summary(results: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """Per run the rows, successes, their share, and mean and sample deviation over successes."""
    ok = F.col("execution_success")
    stats = [f(F.when(ok, F.col(m))).alias(f"{p}_{m}") for m in names for p, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return results.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_success"), (F.count_if(ok) * 100.0 / F.count(F.lit(1))).alias("success_pct"), *stats)


def changes(base: Column, new: Column) -> tuple[Column, Column]:
    """Absolute change, and relative change in percent; 0 where the base isn't positive."""
    return new - base, F.when(base > 0, (new - base) / base * 100).otherwise(0.0)


def compare(results: DataFrame, base: str, new: str, names: tuple[str, ...] = METRICS) -> DataFrame:
    """Metric, base, new, absolute, relative: means over successes, and the success rate over all rows."""
    ok = F.col("execution_success")
    means = results.groupBy("run").agg(*(F.avg(F.when(ok, F.col(m))).alias(m) for m in names), F.avg(ok.cast("double")).alias("success_rate"))
    long = means.unpivot(["run"], [*names, "success_rate"], "metric", "value")
    wide = long.groupBy("metric").agg(*(F.coalesce(F.max(F.when(F.col("run") == r, F.col("value"))), F.lit(0.0)).alias(n) for r, n in ((base, "base"), (new, "new"))))
    absolute, relative = changes(F.col("base"), F.col("new"))
    return wide.withColumns({"absolute": absolute, "relative": relative})


def rank_improvements(comparison: DataFrame, top: int = 2) -> DataFrame:
    """P5: the metrics with the largest relative change; a report of `top` rows out of a handful."""
    ranked = comparison.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("relative"), "metric")))
    return ranked.where(F.col("rank") <= top)


def loss_summary(log: DataFrame) -> DataFrame:
    """Of (step, loss): first, last and smallest loss, the first step with the smallest, reduction and number."""
    rows = log.where("loss is not null and step is not null")
    ends = rows.agg(F.min(F.struct("step", "loss")).alias("a"), F.max(F.struct("step", "loss")).alias("b"), F.min(F.struct("loss", "step")).alias("m"), F.count(F.lit(1)).alias("n_points"))
    first, last = F.col("a.loss"), F.col("b.loss")
    return ends.select(first.alias("first_loss"), last.alias("last_loss"), (first - last).alias("reduction"), (F.try_divide(first - last, first) * 100).alias("reduction_pct"), F.col("m.loss").alias("min_loss"), F.col("m.step").alias("min_step"), "n_points")


def moments(log: DataFrame) -> DataFrame:
    """The sums that a quadratic fit needs, in one pass."""
    x, y = F.col("step").cast("double"), F.col("loss").cast("double")
    powers = [F.sum(reduce(Column.__mul__, [x] * k, F.lit(1.0))).alias(f"s{k}") for k in range(5)]
    return log.where("loss is not null and step is not null").agg(*powers, *(F.sum(reduce(Column.__mul__, [x] * k, y)).alias(f"t{k}") for k in range(3)))


def quadratic_trend(log: DataFrame) -> tuple[float, float, float] | None:
    """A, b, c of a*step^2 + b*step + c by least squares; None with fewer than three steps."""
    row = moments(log).first()
    if not row["s0"] or row["s0"] < 3:
        return None
    a = np.array([[row[f"s{i + j}"] for j in range(3)] for i in range(3)], dtype=float)
    c, b, a2 = np.linalg.lstsq(a, np.array([row[f"t{k}"] for k in range(3)], dtype=float), rcond=None)[0]
    return float(a2), float(b), float(c)
