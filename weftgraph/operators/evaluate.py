"""Measures of a ranking, ``scored(score, positive)``; rows of one score are one step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import running


def _steps(scored: DataFrame) -> DataFrame:
    """By score from the top: positives and negatives of a step, and up to it."""
    steps = scored.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    return running(steps, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")})


def max_accuracy(scored: DataFrame) -> DataFrame:
    """The best accuracy of any threshold, taking none included."""
    total = scored.agg(F.count("*").alias("all"), F.count_if(~F.col("positive")).alias("neg")).first()
    best = _steps(scored).agg(F.max(F.col("tp") + total["neg"] - F.col("fp")).alias("b"))
    return best.select((F.greatest(F.col("b"), F.lit(total["neg"])) / max(total["all"], 1)).alias("max_accuracy"))


def roc_auc(scored: DataFrame) -> DataFrame:
    total = scored.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")).first()
    area = _steps(scored).agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)).alias("a"))
    return area.select((F.col("a") / max(total["p"] * total["n"], 1)).alias("roc_auc"))


def median_rfp(scored: DataFrame) -> DataFrame:
    """Share of the negatives that stand before the median positive."""
    total = scored.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")).first()
    half = (total["p"] + 1) // 2
    steps = _steps(scored).where((F.col("tp") >= half) & (F.col("tp") - F.col("p") < half))
    return steps.agg((F.max(F.col("fp") - F.col("n")) / max(total["n"], 1)).alias("median_rfp"))


def roc_n(scored: DataFrame, most: int) -> DataFrame:
    """The area up to ``most`` false positives, of the rectangle of all positives and the false ones met; steps are taken whole."""
    total = scored.agg(F.count_if("positive").alias("p")).first()["p"]
    met = _steps(scored).where(F.col("fp") - F.col("n") < most)
    sums = met.agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)).alias("a"), F.max("fp").alias("fp"))
    return sums.select(F.when((F.col("fp") > 0) & F.lit(total > 0), F.col("a") / (F.lit(total) * F.col("fp"))).otherwise(0.0).alias("roc_n"))
