"""Evaluation: calibration, ranking quality, outcome classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def calibration(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over half-open bins, and the Brier score."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    g = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("y"), F.sum(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("s"))
    return g.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("s") / F.sum("n")).alias("brier"))


def auroc(rows: DataFrame, score: str, y: str) -> DataFrame:
    """One row: the area under the ROC curve by mid-ranks.

    Scores are counted first, so the running sum is over distinct scores and not over rows.
    """
    g = rows.groupBy(score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    below = F.sum("neg").over(W.orderBy(score).rowsBetween(W.unboundedPreceding, -1))
    g = g.withColumn("below", F.coalesce(below, F.lit(0)))
    return g.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auroc"))
