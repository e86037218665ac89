"""House numbers: the nearest existing one, interpolation between neighbours, interval containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Offsets tried for a missing number, in order of preference.
OFFSETS = (2, -2, 4, -4, 6, -6, 1, -1, 3, -3, 5, -5)


def nearest_number(probes: DataFrame, points: DataFrame) -> DataFrame:
    """(id, street_id, number, found): the first existing number in the order of ``OFFSETS`` for each probe."""
    tried = probes.select("id", "street_id", "number", F.posexplode(F.array(*(F.lit(o) for o in OFFSETS))).alias("rank", "o"))
    hit = tried.withColumn("found", F.col("number") + F.col("o")).join(points.select("street_id", F.col("number").alias("found")).distinct(), ["street_id", "found"])
    return hit.groupBy("id", "street_id", "number").agg(F.min_by("found", "rank").alias("found"))


def interpolate(probes: DataFrame, points: DataFrame, reach: int = 600, gap: int = 1000) -> DataFrame:
    """Each probe's place between the next lower and next higher numbers of its street and parity.

    One window over probes and points together finds both neighbours, so there is no non-equi join.
    """
    both = probes.select("id", "street_id", "number", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng")).unionByName(points.select(F.lit(None).cast("long").alias("id"), "street_id", "number", "lat", "lng"))
    at = F.when(F.col("id").isNull(), F.struct("number", "lat", "lng"))
    w = W.partitionBy("street_id", F.col("number") % 2).orderBy("number")
    low = F.last(at, ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, -1))
    high = F.first(at, ignorenulls=True).over(w.rangeBetween(1, W.unboundedFollowing))
    rows = both.withColumn("low", low).withColumn("high", high).where("id is not null and low is not null and high is not null")
    n = F.col("number")
    rows = rows.where((n - F.col("low.number") <= reach) & (F.col("high.number") - n <= reach) & (F.col("high.number") - F.col("low.number") <= gap))
    share = (n - F.col("low.number")) / (F.col("high.number") - F.col("low.number"))
    mix = lambda c: F.col(f"low.{c}") + (F.col(f"high.{c}") - F.col(f"low.{c}")) * share
    return rows.select("id", "street_id", "number", mix("lat").alias("lat"), mix("lng").alias("lng"))
