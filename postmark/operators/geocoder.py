"""Cross-checking a geocoder's answer, and whether a text lies in an area's coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Metres within which an answer agrees, from which it disagrees, and from which it is elsewhere.
AGREE_M, DISAGREE_M, ELSEWHERE_M = 250, 1000, 2000


def verdict(metres: Column, number: Column, postal: Column, route: Column) -> Column:
    """VERIFIED, PLAUSIBLE, MISSING_NUMBER, STREET_LEVEL or REJECTED from the distance and the fields' agreement (CONFIRMED, CONFLICT or absent)."""
    conflict = (number == "CONFLICT") | (postal == "CONFLICT") | (route == "CONFLICT")
    return (
        F.when(metres >= ELSEWHERE_M, "REJECTED").when(conflict & (metres > AGREE_M), "REJECTED").when(number.isNull() & (route == "CONFIRMED"), "MISSING_NUMBER").when(number.isNull(), "STREET_LEVEL")
        .when((metres <= AGREE_M) & ~conflict, "VERIFIED").when(metres < DISAGREE_M, "PLAUSIBLE").otherwise("REJECTED")
    )


def coverage(evidence: DataFrame, key: str = "id") -> DataFrame:
    """(key, status): OUTSIDE where weighted outside evidence exceeds inside, INSIDE where there is inside evidence, else UNKNOWN. ``evidence`` has key, weight and a flag ``within``."""
    g = evidence.groupBy(key).agg(F.sum(F.when(F.col("within"), F.col("weight")).otherwise(0.0)).alias("w_in"), F.sum(F.when(F.col("within"), 0.0).otherwise(F.col("weight"))).alias("w_out"))
    return g.select(key, F.when(F.col("w_out") > F.col("w_in"), "OUTSIDE").when(F.col("w_in") > 0, "INSIDE").otherwise("UNKNOWN").alias("status"))


def national_recall(probes: DataFrame, points: DataFrame, most: int = 3000) -> DataFrame:
    """(id, point_id, route): candidates by number and postcode; for probes without any, by number and name prefix, at most ``most`` a probe by least id.

    Points are ranked within their number and prefix before any probe meets them, so what is sorted doesn't grow with the pairs.
    """
    p = points.select("point_id", "nkey", "postcode", "s3")
    first = probes.select("id", "nkey", "postcode").join(p, ["nkey", "postcode"]).select("id", "point_id", F.lit("postcode").alias("route"))
    rest = probes.join(first.select("id").distinct(), "id", "left_anti").select("id", "nkey", "s3")
    p = p.withColumn("r", F.row_number().over(W.partitionBy("nkey", "s3").orderBy("point_id"))).where(F.col("r") <= most)
    rest = rest.join(p, ["nkey", "s3"]).select("id", "point_id", F.lit("prefix").alias("route"))
    return first.unionByName(rest)


def homonyms(places: DataFrame, most: int = 40) -> DataFrame:
    """Of the places that share a name, the ``most`` of most people (ties to the least place_id) and all with the flag ``in_pilot``."""
    r = F.row_number().over(W.partitionBy("name").orderBy(F.desc_nulls_last("population"), "place_id"))
    return places.withColumn("r", r).where((F.col("r") <= most) | F.col("in_pilot")).drop("r")
