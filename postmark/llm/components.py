"""Connected components of a graph given as a DataFrame of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import store


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round: every neighbour that is larger (large star), or smaller with the vertex itself (small star), is tied to the least one.

    ``edges`` has each link once with a > b. The least neighbour comes from a partial aggregation, so a hub isn't gathered.
    """
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.where("a <> b").distinct()


def components(links: DataFrame, folder: str, name: str = "cc") -> DataFrame:
    """(id, component): the least id reachable from each id that has a link. ``links`` has columns a and b.

    Null ends and self-links are ignored, repeated links count once; no links give an empty table.
    Each round is written to the shared folder, which ends its lineage; rounds end when one changes nothing.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = store(edges, folder, f"{name}-0")
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before, n = sign(edges), 0
    while before[0]:
        n += 1
        edges = store(_star(_star(edges, small=False), small=True), folder, f"{name}-{n}")
        after = sign(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
