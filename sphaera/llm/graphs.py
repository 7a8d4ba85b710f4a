"""Connected components of links by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_unique, stored


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = e.select("u", "v").union(e.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return join_unique(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. e holds (u, v) with v < u."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return join_unique(e, least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) in any direction, repeats and loops allowed -> (node, root): the smallest node reachable, for every node that has a link to another.

    Each round is joins and partial minima over the links, written to the shared folder; their number grows with the
    logarithm of the largest component. Only a count and a checksum come to the driver."""
    e = stored(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = state(e)
    while before[0]:
        after = stored(_small_star(_large_star(e)), "links")
        forget(e)
        e, now = after, state(after)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
