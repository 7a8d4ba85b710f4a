"""Borders between regions of a grid: edges, the lines along them, and unions of what phases have made."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, drop


def edges(regions: DataFrame, adjacency: DataFrame) -> DataFrame:
    """regions (cell, region; null at sea) -> a, b: neighbouring land cells of two regions, each pair once with the smaller cell first."""
    r = regions.where("region IS NOT NULL").select("cell", "region")
    both = adjacency.where("src < dst").select("src", "dst").join(r.toDF("src", "ra"), "src").join(r.toDF("dst", "rb"), "dst")
    return both.where("ra != rb").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def common_neighbours(pairs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """pairs (a, b) -> a, b, c: each neighbour that both have."""
    of_a, of_b = adjacency.select(F.col("src").alias("a"), F.col("dst").alias("c")), adjacency.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return pairs.join(of_a, "a").join(of_b, ["b", "c"]).select("a", "b", "c")


def segments(regions: DataFrame, adjacency: DataFrame, cells: DataFrame) -> DataFrame:
    """a, b, p, q: of each border edge the two corners that its dual edge joins, as places rounded to thousandths of a degree. A corner is the
    middle of the edge's cells and a neighbour that both have (of more than two, the two smallest)."""
    pairs = edges(regions, adjacency)
    c = common_neighbours(pairs, adjacency).groupBy("a", "b").agg(F.slice(F.sort_array(F.collect_list("c")), 1, 2).alias("c")).where(F.size("c") == 2)
    at = cells.select("cell", F.struct("x", "y", "z").alias("v"))
    j = c.select("a", "b", F.posexplode("c").alias("k", "c")).join(at.toDF("a", "va"), "a").join(at.toDF("b", "vb"), "b").join(at.toDF("c", "vc"), "c")
    s = {n: F.col(f"va.{n}") + F.col(f"vb.{n}") + F.col(f"vc.{n}") for n in "xyz"}
    n = F.sqrt(sum(v * v for v in s.values()))
    thousandth = lambda v: F.floor(v * 1000 + 0.5) / 1000
    place = F.struct(thousandth(F.degrees(F.atan2(s["z"] / n, s["x"] / n))).alias("lon"), thousandth(F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s["y"] / n))))).alias("lat"))
    both = j.select("a", "b", "k", place.alias("p")).groupBy("a", "b").agg(F.min_by("p", "k").alias("p"), F.max_by("p", "k").alias("q"))
    return both.where("p != q")


def polylines(parts: DataFrame) -> DataFrame:
    """segments (p, q) -> line, at: lines of corners, such that each different segment is in one line, and two corners that follow each other are a
    segment's ends. Lines end where one segment or more than two meet; a ring begins and ends at its smallest corner.

    Each segment is two half-edges, u to v and back. Where two segments meet, a half-edge follows another; ranks along a line come from pointer
    doubling: in a round each half-edge joins the one that its pointer has reached and takes over its pointer, so the rounds are the logarithm of
    the longest line. Half-edges that reach no start are on rings: they keep the smallest half-edge passed and how far back it is, until a
    round changes none. Of a line's two directions the one that begins smaller stays. A null end is no segment, equal ends aren't one either."""
    both = parts.select("p", "q").union(parts.select("q", "p")).toDF("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct()
    meet = both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("one"), F.max("v").alias("two"))
    before = F.when(F.col("n") == 2, F.when(F.col("v") == F.col("one"), F.col("two")).otherwise(F.col("one")))
    own = F.struct("u", "v")
    # at: the half-edge that the pointer has reached, hops back; null once the start of the line is reached, which top then is.
    start = both.join(meet, "u").withColumn("w", before).withColumn("at", F.when(F.col("w").isNotNull(), F.struct(F.col("w").alias("u"), F.col("u").alias("v"))))
    state = cut(start.select(own.alias("half"), "at", F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.when(F.col("at").isNull(), own).alias("top"), own.alias("least"), F.lit(0).cast("long").alias("back"), F.lit(True).alias("moved")))
    open_, left = state.where("at IS NOT NULL").count(), -1
    moved = True
    while open_ and (open_ != left or moved):  # as long as a line is open, more of its half-edges reach the start in each round
        o = state.select(F.col("half").alias("at"), F.col("at").alias("o_at"), F.col("hops").alias("o_hops"), F.col("top").alias("o_top"), F.col("least").alias("o_least"), F.col("back").alias("o_back"))
        less = F.col("o_least") < F.col("least")
        on = state.where("at IS NOT NULL").join(o, "at").select(
            "half", F.col("o_at").alias("at"), (F.col("hops") + F.col("o_hops")).alias("hops"), F.col("o_top").alias("top"),
            F.when(less, F.col("o_least")).otherwise(F.col("least")).alias("least"), F.when(less, F.col("hops") + F.col("o_back")).otherwise(F.col("back")).alias("back"), less.alias("moved"),
        )
        new = cut(state.where("at IS NULL").unionByName(on))
        drop(state)
        state, left = new, open_
        open_, moved = state.where("at IS NOT NULL").agg(F.count("*"), F.coalesce(F.max("moved"), F.lit(False))).first()
    ranked = state.select(F.coalesce("top", "least").alias("line"), F.when(F.col("at").isNull(), F.col("hops")).otherwise(F.col("back")).alias("rank"), "half")
    corners = F.transform(F.sort_array(F.collect_list(F.struct("rank", "half"))), lambda x: x["half"]["u"])
    lines = ranked.groupBy("line").agg(F.concat(corners, F.array(F.max_by("half.v", "rank"))).alias("at"))
    ends = F.struct(F.element_at("at", 1), F.element_at("at", 2)) < F.struct(F.element_at("at", -1), F.element_at("at", -2))
    return lines.where(ends).select(F.xxhash64("line").alias("line"), "at")


def collect(phases: Mapping[str, DataFrame]) -> DataFrame:
    """The records (or features) of all phases in one table, with the phase's name; columns that one lacks are null."""
    out = None
    for name, df in phases.items():
        part = df.withColumn("phase", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def of_kind(features: DataFrame, kind: str | None = None) -> DataFrame:
    return features if kind is None else features.where(F.col("kind") == kind)


def network(roads: DataFrame, settlements: DataFrame, era: int) -> DataFrame:
    """cell: all road cells, and those of settlements of earlier eras; with neither, the first settlement of this era (by ord)."""
    old = roads.select("cell").union(settlements.where(F.col("era") < era).select("cell")).distinct()
    first = settlements.where(F.col("era") == era).orderBy("ord").limit(1).select("cell")
    none = old.agg((F.count("*") == 0).alias("none"))
    return old.union(first.crossJoin(F.broadcast(none)).where("none").select("cell"))


def counts_by_kind(records: DataFrame) -> DataFrame:
    return records.groupBy("kind").agg(F.count("*").alias("n"))
