"""Area-weighted statistics, digests and shapes of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut


def area_stats(cells: DataFrame, sea: float = 0.0) -> DataFrame:
    """cells (z, area) -> least, greatest, ocean_fraction."""
    return cells.agg(F.min("z").alias("least"), F.max("z").alias("greatest"), (F.sum(F.when(F.col("z") <= sea, F.col("area")).otherwise(0)) / F.sum("area")).alias("ocean_fraction"))


def area_percentiles(cells: DataFrame, qs: list[float]) -> DataFrame:
    """q, z: the first z at which the area up to it reaches q of the total.

    Areas are summed per z, sorted into ranges over all tasks and written; the sums of whole ranges (one row each) tell in which range each q
    falls, and only within ranges is the running sum taken."""
    place = F.monotonically_increasing_id()
    per_z = cut(cells.groupBy("z").agg(F.sum("area").alias("area")).repartitionByRange("z").sortWithinPartitions("z").withColumn("__p", F.shiftright(place, 33)), "per_z")
    ranges = per_z.groupBy("__p").agg(F.sum("area").alias("area"))
    before = ranges.select("__p", F.coalesce(F.sum("area").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("area").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("__p").orderBy("z")
    run = per_z.join(F.broadcast(before), "__p").select("z", (F.col("before") + F.sum("area").over(inside)).alias("upto"), "total")
    wanted = F.explode(F.array(*map(F.lit, qs))).alias("q")
    return run.select("z", "upto", "total", wanted).where(F.col("upto") >= F.col("q") * F.col("total")).groupBy("q").agg(F.min("z").alias("z"))


def hypsometry(cells: DataFrame, low: float = -8000.0, width: float = 500.0, bins: int = 32) -> DataFrame:
    """bin, permille of area; heights outside go to the end bins."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("z") - low) / width))).cast("int")
    h = cells.groupBy(b.alias("bin")).agg(F.sum("area").alias("area"))
    return h.crossJoin(F.broadcast(cells.agg(F.sum("area").alias("total")))).select("bin", (1000 * F.col("area") / F.col("total")).alias("permille"))


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """n, digest: the same whatever the order of rows. Two sums of hashes over all rows, repeated ones too, so that none cancel each other."""
    known = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    sums = (F.sum(F.xxhash64(F.lit(seed), *known).cast("decimal(38,0)")) for seed in (0, 1))
    return rows.agg(F.count("*").alias("n"), F.sha1(F.concat_ws(",", F.count("*"), *sums)).alias("digest"))


def layer_ranges(cells: DataFrame, layers: list[str]) -> DataFrame:
    """layer, least, greatest of each layer, in one pass."""
    both = F.array(*(F.struct(F.lit(c).alias("layer"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest")) for c in layers))
    return cells.agg(both.alias("r")).select(F.inline("r"))


def correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.agg(F.corr(a, b).alias("r"))


def area_centroid(cells: DataFrame) -> DataFrame:
    """cells (x, y, z, area, land) -> x, y, z: the unit vector of the land's middle, and its share of all area."""
    m = [F.sum(F.when(F.col("land"), F.col("area") * F.col(c))).alias(f"m{c}") for c in "xyz"]
    t = cells.agg(*m, (F.sum(F.when(F.col("land"), F.col("area")).otherwise(0.0)) / F.sum("area")).alias("share"))
    n = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
    return t.select(*((F.col(f"m{c}") / n).alias(c) for c in "xyz"), "share")


def suitable(cells: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """species, hits, mass: how many cells suit each, and the sum of their scores; in one pass."""
    each = F.array(*(F.struct(F.lit(n).alias("species"), F.count_if(s > 0).alias("hits"), F.sum(s).alias("mass")) for n, s in scores.items()))
    return cells.agg(each.alias("r")).select(F.inline("r"))


def normalise_precipitation(cells: DataFrame, mean: float = 900.0, cap: float = 5000.0) -> DataFrame:
    """cells (p, area) with p scaled to an area mean, and capped."""
    m = cells.agg((F.sum(F.col("p") * F.col("area")) / F.sum("area")).alias("__m"))
    return cells.crossJoin(F.broadcast(m)).withColumn("p", F.least(F.lit(cap), F.col("p") * mean / F.col("__m"))).drop("__m")
