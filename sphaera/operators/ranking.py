"""Ranks, tiers and choices by score."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import cut, drop
from .graph import shortest


def ranked(rows: DataFrame, score: str, key: str, by: str | None = None) -> DataFrame:
    """rows with rank from 0 by descending score, ties to the smaller key; within `by`, or over all.

    Without `by`, rows are sorted into ranges over all tasks, written once, and each range gets its offset, so that no task sees them all."""
    if by is not None:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key)) - 1)
    order = [F.desc(score), F.col(key)]
    ranges = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    ranges = ranges.withColumns({"__p": F.shiftright("__at", 33), "__i": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at")
    sizes = ranges.groupBy("__p").agg(F.count("*").alias("__n"))
    offset = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranges.join(F.broadcast(offset.select("__p", "__before")), "__p").withColumn("rank", F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")


def zipf(rows: DataFrame, top: float = 60000.0, power: float = 0.95) -> DataFrame:
    """rows (rank from 0) with the population of a settlement of that rank."""
    return rows.withColumn("population", top / F.pow(F.col("rank") + 1, F.lit(power)))


def tiers(rows: DataFrame) -> DataFrame:
    """rows (rank) with tier 0 for the first twelfth (one at least), 1 to the first third (two at least), else 2."""
    n = rows.agg(F.count("*").alias("__n"))
    first, second = F.greatest(F.lit(1), F.floor(F.col("__n") / 12)), F.greatest(F.lit(2), F.floor(F.col("__n") / 3))
    return rows.crossJoin(F.broadcast(n)).withColumn("tier", F.when(F.col("rank") < first, 0).when(F.col("rank") < second, 1).otherwise(2)).drop("__n")


def capitals(rows: DataFrame, group: str, population: str, key: str, most: int = 14) -> DataFrame:
    """The most populous of each group, two where it has six members or more, and of these the first `most`."""
    w = Window.partitionBy(group)
    r = rows.withColumns({"__i": F.row_number().over(w.orderBy(F.desc(population), key)), "__n": F.count("*").over(w)})
    own = r.where((F.col("__i") == 1) | ((F.col("__i") == 2) & (F.col("__n") >= 6))).drop("__i", "__n")
    return own.orderBy(F.desc(population), key).limit(most)


def hearths(rows: DataFrame, group: str, population: str, key: str, most: int = 4, apart: float = 25.0) -> DataFrame:
    """rows (key, group, population, unit vectors px, py, pz) -> group, nth (from 1), key: of each group the most populous members, each at least `apart`
    degrees from those before it: a sixth of the group's number, one at least and `most` at most. Ties go to the smaller key; rows with a null take no part.

    A round finds the next one of all groups by a partial maximum and strikes what is too near it, so no task sees a whole group."""
    whole = rows.select(F.col(group).alias("g"), F.col(population).alias("p"), F.col(key).alias("k"), "px", "py", "pz").na.drop()
    size = whole.groupBy("g").agg(F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.count("*") / 6))).alias("quota"))
    left, out = whole.join(size, "g"), None
    for nth in range(1, most + 1):
        first = left.where(F.col("quota") >= nth).groupBy("g").agg(F.max(F.struct("p", (-F.col("k")).alias("k"), "px", "py", "pz")).alias("h"))
        first = cut(first.select("g", (-F.col("h.k")).alias("h"), F.col("h.px").alias("hx"), F.col("h.py").alias("hy"), F.col("h.pz").alias("hz")), "hearths")
        left = left.join(first.drop("h"), "g").where(F.col("hx") * F.col("px") + F.col("hy") * F.col("py") + F.col("hz") * F.col("pz") < math.cos(math.radians(apart))).drop("hx", "hy", "hz")
        own = first.select(F.col("g").alias(group), F.lit(nth).cast("long").alias("nth"), F.col("h").alias(key))
        out = own if out is None else out.unionByName(own)
    return out


#: Places of a list of trunk ends at most.
ENDS = 100


def trunks(places: DataFrame, edges: DataFrame, most: int = 14, within: float = 45.0) -> DataFrame:
    """places (place, population; a list of up to ENDS), edges (src, dst, w in days) -> a, b, days, pull of the pairs with the strongest
    pull p * q / (days * days + 1), whose way takes less than `within` days. Ways are searched from all places at once."""
    if places.limit(ENDS + 1).count() > ENDS:
        raise ValueError(f"more than {ENDS} places")
    near = shortest(edges, places.select(F.col("place").alias("source"), F.col("place").alias("node")), within).where(F.col("dist") < within)
    a, b = places.toDF("source", "pa"), places.toDF("node", "pb")
    pairs = near.where("source < node").join(F.broadcast(a), "source").join(F.broadcast(b), "node")
    days = F.col("dist").cast("double")
    return pairs.select(F.col("source").alias("a"), F.col("node").alias("b"), days.alias("days"), (F.col("pa") * F.col("pb") / (days * days + 1)).alias("pull")).orderBy(F.desc("pull"), "a", "b").limit(most)


def spaced(candidates: DataFrame, score: str, key: str, apart_deg: float, most: int) -> DataFrame:
    """Greedy choice of up to `most` of all candidates (lon, lat), best first: each farther than apart_deg from all chosen before.

    In rounds: a candidate that is the best of all open ones within the distance is chosen whatever comes before it, as no better one can strike it;
    those within the distance of a chosen one are struck. Only the best of each cube of space can be chosen, so these few are compared with one another,
    cube by neighbouring cube. When `most` are chosen and nothing open is better than the last of them, the rest is of no account.
    Candidates without a place (null or NaN) are not chosen."""
    side = 2 * math.sin(math.radians(apart_deg) / 2)
    least = math.cos(math.radians(apart_deg))
    x, y, z = geo.direction(F.col("lon"), F.col("lat"))
    # Cubes so small that all of one are within the distance of each other: at most the best of a cube is chosen in a round.
    cube = lambda c, n: F.floor(F.col(c) / (side / math.sqrt(3))).cast("int").alias(n)
    at = candidates.where("NOT (isnan(lon) OR isnan(lat) OR lon IS NULL OR lat IS NULL)").select(F.col(key).alias("__key"), F.col(score).alias("__s"), x.alias("__x"), y.alias("__y"), z.alias("__z"))
    open_ = cut(at.select("*", *(cube(f"__{c}", f"__{n}") for c, n in zip("xyz", "ijk", strict=True))), "open")
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(c).alias("k")) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3)))).alias("__d")
    place = ["__i", "__j", "__k"]

    def around(df: DataFrame, tag: str) -> DataFrame:
        """Rows at their own cube and the ones around it that the distance can reach, columns renamed."""
        moved = df.select("*", steps).select(*((F.col(f"__{n}") + F.col(f"__d.{n}")).alias(f"__{n}") for n in "ijk"), *(F.col(f"__{c}").alias(f"{tag}{c}") for c in ("key", "s", "x", "y", "z")))
        return moved

    dot = F.col("__x") * F.col("tx") + F.col("__y") * F.col("ty") + F.col("__z") * F.col("tz")
    chosen = None
    while True:
        best = cut(open_.groupBy(*place).agg(F.max_by(F.struct(*open_.columns), F.struct(F.col("__s"), -F.col("__key"))).alias("b")).select("b.*"), "best")
        beaten = best.join(around(best, "t"), place).where((dot >= least) & (F.col("tkey") != F.col("__key")) & ((F.col("ts") > F.col("__s")) | ((F.col("ts") == F.col("__s")) & (F.col("tkey") < F.col("__key"))))).select("__key").distinct()
        now = cut(best.join(beaten, "__key", "left_anti"), "chosen")
        chosen = now if chosen is None else cut(chosen.unionByName(now), "chosen")
        left = cut(open_.join(around(now, "t"), place, "left").withColumn("near", F.coalesce(dot >= least, F.lit(False))).groupBy(*open_.columns).agg(F.max("near").alias("near")).where("NOT near").drop("near"), "open")
        drop(open_)
        drop(best)
        open_ = left
        top = open_.agg(F.max("__s")).first()[0]
        if top is None or chosen.where(F.col("__s") > top).count() >= most:
            break
    keep = chosen.orderBy(F.desc("__s"), "__key").limit(most).select(F.col("__key").alias(key))
    return candidates.join(F.broadcast(keep), key, "left_semi")
