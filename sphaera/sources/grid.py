"""Geodesic grids, rasters and point sets, generated as DataFrames by closed-form expressions.

A grid of frequency F has 10 F**2 + 2 cells in rows 0..3F around a z-up icosahedron, whose corners are the pole 0, an upper ring 1 to 5, a
lower ring 6 to 10 and the pole 11. A cell is a whole number of weights, F in all, on the corners of a face: on three of them within a face,
on two along an edge, on one at a corner. That tells cells apart whatever face they are seen from, so neighbours need no cases: a neighbour has
one weight moved to another corner of a face that holds both. Ids are counted by rows; their expressions are plain SQL text, so that an
oracle can evaluate the same ones elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the warp that evens out cell areas, and of the sphere.
WARP_ALPHA, WARP_BETA = 0.5372, -0.4637
RADIUS_KM = 6371.0


def width(f: int | str, row: str = "row") -> str:
    """SQL: cells of a row; the frequency is a number or SQL."""
    return f"(CASE WHEN {row} = 0 OR {row} = 3 * {f} THEN 1 WHEN {row} < {f} THEN 5 * {row} WHEN {row} <= 2 * {f} THEN 5 * {f} ELSE 5 * (3 * {f} - {row}) END)"


def first(f: int | str, row: str = "row") -> str:
    """SQL: id of a row's first cell, the number of cells before it."""
    return (
        f"(CASE WHEN {row} = 0 THEN 0 WHEN {row} <= {f} THEN CAST(1 + 5 * {row} * ({row} - 1) / 2 AS BIGINT)"
        f" WHEN {row} <= 2 * {f} THEN CAST(1 + 5 * {f} * ({f} - 1) / 2 AS BIGINT) + 5 * {f} * ({row} - {f})"
        f" ELSE CAST(10 * {f} * {f} + 1 - 5 * (3 * {f} - {row}) * (3 * {f} - {row} + 1) / 2 AS BIGINT) END)"
    )


def stride(f: int) -> str:
    return f"(CASE WHEN row = 0 OR row = {3 * f} THEN 1 ELSE CAST({width(f)} / 5 AS BIGINT) END)"


def lattice(spark: SparkSession, f: int) -> DataFrame:
    """cell, row, col, sector, rem of every cell. Rows are spread over tasks and unfolded there."""
    rows = spark.range(3 * f + 1).withColumnRenamed("id", "row").withColumn("col", F.explode(F.expr(f"sequence(0L, {width(f)} - 1)")))
    return rows.selectExpr(f"{first(f)} + col AS cell", "row", "col", f"CAST(floor(col / {stride(f)}) AS BIGINT) AS sector", f"col % {stride(f)} AS rem")


def _corners() -> list[tuple[float, float, float]]:
    """Unit vectors of the icosahedron's corners, z-up."""
    turn = [(math.cos(t), math.sin(t)) for t in (math.radians(36 * k) for k in range(10))]
    h, d = 1 / math.sqrt(5), 2 / math.sqrt(5)  # height and radius of the rings
    return [(0.0, 0.0, 1.0), *((d * x, d * y, h) for x, y in turn[0::2]), *((d * x, d * y, -h) for x, y in turn[1::2]), (0.0, 0.0, -1.0)]


def _touching() -> list[list[int]]:
    """The five corners next to each corner."""
    c = _corners()
    dot = lambda i, j: sum(x * y for x, y in zip(c[i], c[j], strict=True))
    return [sorted((j for j in range(12) if j != i), key=lambda j: -round(dot(i, j), 9))[:5] for i in range(12)]


def placed(spark: SparkSession, f: int) -> DataFrame:
    """cell, row, col and `on`: an array of the corners that have weights, with their weights, by corner.

    A row below the pole runs from edge to edge of the faces around it. One between the rings starts each of its five stretches at the edge from an
    upper corner down to the lower one behind it, crosses the face that hangs between two upper corners, and then the one that stands on two lower ones."""
    up, up2, low, low2 = "1 + sector", "1 + (sector + 1) % 5", "6 + sector", "6 + (sector + 1) % 5"
    arr = lambda *pairs: "array(" + ", ".join(f"named_struct('corner', CAST({c} AS INT), 'weight', CAST({w} AS INT))" for c, w in pairs) + ")"
    north = arr(("0", f"{f} - row"), (up, "row - rem"), (up2, "rem"))
    hanging = arr((up, f"{2 * f} - row - rem"), (up2, "rem"), (low, f"row - {f}"))
    standing = arr((up2, f"{2 * f} - row"), (low, f"{f} - rem"), (low2, f"row + rem - {2 * f}"))
    south = arr(("11", f"row - {2 * f}"), (low, f"{3 * f} - row - rem"), (low2, "rem"))
    on = f"CASE WHEN row <= {f} THEN {north} WHEN row <= {2 * f} AND row + rem <= {2 * f} THEN {hanging} WHEN row <= {2 * f} THEN {standing} ELSE {south} END"
    g = lattice(spark, f).selectExpr("cell", "row", "col", "sector % 5 AS sector", "rem", "sector AS sector_", f"{on} AS w")
    return g.select("cell", "row", "col", F.col("sector_").alias("sector"), "rem", F.array_sort(F.filter("w", lambda x: x["weight"] > 0)).alias("on"))


def cells(spark: SparkSession, f: int) -> DataFrame:
    """lattice() with the unit centre x, y, z (z-up) and lon, lat in degrees of the y-up frame, and whether it is a pentagon."""
    share = lambda x: x["weight"] / float(f)
    joint = F.when(F.size("on") == 3, WARP_BETA * share(F.get("on", F.lit(0))) * share(F.get("on", F.lit(1))) * share(F.get("on", F.lit(2)))).otherwise(0.0)
    warp = lambda x: share(x) + WARP_ALPHA * share(x) * (1 - share(x)) * (0.5 - share(x)) + F.col("joint")
    at = _corners()
    axis = lambda i: F.aggregate("on", F.lit(0.0), lambda s, x: s + warp(x) * F.get(F.array(*(F.lit(c[i]) for c in at)), x["corner"]))
    g = placed(spark, f).withColumn("joint", joint).select("cell", "row", "col", "sector", "rem", (F.size("on") == 1).alias("pentagon"), *(axis(i).alias(n) for i, n in enumerate("xyz")))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    g = g.withColumn("len", length).select("cell", "row", "col", "sector", "rem", *((F.col(n) / F.col("len")).alias(n) for n in "xyz"), "pentagon")
    return g.select("cell", "row", "col", "sector", "rem", "x", "y", "z", F.degrees(F.atan2("z", "x")).alias("lon"), F.degrees(F.asin("y")).alias("lat"), "pentagon")


def _key(on: Column) -> Column:
    """What `on` holds as one comparable array of longs."""
    return F.transform(on, lambda x: F.shiftleft(x["corner"].cast("long"), 32) + x["weight"])


def adjacency(spark: SparkSession, f: int) -> DataFrame:
    """src, slot, dst: the five or six neighbours of each cell, clockwise as seen from outside, from the next one of its row on (at a pole, from
    the first one of the next row).

    One weight goes from a corner that has some to another one that shares a face with all that have some. Two joins by what cells hold and by id."""
    near = F.array(*(F.array(*map(F.lit, n)) for n in _touching()))
    p = placed(spark, f)
    held = F.transform("on", lambda x: x["corner"])
    beside = F.aggregate(held, F.sequence(F.lit(0), F.lit(11)), lambda s, c: F.array_intersect(s, F.concat(F.get(near, c), F.array(c))))
    moves = p.select("cell", "row", "col", "on", F.explode("on").alias("from"), beside.alias("ends")).select("*", F.explode("ends").alias("to")).where("to != from.corner")
    lower = F.transform("on", lambda x: F.struct(x["corner"].alias("corner"), (x["weight"] - (x["corner"] == F.col("from.corner")).cast("int") + (x["corner"] == F.col("to")).cast("int")).alias("weight")))
    fresh = F.when(F.array_contains(F.transform("on", lambda x: x["corner"]), F.col("to")), lower).otherwise(F.concat(lower, F.array(F.struct(F.col("to").alias("corner"), F.lit(1).alias("weight")))))
    moved = moves.select(F.col("cell").alias("src"), "row", "col", _key(F.array_sort(F.filter(fresh, lambda x: x["weight"] > 0))).alias("key"))
    c = cells(spark, f).select("cell", "x", "y", "z")
    there = p.select(_key(F.col("on")).alias("key"), F.col("cell").alias("dst"), F.col("row").alias("row2"), F.col("col").alias("col2"))
    both = moved.join(there, "key").join(c.toDF("src", "x", "y", "z"), "src").join(c.toDF("dst", "a", "b", "c"), "dst")
    # Angles in the tangent plane: east is (-y, x, 0), and at the poles (0, 1, 0).
    pole = F.col("row").isin(0, 3 * f)
    east = (F.when(pole, 0.0).otherwise(-F.col("y")), F.when(pole, 1.0).otherwise(F.col("x")))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    e = F.col("a") * east[0] + F.col("b") * east[1]
    n = (F.col("a") * -z * east[1] + F.col("b") * z * east[0] + F.col("c") * (x * east[1] - y * east[0]))
    next_ = F.when(pole, F.col("col2") == 0).otherwise((F.col("row2") == F.col("row")) & (F.col("col2") == (F.col("col") + 1) % F.expr(width(f))))
    turned = both.select("src", "dst", F.atan2(n, e).alias("angle"), next_.alias("next"))
    start = F.max(F.when(F.col("next"), F.col("angle")))
    ring = turned.groupBy("src").agg(start.alias("start"), F.collect_list(F.struct("angle", "dst")).alias("r"))
    order = F.array_sort(F.transform("r", lambda v: F.struct(F.pmod(F.col("start") - v["angle"] + 1e-9, F.lit(2 * math.pi)).alias("turn"), v["dst"].alias("dst"))))
    return ring.select("src", F.posexplode(F.transform(order, lambda v: v["dst"])).alias("slot", "dst"))


def areas(spark: SparkSession, f: int) -> DataFrame:
    """cell, area_sr: a third of the spherical triangles that the cell spans with its neighbours; they sum to 4 pi."""
    c, nb = cells(spark, f).select("cell", "x", "y", "z"), adjacency(spark, f)
    at = nb.join(c.withColumnsRenamed({"cell": "dst", "x": "nx", "y": "ny", "z": "nz"}), "dst")
    ring = at.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("slot", "nx", "ny", "nz"))).alias("ring")).withColumnRenamed("src", "cell").join(c, "cell")
    fan = ring.selectExpr("cell", "x", "y", "z", "posexplode(ring) AS (k, p)", "ring").selectExpr("cell", "x", "y", "z", "p", "ring[(k + 1) % size(ring)] AS q")
    det = "x * (p.ny * q.nz - p.nz * q.ny) + y * (p.nz * q.nx - p.nx * q.nz) + z * (p.nx * q.ny - p.ny * q.nx)"
    den = "1 + x * p.nx + y * p.ny + z * p.nz + p.nx * q.nx + p.ny * q.ny + p.nz * q.nz + q.nx * x + q.ny * y + q.nz * z"
    return fan.groupBy("cell").agg((F.sum(F.expr(f"2 * atan2(abs({det}), {den})")) / 3).alias("area_sr"))


def edges_km(spark: SparkSession, f: int, chord: bool = True) -> DataFrame:
    """src, dst, km: length of each directed edge, as a chord (query layer) or along the great circle (kernels)."""
    c = cells(spark, f).select("cell", "x", "y", "z")
    a, b = c.toDF("src", "ax", "ay", "az"), c.toDF("dst", "bx", "by", "bz")
    both = adjacency(spark, f).join(a, "src").join(b, "dst")
    length = "sqrt(power(ax - bx, 2) + power(ay - by, 2) + power(az - bz, 2))"
    return both.selectExpr("src", "slot", "dst", f"{RADIUS_KM} * {length if chord else f'2 * asin(least(1, {length} / 2))'} AS km")


def pixels(spark: SparkSession, w: int, h: int, radius_m: float = 6371000.0) -> DataFrame:
    """idx, y, x, lat, lon of pixel centres of an equirectangular raster, and each pixel's area_m2."""
    lat = f"90 - (y + 0.5) * 180.0 / {h}"
    band = f"(sin(radians(90 - y * 180.0 / {h})) - sin(radians(90 - (y + 1) * 180.0 / {h})))"
    return spark.range(w * h).selectExpr("id AS idx", f"CAST(floor(id / {w}) AS BIGINT) AS y", f"id % {w} AS x").selectExpr(
        "idx", "y", "x", f"CAST({lat} AS DOUBLE) AS lat", f"CAST((x + 0.5) * 360.0 / {w} - 180 AS DOUBLE) AS lon", f"{radius_m} * {radius_m} * 2 * pi() / {w} * {band} AS area_m2"
    )


def fibonacci_sphere(spark: SparkSession, n: int) -> DataFrame:
    """id, x, y, z of n nearly evenly spread directions."""
    golden = math.pi * (3 - math.sqrt(5))
    return spark.range(n).selectExpr("id", f"1 - 2 * (id + 0.5D) / {n} AS y", f"{golden!r}D * id AS phi").selectExpr("id", "cos(phi) * sqrt(1 - y * y) AS x", "y", "sin(phi) * sqrt(1 - y * y) AS z")
