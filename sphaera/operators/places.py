"""Questions about places: what is nearest, where a route leads, what is there, and what can be seen from it.

A world is a table of cells (cell, centre x, y, z, height, ocean, biome, road, river, and names of what holds the cell) and its adjacency
(src, dst). Points are rows with a key and a unit vector px, py, pz. Nearness is found in cubes of space, by equi-joins; the cubes are
doubled for those points that have found too little, so a point meets a bounded number of cells wherever it is. Where targets are many, side_for()
makes the first cubes so small that a point meets a few dozen of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import cut
from . import graph
from .exports import thinned
from .fields import nearest_cell

#: Names of the biomes, by id.
BIOME_NAMES = ("ocean", "ice sheet", "tundra", "boreal forest", "temperate forest", "grassland", "tropical rainforest", "savanna", "desert", "alpine heights", "wetland")
#: Fixed values of notes on a route: a stretch is told from so many cells on, a pass from so many metres on, and so many notes at most.
STRETCH, PASS_M, NOTES = 3, 2200.0, 12


def _cube(x: str, y: str, z: str, side: float, shift: bool) -> list[Column]:
    d = lambda n: F.col(f"__d.{n}") if shift else F.lit(0)
    return [(F.floor(F.col(c) / side).cast("int") + d(n)).alias(f"__{n}") for c, n in ((x, "i"), (y, "j"), (z, "k"))]


def nearness(chord2: str) -> Column:
    """A distance to compare by: grids are symmetric, and what differs by rounding alone is a tie."""
    return F.round(F.col(chord2), 9)


def side_for(targets: DataFrame, k: int = 1) -> float:
    """A side to start nearest() with: about eight times k targets are within it, were they spread evenly."""
    return min(2.2, (32 * k / max(1, targets.count())) ** 0.5)


def within(points: DataFrame, key: str, targets: DataFrame, side: float, many: bool = False) -> DataFrame:
    """points (key, px, py, pz), targets (id, x, y, z) -> key, id, chord2: all pairs not more than `side` apart, by an equi-join of cubes.

    Of the two sides the shorter is copied to the cubes around: that of the points, or of the targets where the points are `many`. Spark takes copied
    targets for as small as they were before, and would gather all of them on the driver to send them to every task: they are sorted and merged instead."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(c).alias("k")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))).alias("__d")
    copied = lambda df, *c: df.select(*c, *([] if many == (df is points) else [steps]))
    at = copied(points, key, "px", "py", "pz").select(key, "px", "py", "pz", *_cube("px", "py", "pz", side, not many))
    home = copied(targets, "id", "x", "y", "z").select("id", "x", "y", "z", *_cube("x", "y", "z", side, many))
    chord2 = F.pow(F.col("px") - F.col("x"), F.lit(2)) + F.pow(F.col("py") - F.col("y"), F.lit(2)) + F.pow(F.col("pz") - F.col("z"), F.lit(2))
    return at.join(home.hint("merge") if many else home, ["__i", "__j", "__k"]).withColumn("chord2", chord2).where(F.col("chord2") <= side * side).select(key, "id", "chord2")


def nearest(points: DataFrame, key: str, targets: DataFrame, side: float, k: int = 1, many: bool = False) -> DataFrame:
    """points (key, px, py, pz), targets (id, x, y, z) -> key, id, chord2, nth: the k nearest targets of each point, nth from 1, ties to the smaller id.

    A point is done when k targets are within `side`; for the others it is doubled, up to the whole sphere. With `many` points (more than targets) the
    targets are copied instead; a point's pairs are then in one task, and of one nearest target each task keeps one row a point before anything is shuffled."""
    open_, out = points.select(key, "px", "py", "pz"), None
    order = Window.partitionBy(key).orderBy(nearness("chord2"), "id")
    while True:
        met = within(open_, key, targets, side, many)
        if k == 1:
            best = met.groupBy(key).agg(F.min(F.struct(nearness("chord2").alias("near"), "id", "chord2")).alias("b"))
            ranked = cut(best.select(key, "b.id", "b.chord2", F.lit(1).alias("nth")), "near")
        else:
            ranked = cut(met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k), "near")
        last = side >= 2.1
        full = ranked.where(F.col("nth") == k).select(key)
        done = ranked if last or k == 1 else ranked.join(full, key, "left_semi")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        open_ = cut(open_.join(full, key, "left_anti"), "open")
        if not open_.limit(1).count():
            return out
        side = 2.2 if side > 0.7 else 2 * side


def unit(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with px, py, pz of their position in degrees."""
    x, y, z = geo.direction(F.col(lon), F.col(lat))
    return points.withColumns({"px": x, "py": y, "pz": z})


def spacing(f: int) -> float:
    """A chord that neighbouring cells of a grid of frequency f don't exceed."""
    return 1.4 / f if f > 1 else 1.4


def snap(points: DataFrame, key: str, world: DataFrame, f: int, want: str, k: int = 256) -> DataFrame:
    """key, cell: the nearest cell; if it isn't such as wanted (SQL over the world), the nearest of the k nearest that is; if there is none, itself."""
    cells = world.select(F.col("cell").alias("id"), "x", "y", "z")
    first = cut(nearest(points, key, cells, spacing(f)).select(key, F.col("id").alias("cell")), "first")
    fits = world.select(F.col("cell").alias("id"), F.expr(want).alias("fits"))
    at = first.join(world.select("cell", F.expr(want).alias("fits"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")), "cell")
    astray = at.where("NOT fits").select(F.col("cell").alias("__from"), "px", "py", "pz").distinct()
    n = world.count()
    near = nearest(astray, "__from", cells, 4 * spacing(f), min(k, n)).join(fits.where("fits").select("id"), "id")
    moved = near.groupBy("__from").agg(F.min_by("id", F.struct(nearness("chord2"), "id")).alias("to"))
    return first.join(moved, first["cell"] == moved["__from"], "left").select(key, F.coalesce("to", "cell").alias("cell"))


def travel(world: DataFrame, adjacency: DataFrame) -> DataFrame:
    """src, dst, km (chord), and for both ends (a_, b_) z, ocean, biome, road and river: what graph.travel_days() asks for."""
    end = lambda p, to: world.select(F.col("cell").alias(to), *(F.col(c).alias(f"{p}_{n}") for c, n in (("x", "x"), ("y", "y"), ("z", "zz"), ("height", "z"), ("ocean", "ocean"), ("biome", "biome"), ("road", "road"), ("river", "river"))))
    both = adjacency.select("src", "dst").join(end("a", "src"), "src").join(end("b", "dst"), "dst")
    km = geo.RADIUS_KM * F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), F.lit(2)) + F.pow(F.col("a_y") - F.col("b_y"), F.lit(2)) + F.pow(F.col("a_zz") - F.col("b_zz"), F.lit(2)))
    return both.withColumn("km", km).drop("a_x", "a_y", "a_zz", "b_x", "b_y", "b_zz")


def days(edges: DataFrame, mode: str) -> DataFrame:
    """travel() as src, dst, w: days by a mode of travel, where it can pass."""
    return edges.select("src", "dst", F.expr(graph.travel_days(mode)).alias("w")).where("w IS NOT NULL")


def _reached(trips: DataFrame, world: DataFrame, adjacency: DataFrame, f: int, mode: str) -> tuple[DataFrame, DataFrame]:
    """The ends of trips (trip, source, node), and what graph.shortest() makes of their starts."""
    want = "ocean" if mode == "ship" else "NOT ocean"
    ends = trips.select("trip", F.lit(0).alias("end"), "lon", "lat").union(trips.select("trip", F.lit(1), "to_lon", "to_lat"))
    ends = unit(ends).withColumn("key", F.struct("trip", "end"))
    at = cut(snap(ends, "key", world, f, want).select("key.trip", "key.end", "cell"), "ends")
    both = at.where("end = 0").select("trip", F.col("cell").alias("source")).join(at.where("end = 1").select("trip", F.col("cell").alias("node")), "trip")
    return both, graph.shortest(days(travel(world, adjacency), mode), both.select("source", F.col("source").alias("node")).distinct())


def travel_times(trips: DataFrame, world: DataFrame, adjacency: DataFrame, f: int, mode: str = "horse") -> DataFrame:
    """trips (trip, lon, lat, to_lon, to_lat) -> trip, days; null where there is no way."""
    both, reached = _reached(trips, world, adjacency, f, mode)
    return both.join(reached.select("source", "node", "dist"), ["source", "node"], "left").select("trip", F.col("dist").alias("days"))


def routes(trips: DataFrame, world: DataFrame, adjacency: DataFrame, f: int, mode: str = "horse", most: int = 120) -> DataFrame:
    """trips (trip, lon, lat, to_lon, to_lat) -> trip, reachable, days, km, top_m (the highest cell), path (thinned, lon and lat), notes.

    Ends are snapped to cells that the mode can stand on. The paths of trips with one start are found together; a start is a layer of the frontier."""
    both, reached = _reached(trips, world, adjacency, f, mode)
    steps = cut(graph.path(reached, both.select("source", "node").distinct()), "steps")
    back = Window.partitionBy("source", "goal").orderBy(F.desc("back"))
    cells = world.select(F.col("cell").alias("node"), "x", "y", "z", "height", "biome", "river", "polity")
    path = steps.join(cells, "node").withColumns({c: F.lag(n).over(back) for c, n in (("ax", "x"), ("ay", "y"), ("az", "z"), ("was", "polity"), ("before", "biome"))})
    path = path.withColumn("step", F.sqrt(F.pow(F.col("x") - F.col("ax"), F.lit(2)) + F.pow(F.col("y") - F.col("ay"), F.lit(2)) + F.pow(F.col("z") - F.col("az"), F.lit(2))))
    path = cut(path.withColumn("run", F.sum((~F.col("biome").eqNullSafe(F.col("before"))).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0))), "paths")
    totals = path.groupBy("source", "goal").agg((F.coalesce(F.sum("step"), F.lit(0.0)) * geo.RADIUS_KM).alias("km"), F.max("height").alias("top_m"))
    thin = thinned(path.withColumn("pair", F.struct("source", "goal")).withColumn("along", -F.col("back")), "pair", "along", most)
    lon, lat = F.degrees(F.atan2("z", "x")), F.degrees(F.asin("y"))
    drawn = thin.groupBy("source", "goal").agg(F.transform(F.sort_array(F.collect_list(F.struct("along", lon.alias("lon"), lat.alias("lat")))), lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))).alias("path"))
    known = both.join(reached.select("source", "node", "dist"), ["source", "node"], "left").withColumnRenamed("node", "goal")
    out = known.join(totals, ["source", "goal"], "left").join(drawn, ["source", "goal"], "left").join(notes(path, mode), ["source", "goal"], "left")
    return out.select("trip", F.col("dist").isNotNull().alias("reachable"), F.col("dist").alias("days"), "km", "top_m", "path", "notes")


def notes(path: DataFrame, mode: str) -> DataFrame:
    """path (source, goal, back, run, biome, height, river, polity, was) -> source, goal, notes: what a traveller would tell, in order."""
    if mode == "ship":
        return path.groupBy("source", "goal").agg(F.count("*").alias("n")).select("source", "goal", F.array(F.format_string("a sea voyage of %d legs", "n")).alias("notes"))
    name = F.get(F.array(*map(F.lit, BIOME_NAMES)), F.col("biome").cast("int"))
    runs = path.groupBy("source", "goal", "run", "biome").agg(F.count("*").alias("n")).where((F.col("n") >= STRETCH) & (F.col("biome") != 0))
    told = runs.select("source", "goal", F.struct(F.lit(0).alias("part"), F.col("run").cast("long").alias("at"), F.format_string("through %s (%d leagues)", name, F.col("n")).alias("text")).alias("note"))
    all_ = path.groupBy("source", "goal").agg(F.max("height").alias("top"), F.count_if("river").alias("fords"))
    high = all_.where(F.col("top") > PASS_M).select("source", "goal", F.struct(F.lit(1), F.lit(0).cast("long"), F.format_string("crosses a high pass at %d m", F.floor("top"))))
    wet = all_.where("fords > 0").select("source", "goal", F.struct(F.lit(2), F.lit(0).cast("long"), F.format_string("fords or bridges %d river reaches", "fords")))
    first = path.groupBy("source", "goal").agg(F.max("back").alias("first"))
    enters = path.join(first, ["source", "goal"]).where("back < first AND polity IS NOT NULL AND NOT polity <=> was").groupBy("source", "goal", "polity").agg(F.min(-F.col("back")).alias("at")).select("source", "goal", F.struct(F.lit(3), F.col("at").cast("long"), F.concat(F.lit("enters "), F.col("polity"))))
    found = told.union(high).union(wet).union(enters)
    lists = found.groupBy("source", "goal").agg(F.slice(F.transform(F.sort_array(F.collect_list("note")), lambda n: n["text"]), 1, NOTES).alias("notes"))
    return path.select("source", "goal").distinct().join(lists, ["source", "goal"], "left").select("source", "goal", F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))


def news(trips: DataFrame, world: DataFrame, adjacency: DataFrame, f: int) -> DataFrame:
    """trips -> trip, days, by: when news arrives at the earliest, by courier or ship; null if by neither."""
    by = {m: travel_times(trips, world, adjacency, f, m).select("trip", F.col("days").alias(m)) for m in ("horse", "ship")}
    return by["horse"].join(by["ship"], "trip").select("trip", F.expr(graph.news_days()).alias("n")).select("trip", "n.days", "n.by")


def reachable(points: DataFrame, world: DataFrame, adjacency: DataFrame, areas: DataFrame, f: int, limit: float, mode: str = "horse") -> DataFrame:
    """points (place, lon, lat), areas (cell, area_sr) -> place, cells, km2: what can be reached within some days."""
    at = cut(snap(unit(points), "place", world, f, "ocean" if mode == "ship" else "NOT ocean"), "starts")
    near = graph.shortest(days(travel(world, adjacency), mode), at.select(F.col("cell").alias("source"), F.col("cell").alias("node")).distinct(), limit)
    sums = near.join(areas.withColumnRenamed("cell", "node"), "node").groupBy("source").agg(F.count("*").alias("cells"), (F.sum("area_sr") * geo.RADIUS_KM**2).alias("km2"))
    return at.join(sums, at["cell"] == sums["source"]).select("place", "cells", "km2")


def describe(points: DataFrame, world: DataFrame, settlements: DataFrame, f: int) -> DataFrame:
    """points (place, lon, lat), settlements (id, name, rank, x, y, z) -> place, elevation_m, ocean, biome, polity, culture, settlement,
    settlement_rank and settlement_km: what is known of a place. Polities and cultures hold no sea."""
    cells = world.select("cell", "x", "y", "z")
    at = nearest_cell(unit(points), "place", cells, f)
    name = F.get(F.array(*map(F.lit, BIOME_NAMES)), F.col("biome").cast("int"))
    here = world.select("cell", F.round("height", 1).alias("elevation_m"), "ocean", name.alias("biome"), F.when(~F.col("ocean"), F.col("polity")).alias("polity"), F.when(~F.col("ocean"), F.col("culture")).alias("culture"))
    # A settlement is looked for from the cell's centre, once for all places of the cell.
    town = nearest(cells.select("cell", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")), "cell", settlements, side_for(settlements)).select("cell", "id", "chord2")
    km = 2 * geo.RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt("chord2") / 2))
    near = town.join(settlements.select("id", F.col("name").alias("settlement"), F.col("rank").alias("settlement_rank")), "id").select("cell", "settlement", "settlement_rank", F.round(km, 0).alias("settlement_km"))
    return at.join(here.join(near, "cell", "left"), "cell").drop("cell")


def at_pixels(points: DataFrame, layers: DataFrame, w: int, h: int) -> DataFrame:
    """points (place, lon, lat), layers (y, x and a column for each layer) -> place and all layers at the pixel that holds it; longitudes wrap."""
    x = F.pmod(F.floor((F.col("lon") + 180) / 360 * w), F.lit(w)).cast("long")
    y = F.least(F.lit(h - 1), F.greatest(F.lit(0), F.floor((90 - F.col("lat")) / 180 * h))).cast("long")
    return points.select("place", y.alias("y"), x.alias("x")).join(layers, ["y", "x"]).drop("y", "x")


def viewsheds(points: DataFrame, world: DataFrame, f: int, eye: float = 10.0, rays: int = 36, step: float = 8.0, far: float = 320.0) -> DataFrame:
    """points (place, lon, lat) -> place, horizon_km (the median over the rays), peak_m, peak_km, peak_lon, peak_lat: the tallest of the
    heights above 1500 m that stand out along a ray.

    An eye stands at its cell's centre, so each cell with places is looked from once. Samples along rays meet their cells in one join; then running
    maxima per ray."""
    cells = world.select(F.col("cell").alias("id"), "x", "y", "z")
    stands = cut(nearest_cell(unit(points), "place", world.select("cell", "x", "y", "z"), f).withColumnRenamed("cell", "stand"), "stands")
    at = stands.select("stand").distinct().join(world.withColumnRenamed("cell", "stand"), "stand")
    origin = at.select("stand", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), (F.greatest(F.lit(0.0), "height") + eye).alias("eye"))
    n = F.sqrt(F.col("oz") * F.col("oz") + F.col("ox") * F.col("ox")) + 1e-12
    o = origin.withColumns({"ex": F.col("oz") / n, "ez": -F.col("ox") / n}).withColumns({"nx": F.col("oy") * F.col("ez"), "ny": F.col("oz") * F.col("ex") - F.col("ox") * F.col("ez"), "nz": -F.col("oy") * F.col("ex")})
    km = F.explode(F.expr(f"transform(sequence(1, {int((far - 1e-9) // step)}), i -> CAST(i * {step} AS DOUBLE))"))
    s = o.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(rays - 1)))).withColumn("km", km)
    az, ang = 2 * F.pi() * F.col("ray") / rays, F.col("km") / geo.RADIUS_KM
    go = {c: F.cos(az) * e + F.sin(az) * F.col(f"n{c}") for c, e in (("x", F.col("ex")), ("y", F.lit(0.0)), ("z", F.col("ez")))}
    s = s.withColumns({f"p{c}": F.col(f"o{c}") * F.cos(ang) + go[c] * F.sin(ang) for c in "xyz"}).withColumn("key", F.struct("stand", "ray", "km"))
    s = cut(s, "rays")
    found = nearest(s, "key", cells, spacing(f)).select("key", F.col("id").alias("cell"))
    seen = s.select("key", "stand", "ray", "km", "eye").join(found, "key").join(world.select("cell", F.greatest(F.lit(0.0), "height").alias("h"), F.col("x"), F.col("y"), F.col("z")), "cell")
    d = F.col("km") * 1000
    seen = seen.withColumn("angle", (F.col("h") - F.col("eye") - d * d / (2 * geo.RADIUS_KM * 1000)) / d)
    top = F.max("angle").over(Window.partitionBy("stand", "ray").orderBy("km").rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("top", top)
    hid = (F.col("angle") <= F.col("top")) & (F.col("top") > 0.002) & (F.col("angle") < F.col("top") - 0.004)
    out = seen.groupBy("stand", "ray").agg(F.coalesce(F.min(F.when(hid, F.col("km"))), F.lit(far)).alias("km"), F.max(F.when((F.col("top").isNull() | (F.col("angle") > F.col("top"))) & (F.col("h") > 1500), F.struct(F.col("h"), -F.col("ray"), -F.col("km"), "x", "y", "z"))).alias("peak"))
    p = F.col("p")
    seen = out.groupBy("stand").agg(F.median("km").alias("horizon_km"), F.max("peak").alias("p")).select("stand", "horizon_km", F.round(p["h"], 0).alias("peak_m"), (-p["col3"]).alias("peak_km"), F.round(F.degrees(F.atan2(p["z"], p["x"])), 2).alias("peak_lon"), F.round(F.degrees(F.asin(p["y"])), 2).alias("peak_lat"))
    return stands.join(seen, "stand").drop("stand")

