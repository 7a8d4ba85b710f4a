"""Rivers: channels, chains from their heads, tributaries, meanders and beds; seas, lakes and outlets.

cells (cell, z, accum, ocean) and receivers (node, receiver, as of graph.receivers()) are tables. Chains are found by following receivers to
the next cell that belongs to a river already: each cell of a chain takes its river from the head that reaches it first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import cut, drop
from . import graph


def channel(accum: Column, ocean: Column, threshold: float) -> Column:
    return (accum > threshold) & ~ocean


def outlets(nodes: DataFrame, sea: float = 0.0, share: float = 0.005) -> DataFrame:
    """nodes (node, z) -> node: those not above the sea; if there are none, the lowest of them, a share (one at least, ties to the smaller node)."""
    low = nodes.where(F.col("z") <= sea).select("node")
    if low.limit(1).count():
        return low
    most = max(1, int(nodes.count() * share))
    return nodes.orderBy("z", "node").limit(most).select("node")


def river_mask(cells: DataFrame, outlet: DataFrame, threshold: float) -> DataFrame:
    """cells (node, accum), outlet (node) -> node, river."""
    out = outlet.select("node", F.lit(True).alias("out"))
    return cells.join(out, "node", "left").select("node", ((F.col("accum") >= threshold) & F.col("out").isNull()).alias("river"))


def seas_and_lakes(nodes: DataFrame, edges: DataFrame, sea: float = 0.0) -> DataFrame:
    """nodes (node, z), edges (src, dst) -> node, ocean, lake: the ocean is the largest connected part not above the sea, on a tie the one with
    the lower deepest point; the other parts are lakes."""
    low = nodes.where(F.col("z") <= sea)
    inside = edges.join(low.select(F.col("node").alias("src")), "src", "left_semi").join(low.select(F.col("node").alias("dst")), "dst", "left_semi")
    part = cut(graph.components(low, inside), "parts")
    biggest = component_pick(part.join(low, "node")).select(F.col("component").alias("ocean_"))
    named = part.crossJoin(F.broadcast(biggest)).select("node", (F.col("component") == F.col("ocean_")).alias("o"))
    return nodes.select("node").join(named, "node", "left").select("node", F.coalesce("o", F.lit(False)).alias("ocean"), (F.col("o").isNotNull() & ~F.col("o")).alias("lake"))


def component_pick(parts: DataFrame) -> DataFrame:
    """parts (component, z) -> component of the most rows, on a tie the one with the lower least z, then the smaller one."""
    by = parts.groupBy("component").agg(F.count("*").alias("n"), F.min("z").alias("low"))
    return by.orderBy(F.desc("n"), "low", "component").limit(1).select("component", "n", "low")


def component_area(parts: DataFrame, least: float = 0.02) -> DataFrame:
    """parts (component, area) -> component, area, large: whether it has that share of all."""
    by = parts.groupBy("component").agg(F.sum("area").alias("area"))
    return by.crossJoin(F.broadcast(parts.agg(F.sum("area").alias("all")))).select("component", "area", (F.col("area") >= least * F.col("all")).alias("large"))


def heads(cells: DataFrame, receivers: DataFrame, threshold: float) -> DataFrame:
    """node: channel cells whose greatest channel cell above drains less than half as much."""
    c = cells.where(channel(F.col("accum"), F.col("ocean"), threshold)).select("node", "accum")
    above = c.join(receivers, "node").groupBy(F.col("receiver").alias("node")).agg(F.max("accum").alias("up"))
    return c.join(above, "node", "left").where(F.coalesce("up", F.lit(0.0)) < F.col("accum") * 0.5).select("node")


def chains(cells: DataFrame, receivers: DataFrame, threshold: float, shortest: int = 5) -> DataFrame:
    """cells (node, z, accum, ocean), receivers -> river (its rank by discharge, from 0), ord, node: from each head down to the sea or
    to a cell that a river of an earlier head holds (that cell included).

    Cells go to the smallest head above them: labels move down by doubled pointers, the smaller one winning. Rivers of fewer cells, and those
    that end in little more than the threshold, don't count."""
    starts = heads(cells, receivers, threshold)
    down = receivers.where("receiver IS NOT NULL").select("node", "receiver")
    sea = cells.where("ocean").select("node")
    step = down.join(sea, "node", "left_anti")
    # The smallest head that comes to a cell, and how far away it is.
    reach = cut(graph.spread(step.select(F.col("node").alias("src"), F.col("receiver").alias("dst"), F.lit(0).cast("long").alias("w")), starts.select(F.lit(0).alias("layer"), "node", F.lit(0).alias("cost"), F.col("node").alias("tag")), carry=True).select("node", F.col("tag").alias("head")), "reach")
    # A river's cells are those whose smallest head is its own, in a run from it; the one after them ends it.
    own = reach.join(step, "node", "left").withColumnRenamed("receiver", "next")
    last = own.join(reach.select(F.col("node").alias("next"), F.col("head").alias("next_head")), "next", "left")
    ends = last.where("next IS NOT NULL AND (next_head IS NULL OR next_head != head)").select(F.col("next").alias("node"), "head")
    depth = graph.roots(own.select("node", F.expr("CASE WHEN next IS NULL THEN NULL ELSE next END").alias("parent")).join(reach, "node").join(reach.select(F.col("node").alias("parent"), F.col("head").alias("h2")), "parent", "left").select("node", F.when(F.col("h2") == F.col("head"), F.col("parent")).alias("parent"))).select("node", "depth")
    inside = reach.join(depth, "node").select("head", F.col("node"), F.col("depth").alias("back"))
    rows = inside.unionByName(ends.select("head", "node", F.lit(-1).cast("int").alias("back")))
    rows = cut(rows.join(starts.select(F.col("node").alias("head")), "head", "left_semi"), "chains")
    drop(reach)
    tail = rows.join(cells.select("node", "accum"), "node").groupBy("head").agg(F.count("*").alias("n"), F.min_by("accum", "back").alias("discharge"))
    ok = tail.where((F.col("n") >= shortest) & (F.col("discharge") > 1.5 * threshold))
    from .ranking import ranked

    order = ranked(ok, "discharge", "head").select("head", F.col("rank").alias("river"))
    w = Window.partitionBy("head").orderBy(F.desc("back"))
    return rows.join(order, "head").select("river", (F.row_number().over(w) - 1).alias("ord"), "node")


def river_table(chain: DataFrame, cells: DataFrame) -> DataFrame:
    """chains() with each cell's accum, z and the width of the channel there, in m."""
    return chain.join(cells.select("node", "z", "accum", "ocean"), "node").withColumn("width_m", geo.river_width_m(F.col("accum")))


def tributaries(cells: DataFrame, receivers: DataFrame, threshold: float, steps: int = 200, most: int | None = 400) -> DataFrame:
    """cells (node, accum, ocean), receivers -> start, cells, discharge: ways of cells that drain more than an eighth of the threshold, but are no
    channel, along the receivers to a channel (three cells at least, both ends counted; no more than `steps` on the way); the first `most` by what they drain.

    The greatest start has its way first, ties to the smaller node, and another one that meets a way found before is none. So of all starts that come to a
    channel through the same last cell only the greatest has a way: last cells are found by doubled pointers, and one grouping picks the starts.
    A greatest start whose way is too short or too long still leaves none to the others."""
    c = cells.select("node", "accum", "ocean", channel(F.col("accum"), F.col("ocean"), threshold).alias("channel"))
    ends = c.select(F.col("node").alias("receiver"), F.col("ocean").alias("to_sea"), F.col("channel").alias("to_channel"))
    down = cut(c.where("NOT channel AND NOT ocean").join(receivers, "node", "left").join(ends, "receiver", "left").select("node", "accum", "receiver", "to_sea", "to_channel"), "down")
    last = graph.roots(down.select("node", F.when(~F.col("to_sea") & ~F.col("to_channel"), F.col("receiver")).alias("parent")))
    minor = down.where((F.col("accum") > threshold / 8) & (F.col("accum") <= threshold)).select("node", "accum")
    hit = last.join(minor, "node").join(down.where("to_channel").select(F.col("node").alias("root")), "root", "left_semi")
    best = hit.groupBy("root").agg(F.max(F.struct("accum", -F.col("node"), "depth")).alias("b"))
    out = best.select((-F.col("b.col2")).alias("start"), (F.col("b.depth") + 2).alias("cells"), F.col("b.accum").alias("discharge")).where((F.col("cells") >= 3) & (F.col("cells") <= steps + 1))
    return out if most is None else out.orderBy(F.desc("discharge"), "start").limit(most)


def beds(path: DataFrame, key: str, order: str, z: str, depth: Column) -> DataFrame:
    """path with `bed`: the lowest of z less depth up to each vertex, so that the bed never rises."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return path.withColumn("bed", F.min(F.col(z) - depth).over(w))


def burn_depth(mean_width: Column) -> Column:
    return F.least(F.lit(40.0), F.greatest(F.lit(2.0), 2.0 + 0.06 * mean_width))


def burn(pixels: DataFrame, path: DataFrame) -> DataFrame:
    """pixels (y, x, v), path (river, ord, y, x, width_m) -> pixels carved down to the rivers' beds."""
    depth = burn_depth(F.avg("width_m").over(Window.partitionBy("river")))
    at = path.withColumn("depth", depth).join(pixels, ["y", "x"])
    low = beds(at, "river", "ord", "v", F.col("depth")).groupBy("y", "x").agg(F.min("bed").alias("bed"))
    return pixels.join(low, ["y", "x"], "left").select("y", "x", F.least("v", F.coalesce("bed", "v")).alias("v"))


def arc_length(path: DataFrame, key: str, order: str) -> DataFrame:
    """path (x, y, z on the unit sphere) with `along`: the chords up to each vertex, in km."""
    w = Window.partitionBy(key).orderBy(order)
    step = sum(F.pow(F.col(c) - F.lag(c).over(w), F.lit(2)) for c in "xyz")
    return path.withColumn("__s", F.coalesce(F.sqrt(step), F.lit(0.0))).withColumn("along", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)) * geo.RADIUS_KM).drop("__s")


def meander(path: DataFrame, spacing_km: float, seed: int = 0, target_km: float | None = None) -> DataFrame:
    """path (river, ord, x, y, z, width_m) -> river, ord, x, y, z: each stretch cut into parts of about target_km and moved aside by three sines of
    the way along, whose length follows the width; ends stay. The phases come from a hash of seed, river and octave."""
    target = target_km or max(1.0, spacing_km / 4)
    w = Window.partitionBy("river").orderBy("ord")
    nxt = {f"{c}2": F.lead(c).over(w) for c in ("x", "y", "z", "width_m")}
    a = arc_length(path, "river", "ord").withColumns(nxt)
    # The whole length is known of the stretches; a window over their parts would sort them once more.
    a = a.withColumn("total", F.max("along").over(Window.partitionBy("river")))
    km = geo.RADIUS_KM * F.sqrt(sum(F.pow(F.col(f"{c}2") - F.col(c), F.lit(2)) for c in "xyz"))
    parts = F.greatest(F.lit(1), F.ceil(km / target)).cast("int")
    cut_ = a.withColumn("km", km).withColumn("k", F.when(F.col("x2").isNull(), 1).otherwise(parts)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    t = F.col("j") / F.col("k")
    mix = lambda c: F.when(F.col("x2").isNull(), F.col(c)).otherwise(F.col(c) * (1 - t) + F.col(f"{c}2") * t)
    p = cut_.select("river", "ord", "j", "total", *(mix(c).alias(c) for c in ("x", "y", "z", "width_m")), (F.col("along") + F.coalesce(F.col("km"), F.lit(0.0)) * t).alias("along"))
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    p = p.withColumn("n", n).select("river", "ord", "j", "total", *((F.col(c) / F.col("n")).alias(c) for c in "xyz"), "width_m", "along")
    v = Window.partitionBy("river").orderBy("ord", "j")
    push = F.lit(0.0)
    for octave in range(3):
        lam = F.least(F.lit(2.0 * spacing_km), F.greatest(F.lit(2.0), 11.0 * F.col("width_m") / 1000)) / (octave + 1)
        phase = F.pmod(F.xxhash64(F.lit(seed), F.col("river").cast("long"), F.lit(octave)), F.lit(1 << 53)) / float(1 << 53) * 2 * math.pi
        push = push + 0.12 * lam * F.sin(2 * math.pi * F.col("along") / lam + phase)
    taper = F.least(F.lit(1.0), F.least(F.col("along"), F.col("total") - F.col("along")) / (0.1 * F.col("total") + 1e-9))
    q = p.select("river", "ord", "j", "x", "y", "z", (push * F.pow(F.sin(taper * math.pi / 2), F.lit(2))).alias("push"))
    q = q.withColumns({**{f"b{c}": F.lag(c).over(v) for c in "xyz"}, **{f"f{c}": F.lead(c).over(v) for c in "xyz"}})
    d = {c: F.col(f"f{c}") - F.col(f"b{c}") for c in "xyz"}
    side = {"x": F.col("y") * d["z"] - F.col("z") * d["y"], "y": F.col("z") * d["x"] - F.col("x") * d["z"], "z": F.col("x") * d["y"] - F.col("y") * d["x"]}
    size = F.greatest(F.lit(1e-12), F.sqrt(sum(s * s for s in side.values())))
    inner = F.col("bx").isNotNull() & F.col("fx").isNotNull()
    moved = q.select("river", "ord", "j", *(F.when(inner, F.col(c) + side[c] / size * F.col("push") / geo.RADIUS_KM).otherwise(F.col(c)).alias(c) for c in "xyz"))
    m = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return moved.select("river", (F.row_number().over(v) - 1).alias("ord"), *((F.col(c) / m).alias(c) for c in "xyz"))


#: Steps (down, right) of the eight directions, counter-clockwise from east.
STEPS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))


def beyond(y: Column, x: Column, down: int, right: int, w: int, h: int) -> tuple[Column, Column]:
    """The pixel one step away: longitudes wrap, and beyond a pole the way goes on across it, half way round in the row next to the pole's."""
    row = y + down
    over = (row < 0) | (row >= h)
    return F.when(row < 0, 1).when(row >= h, h - 2).otherwise(row), F.pmod(x + right + F.when(over, w // 2).otherwise(0), F.lit(w))


def _around(at: DataFrame, w: int, h: int, over_poles: bool) -> DataFrame:
    """pixels (y, x, z) with z0 to z7 of the eight around each: each pixel is sent to those that have it beside them, and one grouping collects them."""
    sent = [F.struct(F.col("y"), F.col("x"), F.lit(-1).alias("k"))]
    for k, (down, right) in enumerate(STEPS):
        sent.append(F.struct((F.col("y") - down).alias("y"), F.pmod(F.col("x") - right, F.lit(w)).alias("x"), F.lit(k).alias("k")))
        if over_poles and down:
            near, pole = (1, 0) if down < 0 else (h - 2, h - 1)
            back = F.pmod(F.col("x") - right - w // 2, F.lit(w))
            sent.append(F.when(F.col("y") == near, F.struct(F.lit(pole).cast("long").alias("y"), back.alias("x"), F.lit(k).alias("k"))))
    rows = at.select("z", F.explode(F.array(*sent)).alias("t")).where("t IS NOT NULL AND t.y BETWEEN 0 AND " + str(h - 1))
    pick = lambda k: F.max(F.when(F.col("t.k") == k, F.col("z")))
    return rows.groupBy("t.y", "t.x").agg(F.max(F.col("t.k") == -1).alias("there"), pick(-1).alias("z"), *(pick(k).alias(f"z{k}") for k in range(8))).where("there").drop("there")


def downhill_two(pixels: DataFrame, w: int, h: int, dx: Column, dy: float, over_poles: bool = False) -> DataFrame:
    """pixels (y, x, z), widths dx (a Column of y) and dy of a pixel in m -> y, x, angle, and a0, w0, a1, w1: the two directions (multiples of
    45 degrees counter-clockwise from east) that the steepest of eight triangular facets lies between, with shares; null where none falls.

    Each facet has a cardinal and a diagonal neighbour; its slope is the gradient over the two, held within its two edges. Longitudes wrap; rows end at the poles, or go on across them."""
    around = _around(pixels.select(F.col("y").cast("long"), F.col("x").cast("long"), "z"), w, h, over_poles)
    facets = []
    for k in range(8):
        # The facet between direction k and k + 1: the cardinal one of them is even.
        near, far, along = (k, k + 1, 1) if k % 2 == 0 else (k + 1, k, -1)
        start = (near if along > 0 or near % 8 else 8) * math.pi / 4
        ends = [F.coalesce(F.col(f"z{i % 8}"), F.col("z")).cast("double") for i in (near, far)]
        facets.append(F.struct(*(c.alias(n) for c, n in zip(ends, ("z1", "z2"), strict=True)), F.lit(near % 4 == 0).alias("level"), F.lit(-k).alias("first"), F.lit(start).alias("start"), F.lit(along).alias("along")))
    each = around.select("y", "x", "z", dx.alias("__dx"), F.explode(F.array(*facets)).alias("f")).select("y", "x", "z", "f.*", F.when(F.col("f.level"), F.col("__dx")).otherwise(dy).alias("d1"), F.when(F.col("f.level"), F.lit(dy)).otherwise(F.col("__dx")).alias("d2"))
    each = each.withColumns({"s1": (F.col("z") - F.col("z1")) / F.col("d1"), "s2": (F.col("z1") - F.col("z2")) / F.col("d2"), "widest": F.atan2("d2", "d1")}).withColumn("r", F.atan2("s2", "s1"))
    slope = F.when(F.col("r") < 0, F.col("s1")).when(F.col("r") > F.col("widest"), (F.col("z") - F.col("z2")) / F.sqrt(F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2"))).otherwise(F.sqrt(F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")))
    angle = F.pmod(F.col("start") + F.col("along") * F.least(F.col("widest"), F.greatest(F.lit(0.0), F.col("r"))), F.lit(2 * math.pi))
    each = each.select("y", "x", slope.alias("slope"), "first", angle.alias("angle"))
    best = each.groupBy("y", "x").agg(F.max(F.when(F.col("slope") > 0, F.struct("slope", "first", "angle"))).alias("b")).select("y", "x", F.col("b.angle").alias("angle"))
    k = F.when(F.col("angle").isNotNull(), F.least(F.lit(7), F.floor(F.col("angle") / (math.pi / 4))))
    t = F.col("angle") / (math.pi / 4) - k
    return best.select("y", "x", "angle", k.cast("int").alias("a0"), (1 - t).alias("w0"), ((k + 1) % 8).cast("int").alias("a1"), t.alias("w1"))


def raster_edges(w: int, h: int, pixels: DataFrame) -> DataFrame:
    """pixels (y, x) -> src, dst: the four beside each, in both directions, numbered y * w + x; across the poles too."""
    ways = [F.struct(*(c.cast("long").alias(n) for c, n in zip(beyond(F.col("y"), F.col("x"), *STEPS[k], w, h), "ab", strict=True))) for k in (0, 2, 4, 6)]
    one = pixels.select((F.col("y") * w + F.col("x")).cast("long").alias("src"), F.explode(F.array(*ways)).alias("t")).select("src", (F.col("t.a") * w + F.col("t.b")).alias("dst"))
    return one.union(one.select("dst", "src")).where("src != dst").distinct()


def shares_by_angle(two: DataFrame, w: int, h: int) -> DataFrame:
    """downhill_two() -> src, dst, share: the two pixels that the angle lies between; a share below 0.0001 goes to the other one."""
    part = lambda a, s: F.struct(F.col(a).alias("a"), F.when(F.col(s) > 1 - 1e-4, 1.0).when(F.col(s) < 1e-4, 0.0).otherwise(F.col(s)).alias("share"))
    each = two.where("angle IS NOT NULL").select("y", "x", F.explode(F.array(part("a0", "w0"), part("a1", "w1"))).alias("p")).where("p.share > 0")
    to_y, to_x = F.lit(None).cast("long"), F.lit(None).cast("long")
    for k, step in enumerate(STEPS):
        a, b = beyond(F.col("y"), F.col("x"), *step, w, h)
        to_y, to_x = F.when(F.col("p.a") == k, a).otherwise(to_y), F.when(F.col("p.a") == k, b).otherwise(to_x)
    return each.select((F.col("y") * w + F.col("x")).cast("long").alias("src"), (to_y * w + to_x).cast("long").alias("dst"), F.col("p.share").alias("share"))


def pixel_area(y: Column, w: int, h: int) -> Column:
    """m2 of a pixel of row y."""
    lat = lambda r: F.radians(90 - r * 180 / h)
    return (geo.RADIUS_KM * 1000) ** 2 * (2 * math.pi / w) * (F.sin(lat(y)) - F.sin(lat(y + 1)))


def drainage(pixels: DataFrame, w: int, h: int, dx: Column, dy: float, outlet: DataFrame, block: int = 0) -> DataFrame:
    """pixels (y, x, z), outlet (node = y * w + x) -> node, fill, total: the area in m2 that drains to a pixel, itself included, when
    hollows are filled and each pixel shares what it has between the two that its angle of steepest descent lies between.

    Level pixels drain along the flood's way out. Where pixels aren't square an angle may point at one that is not lower: its share counts there and
    goes no further. Outlets keep what they have. Pixels without z take no part. Blocks are squares of `block` pixels."""
    there = cut(pixels.where("z IS NOT NULL").select(F.col("y").cast("long"), F.col("x").cast("long"), (F.col("y") * w + F.col("x")).cast("long").alias("node"), "z"), "pixels")
    near = raster_edges(w, h, there)
    near = near.join(there.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    near = cut(near.join(there.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"), "near")
    block = graph.tiles(w, block)
    fill = cut(graph.flood(there, near, outlet, block), "fill")
    drop(near)
    level = fill.select("node", F.floor(F.col("node") / w).alias("y"), F.pmod("node", F.lit(w)).alias("x"), F.col("fill").alias("z"))
    dry = outlet.select(F.col("node").cast("long").alias("src")).distinct()
    two = cut(shares_by_angle(downhill_two(level, w, h, dx, dy, True), w, h).join(dry, "src", "left_anti"), "shares")
    named = two.join(fill.select(F.col("node").alias("src"), F.col("fill").alias("a")), "src").join(fill.select(F.col("node").alias("dst"), F.col("fill").alias("b")), "dst")
    over = fill.join(two.select(F.col("src").alias("node")), "node", "left_anti").where("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("share"))
    flows = named.where("b < a").select("src", "dst", "share").unionByName(over.join(dry, "src", "left_anti"))
    total = graph.accumulate_shared(level.select("node", pixel_area(F.col("y"), w, h).alias("area")), flows, "area", block)
    late = named.where("b >= a").join(total.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("total") * F.col("share")).alias("late"))
    return fill.select("node", "fill").join(total, "node").join(late, "node", "left").select("node", "fill", (F.col("total") + F.coalesce("late", F.lit(0.0))).alias("total"))
