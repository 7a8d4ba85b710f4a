"""Graph operators as iterated joins. Each round is written to the shared folder (tables.cut), so lineage stays short; tables that
later rounds don't read are dropped.

Nodes are longs whose neighbours tend to have near ids, as the cells of a grid have. Frontiers therefore move by blocks of BLOCK ids: in
a round each block that something has reached settles it within itself, in one task of bounded size, and only what crosses
to other blocks is shuffled. The rounds are as many as blocks are crossed, not edges. Only counts come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import cut, drop

#: Ids of a block.
BLOCK = 1 << 14
#: Edges that one task takes at once when it contracts them.
CHUNK = 1 << 18


#: So many ids in a row are a block; or a function of a column of ids gives the block of each.
Blocks = int | Callable[[Column], Column]


def _block(node: str, block: Blocks) -> Column:
    return (block(F.col(node)) if callable(block) else F.floor(F.col(node) / block)).alias("block")


def tiles(w: int, size: int = 0) -> Blocks:
    """Squares of about `size` pixels as the blocks of a raster whose pixels are y * w + x: flows cross the sides of squares less often than those of as
    many pixels in rows, which are the thinner the wider the raster is."""
    side = max(1, math.isqrt(size or BLOCK))
    return lambda node: F.floor(F.floor(node / w) / side) * -(-w // side) + F.floor(F.pmod(node, F.lit(w)) / side)


def _bundled(edges: DataFrame) -> DataFrame:
    """edges (block, src, dst, ...) -> block, edges: a few rows for each block with arrays of its edges, which rounds shuffle instead of the edges."""
    return edges.groupBy("block", F.pmod("src", F.lit(16))).agg(F.collect_list(F.struct(*(c for c in edges.columns if c != "block"))).alias("edges")).select("block", "edges")


def _unbundled(edges: pa.Table) -> Iterator[tuple]:
    for rows in edges.column("edges").chunks:
        yield from zip(*(c.to_pylist() for c in rows.flatten().flatten()), strict=True)


def _settle(limit: float | None, worst: bool, carry: bool):
    """The helper of spread(): what reaches one block of one layer, carried along the block's own edges, least (cost, tag) first."""

    def run(reached: pa.Table, edges: pa.Table) -> pa.Table:
        out: dict[int, list[tuple]] = {}
        for u, v, w in _unbundled(edges):
            out.setdefault(u, []).append((v, w))
        best: dict[int, tuple] = {}
        fresh: dict[int, tuple] = {}
        for node, cost, tag, old in zip(*(reached.column(c).to_pylist() for c in ("node", "cost", "tag", "old")), strict=True):
            to = best if old else fresh
            if node not in to or _before((cost, tag), to[node]):
                to[node] = (cost, tag)
        changed = {n: x for n, x in fresh.items() if n not in best or _before(x, best[n])}
        heap = [(x[0], x[1] if carry else 0, n) for n, x in changed.items() if carry or n not in best or x[0] < best[n][0]]
        heapify(heap)
        best.update(changed)
        while heap:
            cost, tag, u = heappop(heap)
            if cost > best[u][0] or (carry and tag > best[u][1]):
                continue
            for v, w in out.get(u, ()):
                x = (max(cost, w) if worst else cost + w, tag if carry else u)
                if (limit is None or x[0] <= limit) and (v not in best or _before(x, best[v])):
                    if carry or v not in best or x[0] < best[v][0]:
                        heappush(heap, (x[0], x[1] if carry else 0, v))
                    best[v] = changed[v] = x
        layer = reached.column("layer")[0].as_py() if reached.num_rows else 0
        kinds = {n: reached.schema.field(n).type for n in ("layer", "node", "cost", "tag")}
        rows = [(layer, n, *x) for n, x in changed.items()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    return run


def _before(x: tuple, y: tuple) -> bool:
    """Costs first, then tags, of which none is before any."""
    return x[0] < y[0] or (x[0] == y[0] and y[1] is not None and (x[1] is None or x[1] < y[1]))


def spread(edges: DataFrame, seeds: DataFrame, limit: float | None = None, worst: bool = False, carry: bool = False, block: Blocks = 0) -> DataFrame:
    """edges (src, dst, w), seeds (layer, node, cost, tag) -> layer, node, cost, tag: the least cost at which a layer reaches a node.

    Along an edge costs add up, or with `worst` the greatest w counts. The tag is the node before, or with `carry` that of the seed; of equal costs the smaller tag wins. Layers don't meet."""
    block = block or BLOCK
    edges = cut(edges.select("src", "dst", "w", _block("src", block), _block("dst", block).alias("to")), "edges")
    inner, crossing = cut(_bundled(edges.where("block = to").drop("to")), "inner"), cut(edges.where("block != to").select("src", "dst", "w"), "crossing")
    drop(edges)
    kind = edges.schema["w"].dataType
    seeds = seeds.select(F.col("layer").cast("long"), F.col("node").cast("long"), F.col("cost").cast(kind), F.col("tag").cast("long"))
    least = F.min(F.struct("cost", F.coalesce("tag", F.lit(-(1 << 63))).alias("t"), "tag")).alias("x")
    schema = T.StructType([T.StructField("layer", T.LongType()), T.StructField("node", T.LongType()), T.StructField("cost", kind), T.StructField("tag", T.LongType())])
    best, offers = None, cut(seeds.groupBy("layer", "node").agg(least).select("layer", "node", "x.cost", "x.tag"), "offers")
    while True:
        fresh = offers.withColumn("old", F.lit(False))
        places = cut(offers.select("layer", _block("node", block)).distinct(), "places")
        if best is not None:
            fresh = fresh.unionByName(best.withColumn("block", _block("node", block)).join(places, ["layer", "block"], "left_semi").drop("block").withColumn("old", F.lit(True)))
        reached = fresh.withColumn("block", _block("node", block))
        here = inner.join(places, "block").select("layer", "block", "edges")
        moved = cut(reached.groupBy("layer", "block").cogroup(here.groupBy("layer", "block")).applyInArrow(_settle(limit, worst, carry), schema), "moved")
        drop(places)
        drop(offers)
        if best is None:
            best = moved
        elif moved.limit(1).count():
            new = cut(best.join(moved.select("layer", "node"), ["layer", "node"], "left_anti").unionByName(moved), "best")
            drop(best)
            best = new
        step = moved.join(crossing, moved.node == crossing.src)
        cost = F.greatest("cost", "w") if worst else F.col("cost") + F.col("w")
        step = step.select("layer", F.col("dst").alias("node"), cost.cast(kind).alias("cost"), (F.col("tag") if carry else F.col("src").cast("long")).alias("tag"))
        step = step if limit is None else step.where(F.col("cost") <= limit)
        step = step.groupBy("layer", "node").agg(least).select("layer", "node", "x.cost", "x.tag")
        known = best.select("layer", "node", F.col("cost").alias("c"), F.col("tag").alias("g"))
        better = step.join(known, ["layer", "node"], "left").where("c IS NULL OR cost < c OR (cost = c AND g IS NOT NULL AND (tag IS NULL OR tag < g))").drop("c", "g")
        offers = cut(better, "offers")
        if moved is not best:
            drop(moved)
        if not offers.limit(1).count():
            for old in (offers, inner, crossing):
                drop(old)
            return best


def shortest(edges: DataFrame, sources: DataFrame, limit: float | None = None, block: Blocks = 0) -> DataFrame:
    """edges (src, dst, w >= 0), sources (source, node) -> source, node, dist, prev: least costs from each source and the node before.

    With `limit`, costs above it are not followed. Ties in cost go to the smaller previous node."""
    seeds = sources.select(F.col("source").alias("layer"), "node", F.lit(0).alias("cost"), F.lit(None).cast("long").alias("tag"))
    return spread(edges, seeds, limit, block=block).toDF("source", "node", "dist", "prev")


def territories(edges: DataFrame, sources: DataFrame, limit: float | None = None, block: Blocks = 0) -> DataFrame:
    """node, source, dist: the source (with columns source, node and, if there is one, start: the cost that it begins with) that
    reaches a node at the least cost, ties to the smaller source.

    One label and cost is kept for each node, so the work doesn't grow with the number of sources."""
    start = F.col("start") if "start" in sources.columns else F.lit(0)
    seeds = sources.select(F.lit(0).alias("layer"), "node", start.alias("cost"), F.col("source").alias("tag"))
    return spread(edges, seeds, limit, carry=True, block=block).select("node", F.col("cost").alias("dist"), F.col("tag").alias("source"))


def flood(nodes: DataFrame, edges: DataFrame, outlets: DataFrame, block: Blocks = 0) -> DataFrame:
    """nodes (node, z), edges (src, dst), outlets (node) -> node, fill, parent: the level to which water stands before it runs to an
    outlet, and where it goes: to the lowest neighbour (of equal ones the smallest), or over level water towards the nearest way down; null at outlets.

    fill is the least over all paths to an outlet of the greatest z on the way."""
    z, ends = nodes.select("node", "z"), outlets.select("node").distinct()
    at = edges.select("src", "dst").join(z.withColumnRenamed("node", "dst"), "dst").withColumnRenamed("z", "w")
    seeds = ends.join(z, "node").select(F.lit(0).alias("layer"), "node", F.col("z").alias("cost"), F.lit(None).cast("long").alias("tag"))
    fill = spread(at, seeds, worst=True, block=block).select("node", F.col("cost").alias("fill"))
    near = cut(edges.select("src", "dst").join(fill.toDF("src", "a"), "src").join(fill.toDF("dst", "b"), "dst").where("b <= a"), "near")
    down = cut(near.where("b < a").groupBy(F.col("src").alias("node")).agg(F.min_by("dst", F.struct("b", "dst")).alias("parent")).join(ends, "node", "left_anti"), "down")
    starts = down.select("node").union(ends).select(F.lit(0).alias("layer"), "node", F.lit(0).alias("cost"), F.lit(None).cast("long").alias("tag"))
    level = spread(near.where("a = b").select("src", "dst", F.lit(1).cast("long").alias("w")), starts, block=block).select("node", F.col("tag").alias("over"))
    drop(near)
    return fill.join(down, "node", "left").join(level, "node", "left").select("node", "fill", F.coalesce("parent", "over").alias("parent"))


def _walk(walkers: pa.Table, steps: pa.Table) -> pa.Table:
    """The helper of path(): walkers (goal, back, node) of one source and block, along the block's nodes; the last one of each has left it."""
    prev = dict(zip(steps.column("node").to_pylist(), steps.column("prev").to_pylist(), strict=True))
    rows = []
    for source, goal, back, node in zip(*(walkers.column(c).to_pylist() for c in ("source", "goal", "back", "node")), strict=True):
        while node in prev:
            rows.append((source, goal, back, node, False))
            back, node = back + 1, prev[node]
        if node is not None:
            rows.append((source, goal, back, node, True))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.bool_(),), strict=True)], names=["source", "goal", "back", "node", "left"])


def path(reached: DataFrame, goals: DataFrame, block: Blocks = 0) -> DataFrame:
    """reached (source, node, prev) of shortest(), goals (source, node) -> source, goal, back, node: the path from each goal back to its
    source. Paths are followed through a block at once; a goal that isn't reached has none."""
    block = block or BLOCK
    prev = reached.select(F.col("source").cast("long"), F.col("node").cast("long"), "prev", _block("node", block))
    known = goals.select("source", "node").join(reached.select("source", "node"), ["source", "node"], "left_semi")
    here = cut(known.select(F.col("source").cast("long"), F.col("node").cast("long").alias("goal"), F.lit(0).cast("long").alias("back"), F.col("node").cast("long")), "walkers")
    out = None
    while True:
        active = here.select("source", _block("node", block)).distinct()
        walkers = here.withColumn("block", _block("node", block)).groupBy("source", "block")
        went = cut(walkers.cogroup(prev.join(active, ["source", "block"], "left_semi").groupBy("source", "block")).applyInArrow(_walk, "source long, goal long, back long, node long, left boolean"), "path")
        drop(here)
        part = went.where("NOT left").drop("left")
        out = part if out is None else out.unionByName(part)
        here = cut(went.where("left").drop("left"), "walkers")
        if not here.limit(1).count():
            drop(here)
            return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), some at a time, as links of their nodes to the smallest ones that they join."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def links() -> pa.RecordBatch:
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        u, v = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                root[max(a, c)] = min(a, c)
        if len(root) > CHUNK:
            yield links()
            root.clear()
    yield links()


def linked(edges: DataFrame) -> DataFrame:
    """edges (src, dst) in any direction -> node, root: the smallest node that can be reached, of all nodes with an edge to another.

    Tasks first contract the edges that they hold; what is left goes through alternating stars, whose number is the logarithm of the largest component."""
    near = edges.where("src != dst").select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    e = cut(near.mapInArrow(_forest, "u long, v long").distinct(), "links")
    state = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("double"))).first()
    before = state(e)
    while before[0]:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        new = cut(small, "links")
        drop(e)
        e, now = new, state(new)
        if now == before:
            break
        before = now
    return e.toDF("node", "root")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node), edges (src, dst) in any direction -> node, component: the smallest node that can be reached."""
    return nodes.select("node").join(linked(edges), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def accumulate(tree: DataFrame, value: str) -> DataFrame:
    """tree (node, parent, value) whose roots have parent null or themselves -> node, total: the sum over a node and all below it.

    Pointers are doubled: a value goes to all its ancestors in as many rounds as the logarithm of the depth, and each round is a
    join and a sum. Sums are exact for integers and decimals."""
    up = tree.select("node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("to"), F.col(value).alias("total"))
    state = cut(up, "tree")
    while state.where("to IS NOT NULL").limit(1).count():
        gift = state.where("to IS NOT NULL").groupBy(F.col("to").alias("node")).agg(F.sum("total").alias("gift"))
        far = state.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = state.join(gift, "node", "left").join(far, "to", "left")
        new = cut(moved.select("node", F.col("next").alias("to"), (F.col("total") + F.coalesce("gift", F.lit(0))).cast(state.schema["total"].dataType).alias("total")), "tree")
        drop(state)
        state = new
    return state.select("node", "total")


def roots(tree: DataFrame) -> DataFrame:
    """tree (node, parent) -> node, root, depth, by pointer doubling."""
    state = cut(tree.select("node", F.coalesce("parent", "node").alias("root"), F.when(F.coalesce("parent", "node") == F.col("node"), 0).otherwise(1).alias("depth")), "tree")
    while True:
        far = state.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        new = cut(state.join(far, "root").select("node", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "tree")
        moved = new.join(state.select("node", F.col("root").alias("was")), "node").where("root != was").limit(1).count()
        drop(state)
        state = new
        if not moved:
            return state


def clamp_along(tree: DataFrame, slack: str) -> DataFrame:
    """tree (node, parent, z, slack) -> node, z: z lowered so that it never exceeds its parent's by more than its slack.

    The least of z of an ancestor plus the slacks on the way there; least and sum compose, so paths are doubled."""
    own = tree.select("node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("to"), "z", F.col(slack).alias("room"))
    state = cut(own, "tree")
    while state.where("to IS NOT NULL").limit(1).count():
        far = state.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("z").alias("far_z"), F.col("room").alias("far_room"))
        new = cut(state.join(far, "to", "left").select("node", F.col("next").alias("to"), F.least("z", F.coalesce(F.col("far_z") + F.col("room"), F.col("z"))).alias("z"), (F.col("room") + F.coalesce("far_room", F.lit(0))).alias("room")), "tree")
        drop(state)
        state = new
    return state.select("node", "z")


def receivers(nodes: DataFrame, edges: DataFrame, by: str = "z") -> DataFrame:
    """nodes (node, z, and `by`), edges (src, dst, km) -> node, receiver: the steepest lower neighbour, or with another column the lower
    neighbour where it is greatest; ties to the smaller node; null where no neighbour is lower."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("z").alias("za")), nodes.select(F.col("node").alias("dst"), F.col("z").alias("zb"), F.col(by).alias("v"))
    lower = edges.join(a, "src").join(b, "dst").where("zb < za")
    rank = (F.col("za") - F.col("zb")) / F.col("km") if by == "z" else F.col("v")
    chosen = lower.groupBy(F.col("src").alias("node")).agg(F.max_by("dst", F.struct(rank, -F.col("dst"))).alias("receiver"))
    return nodes.select("node").join(chosen, "node", "left")


#: Days of travel. Speed in km a day by mode, and how passable each biome is; any other is OTHERWISE.
SPEEDS = {"walk": 30.0, "horse": 55.0, "cart": 35.0, "ship": 130.0}
PASSABLE = {0: 0.0, 1: 0.35, 2: 0.7, 3: 0.75, 4: 0.85, 5: 1.0, 6: 0.6, 7: 0.95, 8: 0.55, 9: 0.4, 10: 0.8}
OTHERWISE = 0.8


def travel_days(mode: str) -> str:
    """SQL: days along an edge with km, and per end (a_, b_) z, ocean, biome, road and river; null where the mode can't pass."""
    if mode == "ship":
        return f"CASE WHEN a_ocean AND b_ocean THEN km / {SPEEDS['ship']}D END"
    mult = lambda end: "CASE " + " ".join(f"WHEN {end}_biome = {i} THEN {m}D" for i, m in PASSABLE.items()) + f" ELSE {OTHERWISE}D END"
    eff = f"((({mult('a')}) + ({mult('b')})) / 2 / (1 + 9 * abs(a_z - b_z) / (1000 * km + 1)))"
    road = f"(CASE WHEN a_road AND b_road THEN greatest(1.8D * {eff}, 0.9D) ELSE {eff} END)"
    ford = "(CASE WHEN b_river AND NOT a_river AND NOT (a_road AND b_road) THEN 0.25D ELSE 0D END)"
    return f"CASE WHEN NOT a_ocean AND NOT b_ocean THEN km / ({SPEEDS[mode]}D * greatest({road}, 0.001D)) + {ford} END"


def news_days(horse: str = "horse", ship: str = "ship") -> str:
    """SQL: struct of days and carrier of news, by courier or ship, the courier's on a tie; null if neither arrives."""
    cents = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
    a, b = cents(f"{horse} * 0.6D"), cents(f"{ship} + 0.5D")
    return f"CASE WHEN {horse} IS NOT NULL AND ({ship} IS NULL OR {a} <= {b}) THEN named_struct('days', {a}, 'by', 'courier') WHEN {ship} IS NOT NULL THEN named_struct('days', {b}, 'by', 'ship') END"


def _peel(held: pa.Table, edges: pa.Table) -> pa.Table:
    """The helper of accumulate_shared(): of one block, the log's rows and the edges within it -> rows for the log. Nodes that no flow is open for
    are settled and pass on what they have; of the others, what has come to them in this round is put out."""
    amount: dict[int, float] = {}
    open_: dict[int, int] = {}
    done: set[int] = set()
    for node, x, n, over in zip(*(held.column(c).to_pylist() for c in ("node", "amount", "open", "done")), strict=True):
        amount[node] = amount.get(node, 0.0) + x
        open_[node] = open_.get(node, 0) + n
        if over:
            done.add(node)
    out: dict[int, list[tuple]] = {}
    for u, v, share in _unbundled(edges):
        out.setdefault(u, []).append((v, share))
    ready = sorted((n for n, k in open_.items() if k == 0 and n not in done), reverse=True)
    settled: dict[int, float] = {}
    came: dict[int, list] = {}
    while ready:
        u = ready.pop()
        settled[u] = amount[u] + came.pop(u, (0.0, 0))[0]
        for v, share in out.get(u, ()):
            x, n = came.get(v, (0.0, 0))
            came[v] = (x + settled[u] * share, n + 1)
            if open_[v] == n + 1:
                ready.append(v)
    rows = [(n, x, 0, True) for n, x in settled.items()] + [(n, x, -k, False) for n, (x, k) in came.items()]
    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.bool_())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["node", "amount", "open", "done"])


def accumulate_shared(nodes: DataFrame, edges: DataFrame, value: str, block: Blocks = 0) -> DataFrame:
    """nodes (node, value), edges (src, dst, share) without cycles -> node, total: what a node has and what flows to it from all above.

    Nodes are peeled in the order of the flow: each has a counter of flows that are open, a block settles all that is complete within
    it in one task, and only amounts that cross to other blocks are shuffled. Rounds are as many as the longest flow crosses blocks. What is
    known of a node is a log of changes, which is summed up every 16 rounds; blocks that nothing has reached aren't touched.

    Parallel edges count together, and so do repeated nodes; a node that only edges name begins with 0, as does one whose value is null. Edges from a
    node to itself and those with a null are left out. A cycle is an error (ValueError)."""
    block = block or BLOCK
    spark = edges.sparkSession
    whole = edges.where("src != dst AND share IS NOT NULL").groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.sum(F.col("share").cast("double")).alias("share"))
    flows = cut(whole.select("src", "dst", "share", _block("src", block), _block("dst", block).alias("to")), "flows")
    inner, crossing = cut(_bundled(flows.where("block = to").drop("to")), "inner"), cut(flows.where("block != to").select("src", "dst", "share"), "crossing")
    none, no = F.lit(0).cast("long"), F.lit(False)
    own = nodes.where("node IS NOT NULL").select(F.col("node").cast("long"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("amount"), none.alias("open"))
    ends = flows.select(F.col("src").alias("node"), F.lit(0.0).alias("amount"), none.alias("open")).unionByName(flows.select(F.col("dst").alias("node"), F.lit(0.0).alias("amount"), F.lit(1).cast("long").alias("open")))
    summed = lambda df: df.groupBy("node").agg(F.sum("amount").alias("amount"), F.sum("open").alias("open"), F.max("done").alias("done"))
    log = [cut(summed(own.unionByName(ends).withColumn("done", no)), "log")]
    schema = log[0].schema
    expected, results, places = log[0].count(), [], None
    read_all = lambda parts: spark.read.schema(schema).parquet(*(x._cut_at for x in parts))
    while True:
        held, here = read_all(log).withColumn("block", _block("node", block)), inner
        if places is not None:
            held, here = held.join(places, "block", "left_semi"), inner.join(places, "block", "left_semi")
        peeled = cut(held.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(_peel, schema), "peeled")
        if places is not None:
            drop(places)
        step = peeled.where("done").join(crossing.select(F.col("src").alias("node"), "dst", "share"), "node")
        offers = cut(step.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("amount") * F.col("share")).alias("amount"), (-F.count("*")).alias("open")).withColumn("done", no), "offers")
        results.append(peeled)
        log += [peeled, offers]
        if not offers.limit(1).count():
            break
        places = cut(offers.select(_block("node", block)).distinct(), "places")
        if len(log) > 32:
            short, ended = cut(summed(read_all(log)).where("NOT done"), "log"), cut(read_all(results).where("done"), "results")
            for old in {x._cut_at: x for x in [*log, *results]}.values():
                drop(old)
            log, results = [short], [ended]
    total = cut(read_all(results).where("done").select("node", F.col("amount").alias("total")), "total")
    for old in {x._cut_at: x for x in [flows, inner, crossing, *log, *results]}.values():
        drop(old)
    if total.count() != expected:
        raise ValueError("the flow runs in a cycle")
    return total


def shares_by_slope(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, z), edges (src, dst, km) -> src, dst, share: of all lower neighbours, in proportion to the slope."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("z").alias("za")), nodes.select(F.col("node").alias("dst"), F.col("z").alias("zb"))
    lower = edges.join(a, "src").join(b, "dst").where("zb < za").withColumn("slope", (F.col("za") - F.col("zb")) / F.col("km"))
    return lower.join(lower.groupBy("src").agg(F.sum("slope").alias("all")), "src").select("src", "dst", (F.col("slope") / F.col("all")).alias("share"))


def _lightest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges (ca, cb, a, b, w) between components that a task holds, CHUNK at a time, those of the least spanning forest. No other is in that of all edges."""
    held: list[pa.RecordBatch] = []

    def thin() -> pa.RecordBatch:
        rows = sorted(((x["w"], x["a"], x["b"], x["ca"], x["cb"]) for b in held for x in b.to_pylist()))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        for w, a, b, ca, cb in rows:
            u, v = find(ca), find(cb)
            if u != v:
                root[u] = v
                kept.append({"ca": ca, "cb": cb, "a": a, "b": b, "w": w})
        return pa.RecordBatch.from_pylist(kept, schema=held[0].schema)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) > CHUNK:
            yield thin()
            held.clear()
    if held:
        yield thin()


def spanning_tree(edges: DataFrame) -> DataFrame:
    """edges (a, b, w) of an undirected graph -> a, b, w of its least spanning forest; ties in w to the smaller a, then b.

    Boruvka's rounds over contracted edges: tasks drop the edges that can't be in the forest, each component takes its lightest edge out,
    components that have joined become one, and edges within one are dropped. When what is left fits one chunk, it is thinned once more, which ends it."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a != b").groupBy("a", "b").agg(F.min("w").alias("w"))
    e = e.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "a", "b", "w")
    left, tree = cut(e.mapInArrow(_lightest, e.schema), "left"), None
    add = lambda more: more if tree is None else tree.unionByName(more)
    while True:
        if left.count() <= CHUNK:
            last = cut(left.coalesce(1).mapInArrow(_lightest, left.schema).select("a", "b", "w"), "tree")
            drop(left)
            return add(last)
        ends = left.select(F.col("ca").alias("c"), F.struct("w", "a", "b").alias("e"), F.col("cb").alias("to")).union(left.select("cb", F.struct("w", "a", "b"), "ca"))
        light = cut(ends.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.e.a", "m.e.b", "m.e.w", "m.to"), "light")
        tree = add(light.select("a", "b", "w").distinct())
        root = linked(light.select(F.col("c").alias("src"), F.col("to").alias("dst")))
        at = left.join(root.toDF("ca", "ra"), "ca", "left").join(root.toDF("cb", "rb"), "cb", "left").select(F.coalesce("ra", "ca").alias("ca"), F.coalesce("rb", "cb").alias("cb"), "a", "b", "w").where("ca != cb")
        new = cut(at.mapInArrow(_lightest, left.schema), "left")
        drop(left)
        left = new
