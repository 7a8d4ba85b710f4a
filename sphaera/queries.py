"""One query for each operator over the driver's tables, with SQL that computes the same elsewhere.

Tables play the parts of worlds: customers and suppliers are places, a ring of suppliers with steps of 1 and 7 is a travel graph,
events are entries of entities in time, conversations are scenes. Floating results are rounded to millionths on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import astro, calendar, geo
from .operators import exports, fields, filters, graph, ledger, ranking, stats, store, temporal, views
from .plans.nodes import run_graph
from .sources import grid
from .streaming.news import deliver_once
from .tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FREQ = 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(e: str, name: str) -> str:
    return f"floor(({e}) * 1000000 + 0.5) / 1000000 AS {name}"


# --- the parts that tables play -------------------------------------------------------------------------------------------

#: Customers that fall to a cell make its height, temperature and rain.
_LAYERS = ("CAST(coalesce(bal, 0) - 2500 AS DOUBLE) AS z", "CAST(coalesce(nation, 0) * 23 AS DOUBLE) / 10 - 20 AS t", "CAST(coalesce(turn, 0) AS DOUBLE) AS p")
_FALLS = ("sum(CAST(floor(c_acctbal) AS BIGINT)) AS bal", "max(c_nationkey) AS nation", "sum(c_custkey * 53 % 2500) AS turn")
#: SQL of the frequency of a grid with about half as many cells as there are customers, of its cells, and of their layers.
FQ_SQL = "fq AS (SELECT CAST(floor(sqrt(count(*) / 20.0)) AS BIGINT) + 2 AS f FROM customer)"
GRID_SQL = f"""{FQ_SQL}, g AS (SELECT {grid.first("f")} + col AS cell, row, col, f FROM (SELECT row, f, unnest(range(0, {grid.width("f")})) AS col FROM (SELECT f, unnest(range(0, 3 * f + 1)) AS row FROM fq)))
, fell AS (SELECT c_custkey % (10 * f * f + 2) AS cell, {", ".join(_FALLS)} FROM customer, fq GROUP BY 1), w AS (SELECT cell, row, col, {", ".join(_LAYERS)} FROM g LEFT JOIN fell USING (cell))"""
#: SQL of the size of a raster with about a pixel for each customer, and of its pixels.
RASTER_SQL = (
    "dim AS (SELECT h, 2 * h AS w FROM (SELECT CAST(floor(sqrt(count(*) / 2.0)) AS BIGINT) AS h FROM customer)), "
    "px AS (SELECT p // w AS y, p % w AS x, p AS node, avg(z) AS z FROM (SELECT c_custkey % (w * h) AS p, c_acctbal AS z, w FROM customer, dim) GROUP BY ALL)"
)
LON, LAT = "CAST({0} * 137 % 36000 AS DOUBLE) / 100 - 180", "CAST({0} * 73 % 17000 AS DOUBLE) / 100 - 85"
PLACES_SQL = f"places AS (SELECT c_custkey AS place, {LON.format('c_custkey')} AS lon, {LAT.format('c_custkey')} AS lat, CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) AS score FROM customer)"
RING_SQL = """n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s AS src, (s + k) % n AS dst, 1 + (s * 13 + k * 5) % 9 AS w FROM n, range(0, n) r(s), (VALUES (1), (7)) v(k)),
ring AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)"""
ENTRIES_SQL = """entries AS (SELECT user_id AS entity, event_type AS attr, value, CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'gen' END AS source,
  CASE WHEN event_id % 5 > 0 THEN CAST(epoch(date_trunc('day', ts)) / 86400 AS DOUBLE) END AS valid_from,
  CASE WHEN event_id % 7 = 0 THEN CAST(epoch(date_trunc('day', ts)) / 86400 AS DOUBLE) + 30 END AS valid_to, event_id AS rev FROM events)"""


def frequency(spark: SparkSession, d: str) -> int:
    return int(math.sqrt(read(spark, d, "customer").count() / 20)) + 2


def world(spark: SparkSession, d: str) -> DataFrame:
    f = frequency(spark, d)
    fell = read(spark, d, "customer").groupBy((F.col("c_custkey") % (10 * f * f + 2)).alias("cell")).agg(*map(F.expr, _FALLS))
    return grid.lattice(spark, f).join(fell, "cell", "left").selectExpr("cell", "row", "col", *_LAYERS)


def raster(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    """A raster as high at each pixel as the mean of the balances that fall to it; its width and height."""
    c = read(spark, d, "customer")
    h = int(math.sqrt(c.count() / 2))
    p = c.groupBy((F.col("c_custkey") % (2 * h * h)).alias("p")).agg(F.avg("c_acctbal").alias("z"))
    return p.selectExpr(f"CAST(floor(p / {2 * h}) AS BIGINT) AS y", f"p % {2 * h} AS x", "p AS node", "z"), 2 * h, h


def places(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").selectExpr("c_custkey AS place", f"{LON.format('c_custkey')} AS lon", f"{LAT.format('c_custkey')} AS lat", "CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) AS score")


def ring(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "supplier").count()
    e = spark.range(n).withColumn("k", F.explode(F.array(F.lit(1), F.lit(7)))).selectExpr("id AS src", f"(id + k) % {n} AS dst", "1 + (id * 13 + k * 5) % 9 AS w")
    return e.union(e.select("dst", "src", "w")).toDF("src", "dst", "w")


def entries(spark: SparkSession, d: str) -> DataFrame:
    day = "CAST(unix_date(CAST(ts AS DATE)) AS DOUBLE)"
    return read(spark, d, "events").selectExpr("user_id AS entity", "event_type AS attr", "value", "CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'gen' END AS source", f"CASE WHEN event_id % 5 > 0 THEN {day} END AS valid_from", f"CASE WHEN event_id % 7 = 0 THEN {day} + 30 END AS valid_to", "event_id AS rev")


# --- sources --------------------------------------------------------------------------------------------------------------


@query(f"WITH {GRID_SQL} SELECT cell, row, col, (row IN (0, 3 * f) OR (row IN (f, 2 * f) AND col % f = 0)) AS pentagon FROM g")
def src_grid_cells(spark, d):
    return grid.cells(spark, frequency(spark, d)).select("cell", "row", "col", "pentagon")



@query(f"WITH {RASTER_SQL} SELECT i AS idx, i // w AS y, i % w AS x, {r6('90 - (i // w + 0.5) * 180 / h', 'lat')}, {r6('(i % w + 0.5) * 360 / w - 180', 'lon')} FROM (SELECT w, h, unnest(range(0, w * h)) AS i FROM dim)")
def src_raster_pixels(spark, d):
    _, w, h = raster(spark, d)
    return grid.pixels(spark, w, h).selectExpr("idx", "y", "x", r6("lat", "lat"), r6("lon", "lon"))


@query(f"WITH f AS (SELECT i AS id, 1 - 2 * (i + 0.5) / n AS y, pi() * (3 - sqrt(5)) * i AS phi FROM (SELECT n, unnest(range(0, n)) AS i FROM (SELECT count(*) AS n FROM customer))) SELECT id, {r6('cos(phi) * sqrt(1 - y * y)', 'x')}, {r6('y', 'y')}, {r6('sin(phi) * sqrt(1 - y * y)', 'z')} FROM f")
def src_fibonacci_sphere(spark, d):
    """A direction for each customer."""
    return grid.fibonacci_sphere(spark, read(spark, d, "customer").count()).selectExpr("id", r6("x", "x"), r6("y", "y"), r6("z", "z"))


# --- fields and filters -----------------------------------------------------------------------------------------------------


def _two(spark, d):
    w, f = world(spark, d), frequency(spark, d)
    return fields.Field(w.selectExpr("cell", "z AS v"), f), fields.Field(w.selectExpr("cell", "p AS v"), f)


@query(f"WITH {GRID_SQL} SELECT op, cell, {r6('v', 'v')} FROM (SELECT 'add' AS op, cell, 2 * z + 0.5 * p AS v FROM w UNION ALL SELECT 'sub', cell, 2 * z - 0.5 * p FROM w UNION ALL SELECT 'mul', cell, 2 * z * 0.5 * p FROM w UNION ALL SELECT 'min', cell, least(2 * z, 0.5 * p) FROM w UNION ALL SELECT 'max', cell, greatest(2 * z, 0.5 * p) FROM w)")
def fld_math(spark, d):
    a, b = _two(spark, d)
    out = None
    for op in ("add", "sub", "mul", "min", "max"):
        df = fields.math(op, a, b, 2.0, 0.5).df.selectExpr(f"'{op}' AS op", "cell", r6("v", "v"))
        out = df if out is None else out.unionByName(df)
    return out


@query(f"WITH {GRID_SQL} SELECT cell, {r6('z * 0.75 + p * 0.25', 'v')} FROM w")
def fld_math_lerp(spark, d):
    return fields.math("lerp", *_two(spark, d), 0.25).df.selectExpr("cell", r6("v", "v"))


@query(f"WITH {GRID_SQL}, s AS (SELECT cell, z, least(1, greatest(0, (z - 100) / 800 + 0.5)) AS t FROM w) SELECT cell, CASE WHEN z > 100 THEN 1.0::DOUBLE ELSE 0 END AS hard, {r6('t * t * (3 - 2 * t)', 'smooth')}, {r6('1 - t * t * (3 - 2 * t)', 'inverse')} FROM s")
def fld_mask(spark, d):
    a = _two(spark, d)[0]
    hard, smooth, inverse = (fields.mask(a, 100.0, s, i).df.withColumnRenamed("v", n) for s, i, n in ((0.0, False, "hard"), (800.0, False, "smooth"), (800.0, True, "inverse")))
    return hard.join(smooth, "cell").join(inverse, "cell").selectExpr("cell", "hard", r6("smooth", "smooth"), r6("inverse", "inverse"))


@query(
    f"WITH {GRID_SQL}, a AS (SELECT cell, z / 10 + t + 220 * (p / 2500 - 0.5) * exp(-abs(z / 10 + t) / 350) AS v FROM w) "
    f"SELECT cell, {r6('CASE WHEN v > 0 AND v < 200 THEN v / 200 * (v / 200) * 200 WHEN v < 0 AND v > -300 THEN -(-v / 300) * (-v / 300) * 300 ELSE v END', 'v')} FROM a"
)
def fld_combine(spark, d):
    w = world(spark, d)
    return w.select("cell", fields.combine(F.col("z") / 10, F.col("t"), F.col("p") / 2500 - 0.5).alias("v")).selectExpr("cell", r6("v", "v"))


_BIOME = "CASE WHEN z <= 0 THEN 0 WHEN t < -12 THEN 1 WHEN t < -2 THEN 2 WHEN z > 3300 THEN 9 WHEN p < 220 THEN 8 WHEN t < 6 THEN 3 WHEN t > 21 AND p > 1600 THEN 6 WHEN t > 19 AND p < 1100 THEN 7 WHEN p < 550 THEN 5 ELSE 4 END"


@query(f"WITH {GRID_SQL}, b AS (SELECT *, {_BIOME} AS biome FROM w) SELECT cell, biome, {r6('CASE WHEN biome IN (0, 1, 8) THEN 0 ELSE least(1, greatest(0, least(p / 1800, (t + 8) / 32))) END', 'vegetation')}, {r6('CASE WHEN z > 0 THEN greatest(0, p - 0.55 * least(1800, greatest(0, 45 * (t + 5)))) + 15 ELSE 0 END', 'runoff')} FROM b")
def flt_biome(spark, d):
    b = world(spark, d).withColumn("biome", F.expr(fields.biome_sql("z", "t", "p")))
    b = b.withColumns({"veg": fields.vegetation(F.col("biome"), F.col("t"), F.col("p")), "run": fields.runoff(F.col("z"), F.col("t"), F.col("p"))})
    return b.selectExpr("cell", "biome", r6("veg", "vegetation"), r6("run", "runoff"))


@query(f"WITH {PLACES_SQL} SELECT place, {r6('-23 + 50 * power(greatest(0, cos(radians(lat))), 1.4) - 6.5 * greatest(0, score) / 1000', 'temperature')} FROM places")
def fld_temperature(spark, d):
    return places(spark, d).select("place", fields.temperature(F.col("lat"), F.col("score").cast("double")).alias("x")).selectExpr("place", r6("x", "temperature"))


_RINGZ = "CAST({0} * 7919 % 997 AS BIGINT)"


def _ring_cells(spark, d):
    n = read(spark, d, "supplier").count()
    return spark.range(n).selectExpr("id AS cell", f"{_RINGZ.format('id')} - 500 AS z")


@query(f"WITH {RING_SQL} SELECT src AS cell, {r6('max(abs(' + _RINGZ.format('src') + ' - ' + _RINGZ.format('dst') + ')) / 40000.0', 'slope')}, bool_or({_RINGZ.format('src')} > 500 AND {_RINGZ.format('dst')} <= 500) AS coast FROM ring GROUP BY src")
def fld_slope_coast(spark, d):
    c, e = _ring_cells(spark, d), ring(spark, d)
    return fields.slope(c, e).join(fields.coast(c, e), "cell").selectExpr("cell", r6("slope", "slope"), "coast")


@query(f"WITH {RASTER_SQL} SELECT y // 3 AS y, x // 3 AS x, {r6('avg(z)', 'v')} FROM px GROUP BY ALL")
def fld_downsample_avg(spark, d):
    return fields.downsample(raster(spark, d)[0].withColumnRenamed("z", "v"), 3).selectExpr("y", "x", r6("v", "v"))


def _pixels(spark):
    return grid.pixels(spark, 36, 18).selectExpr("y", "x", "CAST(idx * 7 % 101 AS DOUBLE) AS v")


@query(f"WITH {PLACES_SQL} SELECT place, CAST((CAST(least(17, floor((90 - lat) / 180 * 18)) AS BIGINT) * 36 + CAST(least(35, floor((lon + 180) / 360 * 36)) AS BIGINT)) * 7 % 101 AS DOUBLE) AS v FROM places")
def fld_sample_nearest(spark, d):
    return fields.sample_nearest(places(spark, d).select("place", "lon", "lat"), _pixels(spark), 36, 18).select("place", "v")


@query(
    f"WITH {PLACES_SQL}, f AS (SELECT place, (lon + 180) / 10 - 0.5 AS fx, (90 - lat) / 10 - 0.5 AS fy FROM places), "
    "c AS (SELECT place, CAST((CAST(floor(fx) AS BIGINT) + dx + 36) % 36 AS BIGINT) AS x, CAST(least(17, greatest(0, floor(fy) + dy)) AS BIGINT) AS y, CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END * CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END AS wt FROM f, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) k(dx, dy)) "
    f"SELECT place, {r6('sum(wt * ((y * 36 + x) * 7 % 101))', 'v')} FROM c GROUP BY place"
)
def fld_sample_bilinear(spark, d):
    return fields.sample_bilinear(places(spark, d), "place", _pixels(spark), 36, 18).selectExpr("place", r6("v", "v"))


SPEC = {
    "hard": [{"field": "p_size", "op": "between", "value": [5, 45]}, {"field": "p_retailprice", "op": "gt", "value": 905.0}],
    "soft": [{"field": "p_size", "fn": "gauss", "center": 25.0, "width": 10.0, "weight": 2.0}, {"field": "p_retailprice", "fn": "inv", "scale": 2000.0}],
    "mult": [{"field": "p_size", "fn": "penalty", "scale": 0.01, "cap": 0.3}, {"field": "p_retailprice", "fn": "bonus", "scale": 3000.0, "weight": 0.25}],
}


@query(
    "SELECT p_partkey, " + r6("CASE WHEN p_size BETWEEN 5 AND 45 AND p_retailprice > 905 THEN greatest(0, greatest(0, 2 * exp(-power((p_size - 25) / 10.0, 2)) + 1 - least(1, p_retailprice / 2000)) * (1 - least(0.3, p_size * 0.01)) * (1 + 0.25 * least(1, p_retailprice / 3000))) ELSE 0 END", "s") + " FROM part"
)
def flt_suitability(spark, d):
    part = read(spark, d, "part")
    if errors := filters.validate(SPEC, part.columns):
        raise ValueError("; ".join(errors))
    return part.select("p_partkey", filters.suitability(SPEC).alias("x")).selectExpr("p_partkey", r6("x", "s"))




# --- graphs -----------------------------------------------------------------------------------------------------------------



_SSSP = "WITH RECURSIVE {ring}, d(node, dist) USING KEY (node) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT r.dst, min(d.dist + r.w) FROM d JOIN ring r ON d.node = r.src LEFT JOIN recurring.d k ON k.node = r.dst WHERE k.dist IS NULL OR d.dist + r.w < k.dist GROUP BY r.dst)"


@query(_SSSP.format(ring=RING_SQL) + " SELECT CAST(0 AS BIGINT) AS source, node, dist FROM d")
def gr_sssp(spark, d):
    return graph.shortest(ring(spark, d), spark.range(1).selectExpr("id AS source", "id AS node")).select("source", "node", "dist")



@query(
    "WITH RECURSIVE {ring}, d(src0, node, dist) USING KEY (src0, node) AS (SELECT s, s, CAST(0 AS BIGINT) FROM n, range(0, n, 17) r(s) UNION SELECT d.src0, r.dst, min(d.dist + r.w) FROM d JOIN ring r ON d.node = r.src LEFT JOIN recurring.d k ON k.node = r.dst AND k.src0 = d.src0 WHERE k.dist IS NULL OR d.dist + r.w < k.dist GROUP BY d.src0, r.dst) "
    "SELECT node, min(dist) AS dist, arg_min(src0, dist * 1000000 + src0) AS source FROM d GROUP BY node".format(ring=RING_SQL)
)
def gr_voronoi(spark, d):
    n = read(spark, d, "supplier").count()
    return graph.territories(ring(spark, d), spark.range(0, n, 17).selectExpr("id AS source", "id AS node"))



_TREE_SQL = "t AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey > 1 THEN s_suppkey // 3 + CASE WHEN s_suppkey < 3 THEN 1 ELSE 0 END END AS parent FROM supplier), v AS (SELECT l_suppkey AS node, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1), tv AS (SELECT t.node, parent, coalesce(q, 0) AS q FROM t LEFT JOIN v USING (node))"


def _tree(spark, d):
    parent = "CASE WHEN s_suppkey > 1 THEN CAST(floor(s_suppkey / 3) AS BIGINT) + CASE WHEN s_suppkey < 3 THEN 1 ELSE 0 END END AS parent"
    q = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.sum("l_quantity").cast("long").alias("q"))
    return read(spark, d, "supplier").selectExpr("s_suppkey AS node", parent).join(q, "node", "left").selectExpr("node", "parent", "coalesce(q, 0) AS q")


@query(f"WITH RECURSIVE {_TREE_SQL}, up(node, anc) AS (SELECT node, node FROM tv UNION ALL SELECT up.node, tv.parent FROM up JOIN tv ON up.anc = tv.node WHERE tv.parent IS NOT NULL) SELECT anc AS node, CAST(sum(q) AS BIGINT) AS total FROM up JOIN tv USING (node) GROUP BY anc")
def gr_accum_single(spark, d):
    return graph.accumulate(_tree(spark, d), "q")


@query(f"WITH RECURSIVE {_TREE_SQL}, up(node, anc, depth) AS (SELECT node, node, 0 FROM tv UNION ALL SELECT up.node, tv.parent, depth + 1 FROM up JOIN tv ON up.anc = tv.node WHERE tv.parent IS NOT NULL) SELECT node, arg_max(anc, depth) AS root, max(depth) AS depth FROM up GROUP BY node")
def gr_roots(spark, d):
    return graph.roots(_tree(spark, d))


@query(f"WITH RECURSIVE {_TREE_SQL}, up(node, anc, z, room) AS (SELECT node, node, node * 37 % 101, CAST(0 AS BIGINT) FROM tv UNION ALL SELECT up.node, tv.parent, tv.parent * 37 % 101, room + up.anc % 5 FROM up JOIN tv ON up.anc = tv.node WHERE tv.parent IS NOT NULL) SELECT node, min(z + room) AS z FROM up GROUP BY node")
def gr_thermal_clamp(spark, d):
    t = _tree(spark, d).selectExpr("node", "parent", "node * 37 % 101 AS z", "node % 5 AS slack")
    return graph.clamp_along(t, "slack")


_FLOODZ = "{0} * 7919 % 997"



@query(
    f"WITH {RING_SQL}, low AS (SELECT src, dst, ({_FLOODZ.format('src')} - {_FLOODZ.format('dst')}) / w AS s, dst * 31 % 89 AS a FROM ring WHERE {_FLOODZ.format('dst')} < {_FLOODZ.format('src')}), "
    "p AS (SELECT src, first(dst ORDER BY s DESC, dst) AS steepest, first(dst ORDER BY a DESC, dst) AS fullest FROM low GROUP BY src) SELECT s AS node, coalesce(steepest, -1) AS steepest, coalesce(fullest, -1) AS fullest FROM n, range(0, n) r(s) LEFT JOIN p ON p.src = r.s"
)
def gr_receivers(spark, d):
    n = read(spark, d, "supplier").count()
    nodes = spark.range(n).selectExpr("id AS node", f"{_FLOODZ.format('id')} AS z", "id * 31 % 89 AS a")
    e = ring(spark, d).withColumnRenamed("w", "km")
    return graph.receivers(nodes, e).withColumnRenamed("receiver", "steepest").join(graph.receivers(nodes, e, "a").withColumnRenamed("receiver", "fullest"), "node").fillna(-1)


_ENDS = "{0} % 11 = 0 AS {1}_ocean, {0} % 13 AS {1}_biome, {0} * 7919 % 997 AS {1}_z, {0} % 4 = 0 AS {1}_road, {0} % 6 = 1 AS {1}_river"


def _travel(spark, d):
    return ring(spark, d).selectExpr("src", "dst", "CAST(w * 10 AS DOUBLE) AS km", _ENDS.format("src", "a").split(", ")[0], *_ENDS.format("src", "a").split(", ")[1:], *_ENDS.format("dst", "b").split(", "))


def _days_sql() -> str:
    """The courier's days again, in plain steps."""
    m = "CASE WHEN {0} <= 10 THEN list_value(" + ", ".join(str(x) for x in graph.PASSABLE.values()) + f")[{{0}} + 1] ELSE {graph.OTHERWISE} END"
    return (
        f"x AS (SELECT src, dst, w * 10.0 AS km, {_ENDS.format('src', 'a')}, {_ENDS.format('dst', 'b')} FROM ring), "
        f"y AS (SELECT *, ({m.format('a_biome')} + {m.format('b_biome')}) / 2 / (1 + 9 * abs(a_z - b_z) / (1000 * km + 1)) AS eff FROM x), "
        "z AS (SELECT *, CASE WHEN a_road AND b_road THEN greatest(1.8 * eff, 0.9) ELSE eff END AS eff2 FROM y) "
    )


@query(f"WITH {RING_SQL}, {_days_sql()} SELECT src, dst, {r6('CASE WHEN NOT a_ocean AND NOT b_ocean THEN km / (55 * greatest(eff2, 0.001)) + CASE WHEN b_river AND NOT a_river AND NOT (a_road AND b_road) THEN 0.25 ELSE 0 END END', 'horse')}, {r6('CASE WHEN a_ocean AND b_ocean THEN km / 130 END', 'ship')} FROM z")
def gr_travel_graph(spark, d):
    return _travel(spark, d).selectExpr("src", "dst", r6(graph.travel_days("horse"), "horse"), r6(graph.travel_days("ship"), "ship"))



@query(f"WITH {GRID_SQL}, a AS (SELECT cell, CASE WHEN z > 100 THEN 1 ELSE 0 END * p AS v FROM w) SELECT cell, {r6('v * 0.5 + z * 0.5', 'v')} FROM a JOIN w USING (cell)")
def q_graph_run(spark, d):
    z, p = _two(spark, d)
    spec = {
        "z": {"type": "source", "source": "z"},
        "p": {"type": "source", "source": "p"},
        "land": {"type": "mask", "inputs": {"a": "z"}, "params": {"threshold": 100.0}},
        "wet": {"type": "math", "inputs": {"a": "land", "b": "p"}, "params": {"op": "mul"}},
        "mix": {"type": "math", "inputs": {"a": "wet", "b": "z"}, "params": {"op": "lerp", "ka": 0.5}},
    }
    return run_graph(spec, {"z": z, "p": p})["mix"].df.selectExpr("cell", r6("v", "v"))


# --- time and entities --------------------------------------------------------------------------------------------------------

_HOLDS = "row_number() OVER (PARTITION BY entity, attr ORDER BY (source = 'user') DESC, (valid_from IS NOT NULL OR valid_to IS NOT NULL) DESC, coalesce(valid_from, -1e18) DESC, rev DESC)"


@query(f"WITH {ENTRIES_SQL}, r AS (SELECT *, {_HOLDS} AS k FROM entries) SELECT entity, attr, value FROM r WHERE k = 1")
def st_resolve(spark, d):
    return temporal.resolve(entries(spark, d))


@query(f"WITH {ENTRIES_SQL}, r AS (SELECT *, {_HOLDS} AS k FROM entries WHERE coalesce(valid_from <= 19730, true) AND coalesce(valid_to > 19730, true)) SELECT entity, attr, value FROM r WHERE k = 1")
def jn_asof_attr(spark, d):
    return temporal.resolve(entries(spark, d), F.lit(19730.0))


@query("SELECT l.event_id, coalesce(r.event_id, -1) AS last_error FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def jn_location_asof(spark, d):
    e = read(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("last_error"))
    return temporal.asof(left, right, "user_id", "ts", "since", "last_error").select("event_id", "last_error").fillna(-1)


ERAS = [("dawn", 0.0, 8500.0), ("gold", 8400.0, 9500.0), ("iron", 9500.0, 10200.0)]



MONTHS = [("thaw", 40), ("sun", 61), ("reap", 33), ("frost", 30)]


@query("WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders), r AS (SELECT *, day // 164 AS year, day % 164 AS m FROM o) SELECT o_orderkey, CAST(year AS BIGINT) AS year, CASE WHEN m < 40 THEN 'thaw' WHEN m < 101 THEN 'sun' WHEN m < 134 THEN 'reap' ELSE 'frost' END AS month, CAST(1 + m - CASE WHEN m < 40 THEN 0 WHEN m < 101 THEN 40 WHEN m < 134 THEN 101 ELSE 134 END AS BIGINT) AS day, CAST(day AS BIGINT) AS back FROM r")
def win_year_month_day(spark, d):
    o = read(spark, d, "orders").selectExpr("o_orderkey", "unix_date(CAST(o_orderdate AS DATE)) AS n")
    o = o.select("o_orderkey", calendar.to_date(F.col("n"), MONTHS).alias("t")).select("o_orderkey", "t.*")
    return o.withColumn("back", calendar.to_day(F.col("year"), F.col("month"), F.col("day"), MONTHS))


@query("WITH p AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_id FROM events) SELECT user_id, event_id, prev_event_id FROM p WHERE prev_event_id IS NOT NULL")
def win_trail_pairs(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id")
    return temporal.trail(e, "user_id", "ts", "event_id").select("user_id", "event_id", "prev_event_id")


@query("WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM a GROUP BY user_id, event_type, g")
def win_biome_runs(spark, d):
    return temporal.runs(read(spark, d, "events"), "user_id", "event_id", "event_type").drop("run")


@query("WITH a AS (SELECT user_id, event_id, value, CASE WHEN event_id - lag(event_id) OVER w <= 40 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS session FROM a) SELECT user_id, min(event_id) AS start, max(event_id) AS stop, count(*) AS n, first(event_id ORDER BY value, event_id) AS peak, min(value) AS least FROM s GROUP BY user_id, session")
def win_conjunction_sessions(spark, d):
    return temporal.sessions(read(spark, d, "events"), ["user_id"], "event_id", 40, "value").drop("session")



def _store(spark, d):
    o = read(spark, d, "orders")
    base = o.where("o_orderkey % 3 < 2").selectExpr("concat('c:', o_custkey) AS entity", "CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind", "CASE WHEN o_orderkey % 5 = 0 THEN 'status' ELSE 'name' END AS attr", "o_orderstatus AS value", "CASE WHEN o_custkey % 13 = 0 THEN 'user' ELSE 'gen' END AS source", "CAST(NULL AS DOUBLE) AS valid_from", "CAST(NULL AS DOUBLE) AS valid_to", "o_orderkey AS rev")
    locks = read(spark, d, "customer").where("c_custkey % 17 = 0").selectExpr("concat('c:', c_custkey) AS entity", "CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE 'name' END AS attr", "c_custkey % 3 > 0 AS locked", "c_custkey AS rev")
    batch = o.where("o_orderkey % 3 = 2 AND o_custkey % 2 = 0").selectExpr("concat('c:', o_custkey) AS entity", "'even' AS kind", "'name' AS attr", "min(o_orderpriority) OVER (PARTITION BY o_custkey) AS value").distinct()
    return base, locks, batch


_STORE_SQL = """base AS (SELECT 'c:' || o_custkey AS entity, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, CASE WHEN o_custkey % 13 = 0 THEN 'user' ELSE 'gen' END AS source FROM orders WHERE o_orderkey % 3 < 2),
locks AS (SELECT 'c:' || c_custkey AS entity, CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE 'name' END AS attr FROM customer WHERE c_custkey % 17 = 0 AND c_custkey % 3 > 0),
batch AS (SELECT 'c:' || o_custkey AS entity, min(o_orderpriority) AS value FROM orders WHERE o_orderkey % 3 = 2 AND o_custkey % 2 = 0 GROUP BY 1)"""


@query(
    f"WITH {_STORE_SQL}, known AS (SELECT DISTINCT entity FROM base), open AS (SELECT entity, value FROM batch WHERE entity NOT IN (SELECT entity FROM locks WHERE attr = '*')) "
    "SELECT entity, 'name' AS attr, value, CASE WHEN entity IN (SELECT entity FROM known) THEN 'updated' ELSE 'created' END AS action FROM open WHERE entity NOT IN (SELECT entity FROM locks) "
    "UNION ALL SELECT entity, '_retired', 'true', 'retired' FROM base WHERE kind = 'even' AND entity NOT IN (SELECT entity FROM batch) AND entity NOT IN (SELECT entity FROM locks) GROUP BY entity HAVING bool_and(source = 'gen')"
)
def st_apply_generation(spark, d):
    return store.apply_generation(*_store(spark, d), rev=1 << 40).select("entity", "attr", "value", "action")


@query(
    f"WITH {_STORE_SQL}, known AS (SELECT DISTINCT entity FROM base), open AS (SELECT entity FROM batch WHERE entity NOT IN (SELECT entity FROM locks WHERE attr = '*')) "
    "SELECT (SELECT count(*) FROM open WHERE entity NOT IN (SELECT entity FROM known)) AS created, (SELECT count(*) FROM open WHERE entity IN (SELECT entity FROM known)) AS updated, "
    "(SELECT count(*) FROM (SELECT entity FROM base WHERE kind = 'even' AND entity NOT IN (SELECT entity FROM batch) AND entity NOT IN (SELECT entity FROM locks) GROUP BY entity HAVING bool_and(source = 'gen'))) AS retired"
)
def agg_merge_stats(spark, d):
    return store.merge_counts(*_store(spark, d))


@query("SELECT 'c:' || c_custkey AS entity, CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE 'name' END AS attr FROM customer WHERE c_custkey % 17 = 0 AND c_custkey % 3 > 0")
def st_lock(spark, d):
    return store.locked(_store(spark, d)[1])


@query("WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS u FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 5 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM a) SELECT 'c:' || o_custkey AS entity, CASE WHEN o_custkey % 10 = 0 THEN 'staged' ELSE o_orderstatus END AS name FROM r WHERE k = 1")
def cs_preview(spark, d):
    canon = _store(spark, d)[0]
    ops = canon.where("attr = 'name'").select("entity", "kind", "attr").distinct().where("CAST(substring(entity, 3) AS INT) % 10 = 0").selectExpr("entity", "kind", "attr", "'staged' AS value", "'user' AS source", "CAST(NULL AS DOUBLE) AS valid_from", "CAST(NULL AS DOUBLE) AS valid_to")
    return temporal.resolve(store.preview(canon, ops).where("attr = 'name'")).select("entity", F.col("value").alias("name"))


@query("SELECT 'p:' || p_partkey AS entity, p_name AS name FROM part WHERE p_partkey % 2 = 0 AND contains(lower(p_name), 'al') AND p_partkey % 5 > 0")
def q_entities(spark, d):
    part = read(spark, d, "part")
    row = lambda attr, value, cond: part.where(cond).selectExpr("concat('p:', p_partkey) AS entity", "CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind", f"'{attr}' AS attr", f"{value} AS value", "'gen' AS source", "CAST(NULL AS DOUBLE) AS valid_from", "CAST(NULL AS DOUBLE) AS valid_to", "p_partkey AS rev")
    return store.find(row("name", "p_name", "true").unionByName(row("_retired", "'true'", "p_partkey % 5 = 0")), "even", "AL")


@query("SELECT 'place:' || substr(sha1('w|place|' || s_suppkey), 1, 16) AS id, s_suppkey FROM supplier")
def fn_stable_id(spark, d):
    return read(spark, d, "supplier").select(geo.stable_id(F.lit("w"), F.lit("place"), F.col("s_suppkey").cast("string")).alias("id"), "s_suppkey")


# --- ledger -------------------------------------------------------------------------------------------------------------------


def _scenes(spark, d):
    c = read(spark, d, "conversations")
    return c.selectExpr("conv_id AS scene", "role AS seat", "CASE WHEN turn % 3 = 2 THEN 'inner' ELSE 'say' END AS layer", "turn AS ord", "text")


@query("WITH e AS (SELECT conv_id AS scene, role, CASE WHEN turn % 3 = 2 THEN 'inner' ELSE 'say' END AS layer, turn, text FROM conversations), a AS (SELECT DISTINCT scene FROM e WHERE role = 'user') SELECT scene, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, sha1(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM e WHERE scene IN (SELECT scene FROM a) AND (layer <> 'inner' OR role = 'user') GROUP BY scene")
def q_chapterize(spark, d):
    e = _scenes(spark, d)
    c = ledger.chapters(e, e.select("scene", "seat").distinct(), "user")
    return c.select("scene", "n", "chars", F.sha1("text").alias("digest"))


@query("SELECT conv_id AS scene, turn AS ord FROM conversations WHERE turn % 3 < 2 OR role = 'system'")
def flt_visible_entries(spark, d):
    return ledger.visible(_scenes(spark, d), "system").select("scene", "ord")



_NEWS_SQL = "news AS (SELECT o_orderkey AS item, o_custkey % 20 AS seat, o_orderkey % 300 AS arrives_day FROM orders)"


def _news(spark, d):
    return read(spark, d, "orders").selectExpr("o_orderkey AS item", "o_custkey % 20 AS seat", "o_orderkey % 300 AS arrives_day")


@query(f"WITH {_NEWS_SQL} SELECT item, seat FROM news WHERE arrives_day <= seat * 12")
def jn_due_delivery(spark, d):
    return ledger.due(_news(spark, d), spark.range(20).selectExpr("id AS seat", "id * 12 AS now")).select("item", "seat")



@query("SELECT o_custkey AS seat, count(*) AS calls, CAST(sum(o_orderkey % 100) AS BIGINT) AS prompt_tokens, CAST(sum(o_orderkey % 37) AS BIGINT) AS completion_tokens FROM orders GROUP BY 1")
def agg_usage_ledger(spark, d):
    return ledger.usage(read(spark, d, "orders").selectExpr("o_custkey AS seat", "o_orderkey % 100 AS prompt_tokens", "o_orderkey % 37 AS completion_tokens"))



# --- statistics and ranks -------------------------------------------------------------------------------------------------------


@query(f"SELECT min(l_extendedprice) AS least, max(l_extendedprice) AS greatest, {r6('sum(CASE WHEN l_extendedprice <= 20000 THEN l_quantity ELSE 0 END) / sum(l_quantity)', 'ocean_fraction')} FROM lineitem")
def agg_area_weighted_stats(spark, d):
    return stats.area_stats(_hills(spark, d), 20000.0).selectExpr("least", "greatest", r6("ocean_fraction", "ocean_fraction"))


def _hills(spark, d):
    return read(spark, d, "lineitem").selectExpr("CAST(l_extendedprice AS DOUBLE) AS z", "CAST(l_quantity AS DOUBLE) AS area")


@query("WITH h AS (SELECT CAST(l_extendedprice AS DOUBLE) AS z, sum(CAST(l_quantity AS DOUBLE)) AS a FROM lineitem GROUP BY 1), r AS (SELECT z, sum(a) OVER (ORDER BY z) AS upto, sum(a) OVER () AS total FROM h) SELECT q, min(z) AS z FROM r, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(q) WHERE upto >= q * total GROUP BY q")
def agg_hypsometric_pctl(spark, d):
    return stats.area_percentiles(_hills(spark, d), [0.1, 0.5, 0.9])


@query(f"WITH h AS (SELECT CAST(least(31, greatest(0, floor((CAST(l_extendedprice AS DOUBLE) - 30000 + 8000) / 500))) AS INTEGER) AS bin, CAST(l_quantity AS DOUBLE) AS a FROM lineitem) SELECT bin, {r6('1000 * sum(a) / (SELECT sum(a) FROM h)', 'permille')} FROM h GROUP BY bin")
def agg_hypsometric_hist(spark, d):
    return stats.hypsometry(_hills(spark, d).selectExpr("z - 30000 AS z", "area")).selectExpr("bin", r6("permille", "permille"))



@query(f"WITH c AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS p, CAST(p_size AS DOUBLE) AS a FROM part), m AS (SELECT sum(p * a) / sum(a) AS m FROM c) SELECT p_partkey, {r6('least(5000, p * 900 / m)', 'p')} FROM c, m")
def agg_precip_normalise(spark, d):
    c = read(spark, d, "part").selectExpr("p_partkey", "CAST(p_retailprice AS DOUBLE) AS p", "CAST(p_size AS DOUBLE) AS area")
    return stats.normalise_precipitation(c).selectExpr("p_partkey", r6("p", "p"))


_RANK_SQL = f"WITH {PLACES_SQL}, r AS (SELECT place, lon, lat, score, row_number() OVER (ORDER BY score DESC, place) - 1 AS rank, count(*) OVER () AS n FROM places)"


@query(_RANK_SQL + f" SELECT place, rank, {r6('60000 / power(rank + 1, 0.95)', 'population')}, CASE WHEN rank < greatest(1, n // 12) THEN 0 WHEN rank < greatest(2, n // 3) THEN 1 ELSE 2 END AS tier FROM r")
def win_zipf_population(spark, d):
    return ranking.tiers(ranking.zipf(ranking.ranked(places(spark, d), "score", "place"))).selectExpr("place", "rank", r6("population", "population"), "tier")


@query("WITH r AS (SELECT c_custkey AS place, c_nationkey AS nation, c_acctbal AS pop, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT place, nation FROM r WHERE i = 1 OR (i = 2 AND n >= 6) ORDER BY pop DESC, place LIMIT 14")
def win_capitals(spark, d):
    c = read(spark, d, "customer").selectExpr("c_custkey AS place", "c_nationkey AS nation", "c_acctbal AS pop")
    return ranking.capitals(c, "nation", "pop", "place").select("place", "nation")



# --- sky ------------------------------------------------------------------------------------------------------------------------


@query(
    f"WITH m AS (SELECT s_suppkey, 2 * pi() * (s_suppkey % 29 / 29.0) AS m, 0.1 + (s_suppkey % 5) / 10.0 AS e FROM supplier), k0 AS (SELECT *, m + e * sin(m) AS x FROM m), "
    + "".join(f"k{i + 1} AS (SELECT s_suppkey, m, e, x - (x - e * sin(x) - m) / (1 - e * cos(x)) AS x FROM k{i}), " for i in range(8)).rstrip(", ")
    + f" SELECT s_suppkey, {r6('x', 'anomaly')} FROM k8"
)
def fn_kepler(spark, d):
    s = read(spark, d, "supplier").selectExpr("s_suppkey", "2 * pi() * (CAST(s_suppkey % 29 AS DOUBLE) / 29) AS m", "0.1D + CAST(s_suppkey % 5 AS DOUBLE) / 10 AS e")
    return s.select("s_suppkey", astro.kepler(F.col("m"), F.col("e")).alias("x")).selectExpr("s_suppkey", r6("x", "anomaly"))


_NAMES = str(list(astro.PHASES))


@query(f"WITH m AS (SELECT event_id, 2 * pi() * (event_id % 59 / 59.0) AS l FROM events) SELECT event_id, {_NAMES}[CAST(floor(l / (pi() / 4) + 0.5) AS BIGINT) % 8 + 1] AS phase, {r6('(1 - cos(l)) / 2', 'lit')} FROM m")
def q_sky_moon(spark, d):
    m = read(spark, d, "events").selectExpr("event_id", "2 * pi() * (CAST(event_id % 59 AS DOUBLE) / 59) AS l")
    return m.select("event_id", astro.phase_name(F.col("l")).alias("phase"), astro.phase_fraction(F.col("l")).alias("x")).selectExpr("event_id", "phase", r6("x", "lit"))



# --- streams --------------------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey % 20 AS seat, o_orderkey AS item, o_orderkey % 300 AS arrives_day FROM orders WHERE o_orderkey % 300 <= (o_custkey % 20) * 12")
def ss_news_delivery(spark, d):
    """Orders stream in as news; each seat's clock comes with them."""
    schema = read(spark, d, "orders").schema

    def messages(raw: DataFrame) -> DataFrame:
        return raw.selectExpr("o_custkey % 20 AS seat", "o_orderkey AS item", "o_orderkey % 300 AS arrives_day", "(o_custkey % 20) * 12 AS clock")

    return deliver_once(spark, f"{d}/orders*.parquet", schema, messages).select("seat", "item", "arrives_day")


# --- exports --------------------------------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS v FROM part), e AS (SELECT min(v) AS a, max(v) AS b FROM c) SELECT p_partkey, CAST(floor((v - a) / (b - a) * 65535 + 0.5) AS INTEGER) AS level, CASE WHEN v > 1000 THEN 255 ELSE 0 END AS mask FROM c, e")
def sink_png16_norm(spark, d):
    c = read(spark, d, "part").selectExpr("p_partkey", "CAST(p_retailprice AS DOUBLE) AS v")
    return exports.unit16(c, "v").select("p_partkey", "level", exports.mask255(F.col("v") > 1000).alias("mask"))



@query(f"WITH {PLACES_SQL} SELECT place, lon, lat, 'Feature' AS kind FROM places")
def sink_geojson(spark, d):
    """Features written as JSON and read back."""
    p = places(spark, d).select("place", exports.feature(F.lit("place"), F.col("lon"), F.col("lat"), F.struct("place")).alias("f"))
    back = F.from_json("f", "type string, geometry struct<coordinates: array<double>>, properties struct<place: bigint>")
    return p.select(back.alias("b")).selectExpr("b.properties.place AS place", "b.geometry.coordinates[0] AS lon", "b.geometry.coordinates[1] AS lat", "b.type AS kind")


@query("SELECT conv_id AS scene, role AS seat, turn AS ord, length(text) AS chars FROM conversations")
def sink_transcript_jsonl(spark, d):
    """A transcript written as JSON lines and read back."""
    import uuid

    from .tables import shared_dir

    path = f"{shared_dir(spark)}/transcript-{uuid.uuid4().hex}"
    exports.transcript(_scenes(spark, d)).write.text(path)
    return exports.load_transcript(spark, path, "scene long, seat string, layer string, ord long, text string").select("scene", "seat", "ord", F.length("text").alias("chars"))


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def sink_world_save(spark, d):
    """A world of one table, saved twice and loaded."""
    import uuid

    from .tables import shared_dir

    path, t = f"{shared_dir(spark)}/world-{uuid.uuid4().hex}", read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    exports.save_world({"places": t.limit(1)}, path)
    exports.save_world({"places": t}, path)
    return exports.load_world(spark, path, ["places"])["places"]


@query("WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM p WHERE i % greatest(1, n // 20) = 0")
def path_thin(spark, d):
    return exports.thinned(read(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


@query(
    f"WITH {RING_SQL}, m AS (SELECT src, {_RINGZ.format('src')} - 500 AS here, avg({_RINGZ.format('dst')} - 500) AS there FROM ring GROUP BY src), s AS (SELECT count(*) AS seams FROM ring WHERE {_RINGZ.format('src')} > 500 AND {_RINGZ.format('dst')} > 500 AND {_RINGZ.format('src')} - {_RINGZ.format('dst')} > 100) "
    f"SELECT {r6('avg(abs(here - there))', 'roughness')}, first(seams) AS seams FROM m, s WHERE here > 0"
)
def agg_roughness_seams(spark, d):
    c, e = _ring_cells(spark, d), ring(spark, d)
    return exports.roughness(c, e).join(exports.seams(c, e, 100.0), F.lit(True)).selectExpr(r6("roughness", "roughness"), "seams")



def _ramp_sql() -> str:
    """The ramp as a join with its bands."""
    bands = []
    for name, stops in (("sea", exports.RAMP_SEA), ("land", exports.RAMP_LAND)):
        for (a, ca), (b, cb) in zip(stops, stops[1:], strict=False):
            bands.append(f"('{name}', {a}, {b}, " + ", ".join(f"{x}, {y}" for x, y in zip(ca, cb, strict=True)) + ")")
    mix = lambda c: f"CAST(floor({c}a + ({c}b - {c}a) * least(1, greatest(0, (z - a) / (b - a))) + 0.5) AS INTEGER) AS {c}"
    return (
        f"WITH {GRID_SQL}, s AS (SELECT * FROM (VALUES {', '.join(bands)}) v(part, a, b, ra, rb, ga, gb, ba, bb)), "
        "u AS (SELECT cell, CASE WHEN cell = 0 THEN 9999 WHEN cell = 1 THEN -9999 ELSE z END AS z FROM w), "
        f"j AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY a DESC) AS k FROM u JOIN s ON part = CASE WHEN z < 0 THEN 'sea' ELSE 'land' END AND (z >= a OR a = -6000)) SELECT cell, {mix('r')}, {mix('g')}, {mix('b')} FROM j WHERE k = 1"
    )


@query(_ramp_sql())
def sink_color_ramp(spark, d):
    z = F.when(F.col("cell") == 0, 9999).when(F.col("cell") == 1, -9999).otherwise(F.col("z"))
    return world(spark, d).select("cell", exports.color_ramp(z).alias("c")).selectExpr("cell", "c.r AS r", "c.g AS g", "c.b AS b")


@query(
    f"WITH RECURSIVE {RING_SQL}, low AS (SELECT DISTINCT src, dst, w, ({_FLOODZ.format('src')} - {_FLOODZ.format('dst')}) / w AS s FROM ring WHERE {_FLOODZ.format('dst')} < {_FLOODZ.format('src')}), sh AS (SELECT src, dst, sum(s) / sum(sum(s)) OVER (PARTITION BY src) AS share FROM low GROUP BY src, dst), "
    f"f(node, amount) AS (SELECT s, 1.0::DOUBLE FROM n, range(0, n) r(s) UNION ALL SELECT sh.dst, amount * share FROM f JOIN sh ON f.node = sh.src) SELECT node, {r6('sum(amount)', 'total')} FROM f GROUP BY node"
)
def gr_accum_mfd(spark, d):
    n = read(spark, d, "supplier").count()
    nodes = spark.range(n).selectExpr("id AS node", f"{_FLOODZ.format('id')} AS z", "1.0D AS v")
    e = ring(spark, d).distinct().withColumnRenamed("w", "km")
    return graph.accumulate_shared(nodes, graph.shares_by_slope(nodes, e), "v").selectExpr("node", r6("total", "total"))



# --- views and phases -------------------------------------------------------------------------------------------------------------

_RAYS_SQL = "s AS (SELECT user_id AS ray, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 8.0 AS km, value * 40 AS z FROM events), t AS (SELECT ray, km, (greatest(0, z) - 10 - km * 1000 * km * 1000 / (2 * 6371000)) / (km * 1000) AS slope FROM s WHERE km <= 312)"


@query(
    f"WITH {_RAYS_SQL}, u AS (SELECT *, max(slope) OVER (PARTITION BY ray ORDER BY km ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM t) "
    "SELECT ray, coalesce(min(CASE WHEN top > 0.002 AND slope < top - 0.004 THEN km END), 320)::DOUBLE AS km FROM u GROUP BY ray"
)
def gr_viewshed(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    s = read(spark, d, "events").select(F.col("user_id").alias("ray"), (place * 8).cast("double").alias("km"), (F.col("value") * 40).alias("z")).where("km <= 312")
    return views.horizons(views.slopes(s, 10.0))


@query(
    "WITH a AS (SELECT user_id AS view, event_id AS azimuth, value AS angle, value > 10 AS up FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY azimuth) - row_number() OVER (PARTITION BY view, up ORDER BY azimuth) AS g FROM a) "
    "SELECT view, min(azimuth) AS first, max(azimuth) AS last, count(*) AS n, max(angle) AS peak FROM g WHERE up GROUP BY view, g"
)
def gr_skyline(spark, d):
    return views.skyline(read(spark, d, "events").selectExpr("user_id AS view", "event_id AS azimuth", "value AS angle"), 10.0)


@query(_SSSP.format(ring=RING_SQL) + " SELECT count(*) AS cells, max(dist) AS farthest FROM d WHERE dist <= 12")
def agg_isochrone(spark, d):
    r = graph.shortest(ring(spark, d), spark.range(1).selectExpr("id AS source", "id AS node"), limit=12)
    return r.agg(F.count("*").alias("cells"), F.max("dist").alias("farthest"))


@query(_SSSP.format(ring=RING_SQL) + ", b AS (SELECT d.node, min(r.src) AS prev FROM d JOIN ring r ON r.dst = d.node JOIN d p ON p.node = r.src AND p.dist + r.w = d.dist GROUP BY d.node), w(goal, node, back) AS (SELECT n // 2, n // 2, 0 FROM n UNION ALL SELECT goal, prev, back + 1 FROM w JOIN b USING (node) WHERE node <> 0) SELECT goal, CAST(back AS BIGINT) AS back, node FROM w")
def gr_path_extract(spark, d):
    n = read(spark, d, "supplier").count()
    reached = graph.shortest(ring(spark, d), spark.range(1).selectExpr("id AS source", "id AS node"))
    return graph.path(reached, spark.range(n // 2, n // 2 + 1).selectExpr("0L AS source", "id AS node")).select("goal", "back", "node")


@query(
    "WITH RECURSIVE e0 AS (SELECT c_custkey AS a, c_custkey * 7 % 500 + 1000000 AS b FROM customer), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), n AS (SELECT c_custkey AS s FROM customer UNION SELECT b FROM e0), "
    "c(node, root) AS (SELECT s, s FROM n UNION SELECT e.b, c.root FROM c JOIN e ON c.node = e.a) SELECT node, min(root) AS component FROM c GROUP BY node"
)
def gr_components(spark, d):
    c = read(spark, d, "customer")
    e = c.selectExpr("c_custkey AS src", "c_custkey * 7 % 500 + 1000000 AS dst")
    return graph.components(c.selectExpr("c_custkey AS node").union(e.select("dst")).distinct(), e)


@query(
    f"WITH RECURSIVE {RING_SQL}, d(node, fill) USING KEY (node) AS (SELECT s, {_FLOODZ.format('s')} FROM n, range(0, n, 25) r(s) UNION SELECT r.dst, min(greatest(d.fill, {_FLOODZ.format('r.dst')})) FROM d JOIN ring r ON d.node = r.src LEFT JOIN recurring.d k ON k.node = r.dst "
    f"WHERE k.fill IS NULL OR greatest(d.fill, {_FLOODZ.format('r.dst')}) < k.fill GROUP BY r.dst), "
    "e2 AS (SELECT src, dst, a.fill AS fa, b.fill AS fb FROM ring JOIN d a ON a.node = src JOIN d b ON b.node = dst), lo AS (SELECT src AS node, arg_min(dst, fb * 1000000 + dst) AS parent FROM e2 WHERE fb < fa AND src % 25 > 0 GROUP BY src), "
    "h(node, k) USING KEY (node) AS (SELECT s, 0 FROM n, range(0, n, 25) r(s) UNION SELECT node, 0 FROM lo UNION SELECT e2.dst, min(h.k + 1) FROM h JOIN e2 ON e2.src = h.node AND fa = fb LEFT JOIN recurring.h g ON g.node = e2.dst WHERE g.k IS NULL OR h.k + 1 < g.k GROUP BY e2.dst), "
    "fl AS (SELECT h.node, min(e2.src) AS parent FROM h JOIN e2 ON e2.dst = h.node AND fa = fb JOIN h g ON g.node = e2.src AND g.k = h.k - 1 GROUP BY h.node) SELECT node, fill, coalesce(lo.parent, fl.parent) AS parent FROM d LEFT JOIN lo USING (node) LEFT JOIN fl USING (node)"
)
def gr_priority_flood(spark, d):
    n = read(spark, d, "supplier").count()
    return graph.flood(spark.range(n).selectExpr("id AS node", f"{_FLOODZ.format('id')} AS z"), ring(spark, d), spark.range(0, n, 25).withColumnRenamed("id", "node"))


@query(
    f"WITH RECURSIVE {RING_SQL}, e3 AS (SELECT src AS a, dst AS b, w * 100000 + (src * 7 + dst) % 1000 * 100 + src % 97 AS w FROM ring WHERE src < dst), o AS (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS k FROM e3), "
    "t(k, label, total, taken) AS (SELECT CAST(0 AS BIGINT), (SELECT map_from_entries(list((s, s))) FROM n, range(0, n) r(s)), CAST(0 AS HUGEINT), 0 UNION ALL "
    "SELECT o.k, CASE WHEN label[o.a] = label[o.b] THEN label ELSE map_from_entries(list_transform(map_entries(label), lambda x: (x.key, CASE WHEN x.value = label[o.a] THEN label[o.b] ELSE x.value END))) END, total + CASE WHEN label[o.a] = label[o.b] THEN 0 ELSE o.w END, taken + CASE WHEN label[o.a] = label[o.b] THEN 0 ELSE 1 END FROM t JOIN o ON o.k = t.k + 1) "
    "SELECT CAST(arg_max(taken, k) AS BIGINT) AS edges, CAST(arg_max(total, k) AS BIGINT) AS total FROM t"
)
def mst_prim_angular(spark, d):
    e = ring(spark, d).where("src < dst").selectExpr("src AS a", "dst AS b", "w * 100000 + (src * 7 + dst) % 1000 * 100 + src % 97 AS w")
    return graph.spanning_tree(e).agg(F.count("*").alias("edges"), F.sum("w").alias("total"))


@query("WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders) SELECT o_orderkey, CASE WHEN day >= 0 AND day < 8500 THEN 'dawn' WHEN day >= 8400 AND day < 9500 THEN 'gold' WHEN day >= 9500 AND day < 10200 THEN 'iron' END AS era FROM o")
def jn_era_of(spark, d):
    o = read(spark, d, "orders").selectExpr("o_orderkey", "unix_date(CAST(o_orderdate AS DATE)) AS day")
    return o.select("o_orderkey", temporal.interval_of(F.col("day"), ERAS).alias("era"))


@query("SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) AS errors FROM part")
def flt_validate_spec(spark, d):
    """Specs with an unknown field, an operator that isn't there or a Gaussian without width, by part; all that is wrong with one is counted."""
    spec = lambda n: {"hard": [{"field": "p_size" if n % 2 else "height", "op": "gt" if n % 3 else "near", "value": 1}], "soft": [{"field": "p_size", "fn": "gauss", "center": 1.0} | ({"width": 1.0} if n % 5 else {})]}

    def check(frames):
        for f in frames:
            yield f.assign(errors=[len(filters.validate(spec(n), ["p_size"])) for n in f["p_size"]])

    found = read(spark, d, "part").select("p_size").distinct().mapInPandas(check, "p_size int, errors int")
    return read(spark, d, "part").join(found, "p_size").select("p_partkey", "errors")


@query("SELECT 'same rows' AS case_, count(*) AS n, true AS equal FROM orders UNION ALL SELECT 'each twice', 2 * count(*), false FROM orders UNION ALL SELECT 'one changed', count(*), false FROM orders")
def agg_layer_hash(spark, d):
    """Digests of a table dealt otherwise, doubled, and with one value changed, against its own."""
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    own = stats.digest(o, "o_orderkey", "o_totalprice").select(F.col("digest").alias("own"))
    least = o.agg(F.min("o_orderkey").alias("k"))
    cases = {"same rows": o.repartition(7, "o_totalprice"), "each twice": o.union(o), "one changed": o.join(F.broadcast(least)).select("o_orderkey", F.when(F.col("o_orderkey") == F.col("k"), -1.0).otherwise(F.col("o_totalprice")).alias("o_totalprice"))}
    out = None
    for name, df in cases.items():
        one = stats.digest(df, "o_orderkey", "o_totalprice").join(own).select(F.lit(name).alias("case_"), "n", (F.col("digest") == F.col("own")).alias("equal"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def flt_polygon_mask(spark, d):
    """An octant-shaped polygon: the equator between two meridians, and up to the pole. Tests hold it against brute force."""
    p = places(spark, d)
    return p.select("place", filters.in_polygon(p, [(-60.0, 0.0), (0.0, 0.0), (60.0, 0.0), (0.0, 90.0)]).alias("inside"))
