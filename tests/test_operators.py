"""Properties of grids and operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sphaera.functions import calendar, geo
from sphaera.operators import fields, filters, graph, store, temporal
from sphaera.plans.nodes import run_graph
from sphaera.sources import grid


@pytest.mark.parametrize("f", [1, 2, 5])
def test_grid(spark, f):
    cells = grid.cells(spark, f).toPandas().sort_values("cell")
    pairs = {(r.src, r.dst) for r in grid.adjacency(spark, f).collect()}
    assert list(cells["cell"]) == list(range(10 * f * f + 2)) and cells["pentagon"].sum() == 12
    assert ((cells[["x", "y", "z"]] ** 2).sum(axis=1) - 1).abs().max() < 1e-12
    assert len(pairs) == 60 * f * f and all((b, a) in pairs for a, b in pairs)
    assert abs(grid.areas(spark, f).agg(F.sum("area_sr")).first()[0] - 4 * math.pi) < 1e-9


def test_nearest_cell_equals_brute_force(spark):
    cells = grid.cells(spark, 4).select("cell", "x", "y", "z")
    points = grid.fibonacci_sphere(spark, 300).toDF("id", "px", "py", "pz")
    got = {r["id"]: r["cell"] for r in fields.nearest_cell(points, "id", cells, 4).collect()}
    c, p = cells.toPandas(), points.toPandas()
    dots = p[["px", "py", "pz"]].to_numpy() @ c[["x", "y", "z"]].to_numpy().T
    assert all(abs(dots[i, list(c["cell"]).index(got[k])] - dots[i].max()) < 1e-12 for i, k in enumerate(p["id"]))


def test_fields_of_other_frequency_do_not_join(spark):
    df = spark.range(3).selectExpr("id AS cell", "1.0D AS v")
    with pytest.raises(ValueError, match="frequency"):
        fields.math("add", fields.Field(df, 4), fields.Field(df, 8))
    with pytest.raises(ValueError, match="unknown operation"):
        fields.math("pow", fields.Field(df, 4), fields.Field(df, 4))


def test_graph_spec_errors(spark):
    node = {"type": "mask", "inputs": {"a": "b"}, "params": {"threshold": 0.0}}
    with pytest.raises(ValueError, match="cycle"):
        run_graph({"a": node, "b": {**node, "inputs": {"a": "a"}}}, {})
    with pytest.raises(ValueError, match="unknown type"):
        run_graph({"a": {"type": "melt"}}, {})


def test_validate_finds_every_error():
    bad = {"hard": [{"field": "q", "op": "between", "value": [1]}], "soft": [{"field": "a", "fn": "gauss"}, {"field": "a", "fn": "cube"}]}
    assert len(filters.validate(bad, ["a"])) == 4


def test_components_of_a_chain_and_without_edges(spark):
    nodes = spark.range(40).withColumnRenamed("id", "node")
    chain = spark.range(19).selectExpr("id AS src", "id + 1 AS dst")
    got = {r.node: r.component for r in graph.components(nodes, chain).collect()}
    assert got == {i: 0 if i < 20 else i for i in range(40)}
    assert graph.components(nodes, chain.limit(0)).where("node = component").count() == 40


def test_shortest_takes_ties_to_the_smaller_node_and_stops_at_its_limit(spark):
    e = spark.createDataFrame([(0, 2, 1), (0, 1, 1), (1, 3, 1), (2, 3, 1), (3, 4, 5)], "src long, dst long, w long")
    s = spark.createDataFrame([(9, 0)], "source long, node long")
    assert {(r.node, r.dist, r.prev) for r in graph.shortest(e, s, 4).collect()} == {(0, 0, None), (1, 1, 0), (2, 1, 0), (3, 2, 1)}


def test_spanning_tree_equals_kruskal(spark):
    import random

    rng = random.Random(4)
    edges = {(a, b): rng.randint(1, 9) for a, b in ((rng.randrange(12), rng.randrange(12, 25)) for _ in range(60))} | {(30, 31): 2}
    root, want = list(range(32)), set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    got = graph.spanning_tree(spark.createDataFrame([(b, a, w) for (a, b), w in edges.items()], "a long, b long, w long"))
    assert {tuple(r) for r in got.collect()} == want


def test_atlas_is_a_bijection_and_mesh_closes(spark):
    from sphaera.operators import exports

    for f in (1, 3):
        a = exports.atlas(grid.placed(spark, f), f)
        assert a.count() == a.select("block", "i", "j").distinct().count() == 10 * f * f and a.where(f"i < 0 OR j < 0 OR i >= {f} OR j >= {f}").count() == 0
    t = [tuple(r) for r in exports.mesh(grid.adjacency(spark, 3)).collect()]
    sides = [frozenset(p) for a, b, c in t for p in ((a, b), (b, c), (c, a))]
    assert len(t) == 180 and all(sides.count(s) == 2 for s in set(sides))


def test_resolution_order(spark):
    r = [("e", "a", "gen", "gen", None, None, 9), ("e", "a", "user", "user", None, None, 1), ("e", "a", "old", "user", 5.0, 8.0, 2), ("e", "a", "new", "user", 6.0, None, 1)]
    t = spark.createDataFrame(r, "entity string, attr string, value string, source string, valid_from double, valid_to double, rev long")
    at = lambda day: temporal.resolve(t, F.lit(day)).first().value
    assert (at(5.0), at(7.0), at(9.0), at(1.0)) == ("old", "new", "new", "user")


def test_generation_merge_table(spark):
    e = [("kept", "k", "name", "x", "gen", 1), ("gone", "k", "name", "x", "gen", 1), ("mine", "k", "name", "x", "user", 1), ("bolt", "k", "name", "x", "gen", 1), ("back", "k", "name", "x", "gen", 1), ("back", "k", "_retired", "true", "gen", 2), ("else", "q", "name", "x", "gen", 1)]
    entries = spark.createDataFrame(e, "entity string, kind string, attr string, value string, source string, rev long").withColumns({"valid_from": F.lit(None).cast("double"), "valid_to": F.lit(None).cast("double")})
    locks = spark.createDataFrame([("bolt", "*", True, 1), ("kept", "pop", True, 1), ("kept", "name", True, 1), ("kept", "name", False, 2)], "entity string, attr string, locked boolean, rev long")
    batch = spark.createDataFrame([("kept", "k", "name", "y"), ("kept", "k", "pop", "5"), ("back", "k", "name", "y"), ("born", "k", "name", "y")], "entity string, kind string, attr string, value string")
    got = {(r.entity, r.attr, r.action) for r in store.apply_generation(entries, locks, batch, 7).collect()}
    assert got == {("kept", "name", "updated"), ("back", "name", "updated"), ("back", "_retired", "returned"), ("born", "name", "created"), ("gone", "_retired", "retired")}


def test_calendar_round_trip(spark):
    months = [("a", 3), ("b", 4)]
    d = spark.range(-20, 20).select("id", calendar.to_date(F.col("id"), months).alias("t")).select("id", calendar.to_day(F.col("t.year"), F.col("t.month"), F.col("t.day"), months).alias("back"))
    assert d.where("id != back").count() == 0


def test_bearings(spark):
    names = [spark.range(1).select(geo.wind(geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(x), F.lit(y)))).first()[0] for x, y in ((0.0, 1.0), (1.0, 0.0), (0.0, -1.0), (-1.0, 1.0))]
    assert names == ["N", "E", "S", "NW"]


def test_stream_of_news_equals_batch(spark, tmp_path):
    from sphaera.streaming.news import deliver_once

    rows = [(1, 10, 5, 0), (1, 11, 9, 6), (2, 12, 3, 2), (1, 13, 1, 9), (2, 14, 8, 2)]
    spark.createDataFrame(rows, "seat long, item long, arrives_day long, clock long").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = deliver_once(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, lambda r: r)
    assert sorted((r.seat, r.item) for r in got.collect()) == [(1, 10), (1, 11), (1, 13)]


def test_triangles_around_points_by_the_way_back(spark):
    """Points made from known weights on cells of a face are located there again."""
    import numpy as np

    rng, f = np.random.default_rng(1), 7
    at, faces = np.array(grid._corners()), [x for x, _ in fields._faces()]
    assert len(faces) == 20
    cell = {tuple((o.corner, o.weight) for o in r.on): r.cell for r in grid.placed(spark, f).collect()}
    points, want = [], {}
    for i in range(60):
        face = faces[int(rng.integers(20))]
        w = rng.dirichlet((1, 1, 1))
        b = [x + grid.WARP_ALPHA * x * (1 - x) * (0.5 - x) + grid.WARP_BETA * w.prod() for x in w]
        p = sum(x * at[c] for x, c in zip(b, face))
        points.append((i, *(float(x) for x in p / np.linalg.norm(p))))
        low, rest = np.floor(w * f).astype(int), w * f - np.floor(w * f)
        up = round(rest.sum()) == 1
        want[i] = {}
        for k in range(3):
            n = [int(x) + ((j == k) if up else (j != k)) for j, x in enumerate(low)]
            want[i][cell[tuple(sorted((c, x) for c, x in zip(face, n) if x))]] = rest[k] if up else 1 - rest[k]
    got = {}
    for r in fields.locate(spark.createDataFrame(points, "id long, px double, py double, pz double"), "id", f).collect():
        got.setdefault(r.id, {})[r["at"]] = r.weight
    for i, w in want.items():
        assert got[i].keys() == w.keys() and all(abs(got[i][c] - w[c]) < 1e-7 for c in w)


def test_resampling_keeps_constants_and_cells(spark):
    flat = fields.Field(grid.lattice(spark, 4).selectExpr("cell", "7.5D AS v"), 4)
    assert fields.resample(flat, 8).df.where("abs(v - 7.5) > 1e-9").count() == 0 and fields.resample(flat, 8).df.count() == 642
    own = fields.Field(grid.lattice(spark, 4).selectExpr("cell", "CAST(cell % 17 AS DOUBLE) AS v"), 4)
    assert fields.resample(own, 4).df.join(own.df.withColumnRenamed("v", "was"), "cell").where("abs(v - was) > 1e-6").count() == 0
    assert fields.rasterize(flat, 12, 6).where("abs(v - 7.5) < 1e-9").count() == 72


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_frontiers_in_blocks_equal_bellman_ford(spark, block):
    import random

    rng = random.Random(2)
    e = list({(rng.randrange(40), rng.randrange(40)): rng.randint(1, 9) for _ in range(120)}.items())
    df = spark.createDataFrame([(a, b, w) for (a, b), w in e], "src long, dst long, w long")
    z = {n: n * 37 % 23 for n in range(40)}

    def settle(start, cost):
        best = dict(start)
        for _ in range(60):
            for (a, b), w in e:
                if a in best and (b not in best or cost(best[a], a, b, w) < best[b]):
                    best[b] = cost(best[a], a, b, w)
        return best

    reached = graph.shortest(df, spark.createDataFrame([(0, 0), (5, 5)], "source long, node long"), block=block)
    got = {(r.source, r.node): (r.dist, r.prev) for r in reached.collect()}
    for s in (0, 5):
        want = settle({s: 0}, lambda d, a, b, w: d + w)
        assert {n: d for (x, n), (d, _) in got.items() if x == s} == want
        for n, d in want.items():
            before = [a for (a, b), w in e if b == n and a in want and want[a] + w == d]
            assert got[s, n][1] == (None if n == s else min(before))
    near = {r.node: (r.dist, r.source) for r in graph.territories(df, spark.createDataFrame([(0, 0), (5, 5)], "source long, node long"), block=block).collect()}
    assert near == settle({0: (0, 0), 5: (0, 5)}, lambda x, a, b, w: (x[0] + w, x[1]))
    nodes = spark.createDataFrame(list(z.items()), "node long, z long")
    filled = graph.flood(nodes, df.select("src", "dst"), spark.createDataFrame([(0,)], "node long"), block=block)
    assert {r.node: r.fill for r in filled.collect()} == settle({0: z[0]}, lambda x, a, b, w: max(x, z[b]))
    goals = spark.createDataFrame([(0, n) for (s, n) in got if s == 0], "source long, node long")
    for r in graph.path(reached, goals, block).groupBy("goal").agg(F.sort_array(F.collect_list(F.struct("back", "node"))).alias("p")).collect():
        nodes_ = [x.node for x in r.p]
        assert nodes_[0] == r.goal and nodes_[-1] == 0 and all(got[0, a][1] == b for a, b in zip(nodes_, nodes_[1:]))


def test_spanning_tree_in_many_chunks(spark, monkeypatch):
    import random

    monkeypatch.setattr(graph, "CHUNK", 8)
    rng = random.Random(7)
    edges = {(a, b): rng.randint(1, 30) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(150)) if a < b}
    root, want = list(range(30)), set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    got = graph.spanning_tree(spark.createDataFrame([(b, a, w) for (a, b), w in edges.items()], "a long, b long, w long"))
    assert {tuple(r) for r in got.collect()} == want


def test_atlas_comes_back_and_neighbours_are_near(spark):
    from sphaera.operators import exports

    for f in (2, 5):
        p = grid.placed(spark, f)
        a = {r.cell: (r.block, r.i, r.j) for r in exports.atlas(p, f).collect()}
        near = {}
        for r in grid.adjacency(spark, f).collect():
            near.setdefault(r.src, set()).add(r.dst)
        cell = {v: k for k, v in a.items()}
        for c, (b, i, j) in a.items():
            for di, dj in ((1, 0), (0, 1), (1, -1)):
                if (b, i + di, j + dj) in cell:
                    assert cell[b, i + di, j + dj] in near[c]
        px = spark.createDataFrame([(b, i, j, float(c)) for c, (b, i, j) in a.items()], "block long, i long, j long, v double")
        assert exports.from_atlas(px, p, f).where("cell != v").count() == 0


def test_meanders_keep_ends_and_order(spark):
    from sphaera.operators import rivers

    rows = [(1, k, math.cos(0.01 * k), math.sin(0.01 * k), 0.0, 100.0) for k in range(6)]
    out = rivers.meander(spark.createDataFrame(rows, "river long, ord long, x double, y double, z double, width_m double"), 20.0, 3).orderBy("ord").collect()
    first, last = out[0], out[-1]
    assert abs(first.x - rows[0][2]) < 1e-12 and abs(last.y - rows[-1][3]) < 1e-12 and len(out) > 40
    assert [r.ord for r in out] == list(range(len(out))) and all(abs(r.x**2 + r.y**2 + r.z**2 - 1) < 1e-12 for r in out)
    off = [abs(r.z) * 6371 for r in out]
    assert 0 < max(off) <= 3 * 0.12 * 2.0 + 1e-6 and off[0] == off[-1] == 0


def test_steepest_descent_on_planes(spark):
    from sphaera.operators import rivers

    for deg in (0, 20, 45, 80, 135, 200, 300, 350):
        c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
        px = spark.range(81).selectExpr("CAST(id / 9 AS BIGINT) AS y", "id % 9 AS x").selectExpr("y", "x", f"100 - (x * {c!r}D - y * {s!r}D) AS z")
        r = rivers.downhill_two(px, 9, 9, F.lit(1.0), 1.0).where("x = 4 AND y = 4").first()
        assert abs((math.degrees(r.angle) - deg + 180) % 360 - 180) < 1e-6 and abs(r.w0 + r.w1 - 1) < 1e-12
        assert r.a0 == int((deg + 1e-9) // 45) % 8 or r.w0 < 1e-6 or r.w1 > 1 - 1e-6


def lines_of(segments):
    """Lines by walking, as a set of corner tuples."""
    near = {}
    for p, q in segments:
        if p is not None and q is not None and p != q:
            near.setdefault(p, set()).add(q)
            near.setdefault(q, set()).add(p)
    out, used = set(), set()
    for ends in (True, False):
        for p in sorted(near):
            for q in sorted(near[p]):
                if (len(near[p]) != 2) != ends or frozenset((p, q)) in used:
                    continue
                line = [p, q]
                while len(near[line[-1]]) == 2 and line[-1] != p:
                    line.append(next(x for x in near[line[-1]] if x != line[-2]))
                used |= {frozenset(x) for x in zip(line, line[1:])}
                out.add(min(tuple(line), tuple(line[::-1])))
    return out


RING = [(0, 0), (1, 0), (2, 1), (1, 2), (0, 2), (-1, 1)]
CASES = {
    "ring": list(zip(RING, RING[1:] + RING[:1])),
    "fork": [((0, i), (0, i + 1)) for i in range(4)] + [((0, 0), (i + 1, -i)) for i in range(1)] + [((1, 0), (2, 0)), ((0, 0), (-1, 0)), ((-1, 0), (-2, -1))],
    "eight": [((0, 0), (1, 1)), ((1, 1), (1, -1)), ((1, -1), (0, 0)), ((0, 0), (-1, 1)), ((-1, 1), (-1, -1)), ((-1, -1), (0, 0))],
    "one": [((5, 5), (6, 5))],
    "long": [((0, i), (0, i + 1)) for i in range(150)],
    "two rings and a line": [((i, j), (i, (j + 1) % n)) for i, n in ((1, 3), (2, 64)) for j in range(n)] + [((9, j), (9, j + 1)) for j in range(7)],
}


@pytest.mark.parametrize("case", CASES)
def test_border_lines(spark, case):
    from sphaera.operators import borders

    rng = random.Random(case)
    s = [tuple(rng.sample(x, 2)) for x in CASES[case] + CASES[case][:2]] + [((3, 3), (3, 3)), (None, (3, 3))]
    corner = "struct<lon:long,lat:long>"
    got = [tuple(map(tuple, r["at"])) for r in borders.polylines(spark.createDataFrame(s, f"p {corner}, q {corner}")).collect()]
    assert len(got) == len(set(got)) and set(got) == lines_of(s)


def test_border_lines_of_the_world(spark):
    from sphaera import world_queries as w
    from sphaera.operators import borders

    s = borders.segments(w._regions(spark), w._near(spark), grid.cells(spark, w.FREQ).select("cell", "x", "y", "z")).select("p", "q")
    got = [tuple(map(tuple, r["at"])) for r in borders.polylines(s).collect()]
    assert set(got) == lines_of([(tuple(r.p), tuple(r.q)) for r in s.collect()]) and len(got) == len(set(got))


def test_news_take_the_first_scene_not_before_them(spark):
    from sphaera.operators import ledger

    rng = random.Random(4)
    news = [(i, rng.choice(["a", "b", None]), rng.randint(0, 30)) for i in range(300)]
    scenes = [(i, rng.choice(["a", "b"]), i * 7 % 41, rng.randint(0, 28)) for i in range(41)]
    got = ledger.news_scene(spark.createDataFrame(news, "item long, seat string, arrives_day long"), spark.createDataFrame(scenes, "scene long, seat string, ord long, day long"))
    want = []
    for i, seat, day in news:
        later = [(o, s) for s, t, o, d in scenes if t == seat and d >= day]
        want += [(i, seat, min(later)[1])] if later else []
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_polygon_by_brute_force(spark):
    import numpy as np

    ring_ = [(-60.0, 0.0), (0.0, 0.0), (60.0, 0.0), (0.0, 90.0)]
    pts = grid.fibonacci_sphere(spark, 600).selectExpr("id", "degrees(atan2(z, x)) AS lon", "degrees(asin(y)) AS lat")
    got = {r.id: (r.lon, r.lat, r.inside) for r in pts.select("*", filters.in_polygon(pts, ring_).alias("inside")).collect()}
    v = np.array([filters._unit_vector(*p) for p in ring_])
    for lon, lat, inside in got.values():
        p = np.array(filters._unit_vector(lon, lat))
        sides = [p @ np.cross(a, b) for a, b in zip(v, np.roll(v, -1, axis=0))]
        if min(map(abs, sides)) > 1e-9:  # a convex outline: within it if on one side of all its edges
            assert inside == (all(x > 0 for x in sides) or all(x < 0 for x in sides)) or inside == all(x < 0 for x in sides)


def test_greedy_choice_by_brute_force(spark):
    import random

    from sphaera.operators import ranking

    rng = random.Random(3)
    rows = [(i, rng.uniform(-180, 180), rng.uniform(-80, 80), rng.randint(0, 40)) for i in range(300)] + [(300 + i, 0.01 * i, 0.0, 50) for i in range(60)]
    df = spark.createDataFrame(rows, "place long, lon double, lat double, score long")
    v = {r[0]: filters._unit_vector(r[1], r[2]) for r in rows}
    for most in (5, 25, 400):
        taken = []
        for i, _, _, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
            if len(taken) < most and all(sum(a * b for a, b in zip(v[i], v[j])) < math.cos(math.radians(12)) for j in taken):
                taken.append(i)
        assert {r.place for r in ranking.spaced(df, "score", "place", 12.0, most).collect()} == set(taken)


def test_notes_of_a_route(spark):
    from sphaera.operators import places

    rows = [(0, 9, 5 - k, run, b, h, r, p, was) for k, (run, b, h, r, p, was) in enumerate([(1, 5, 10.0, False, "A", None), (1, 5, 2500.0, True, "A", "A"), (1, 5, 9.0, False, "B", "A"), (2, 8, 9.0, False, None, "B"), (2, 8, 9.0, True, "B", None), (3, 4, 9.0, False, "C", "B")])]
    df = spark.createDataFrame(rows, "source long, goal long, back long, run long, biome int, height double, river boolean, polity string, was string")
    assert places.notes(df, "horse").first().notes == ["through grassland (3 leagues)", "crosses a high pass at 2500 m", "fords or bridges 2 river reaches", "enters B", "enters C"]
    assert places.notes(df, "ship").first().notes == ["a sea voyage of 6 legs"]


def flows_by_hand(values, edges):
    """Totals by taking nodes in an order in which all that flows in comes first."""
    above = {}
    for u, v, _ in edges:
        above.setdefault(v, set()).add(u)
    total, left = dict(values), set(values) | {n for e in edges for n in e[:2]}
    total = {n: total.get(n, 0.0) for n in left}
    while left:
        ready = {n for n in left if not above.get(n, set()) & left}
        for n in ready:
            for u, v, share in edges:
                if u == n:
                    total[v] += total[n] * share
        left -= ready
    return total


def test_shared_flows_cross_blocks(spark):
    rnd = random.Random(5)
    nodes = [(i, float(i % 5)) for i in range(60)]
    edges = [(i, j, rnd.choice([0.25, 0.5])) for i in range(60) for j in rnd.sample(range(60), 2) if i * 37 % 61 < j * 37 % 61]
    edges += edges[:3]
    want = flows_by_hand(dict(nodes), edges)
    for block in (7, 1 << 14):
        got = graph.accumulate_shared(spark.createDataFrame(nodes, "node long, v double"), spark.createDataFrame(edges, "src long, dst long, share double"), "v", block)
        assert {r.node: round(r.total, 9) for r in got.collect()} == {n: round(x, 9) for n, x in want.items()}


def test_shared_flows_go_on_through_many_blocks(spark):
    n = 40
    e = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst", "1.0D AS share")
    got = graph.accumulate_shared(spark.range(n).selectExpr("id AS node", "1 AS v"), e, "v", 2)
    assert {r.node: r.total for r in got.collect()} == {i: i + 1.0 for i in range(n)}


def test_shared_flows_of_odd_rows(spark):
    nodes = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None), (None, 7.0)], "node long, v double")
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.5), (2, 9, None), (None, 2, 1.0), (3, 2, 1.0)], "src long, dst long, share double")
    got = graph.accumulate_shared(nodes, edges, "v")
    assert {r.node: r.total for r in got.collect()} == {1: 5.0, 2: 2.5, 3: 0.0}
    assert graph.accumulate_shared(nodes.limit(0), edges.limit(0), "v").count() == 0
    with pytest.raises(ValueError, match="cycle"):
        graph.accumulate_shared(nodes, spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5)], "src long, dst long, share double"), "v")


def test_tiles_are_squares_and_flows_cross_few(spark, monkeypatch):
    """A block is as high as it is wide, however wide the raster is: a way down 40 rows crosses 5 tiles of 8 x 8 pixels, but 40 rows that are cut in parts."""
    from sphaera.operators import rivers

    w, h = 80, 40
    tile = spark.range(w * h).select(F.col("id"), graph.tiles(w, 64)(F.col("id")).alias("t"))
    at = tile.groupBy("t").agg(F.count("*").alias("n"), F.countDistinct(F.floor(F.col("id") / w)).alias("y"), F.countDistinct(F.col("id") % w).alias("x")).collect()
    assert len(at) == 50 and all((r.n, r.y, r.x) == (64, 8, 8) for r in at)
    assert {r.t for r in spark.range(7 * 5).select(graph.tiles(7, 9)(F.col("id")).alias("t")).collect()} == set(range(6))
    made, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="step": made.append(name) or cut(df, name))
    px = spark.range(w * h).selectExpr(f"CAST(floor(id / {w}) AS BIGINT) AS y", f"id % {w} AS x", "id AS node").selectExpr("*", "5000.0D - 50 * y + x % 2 AS z")
    got = rivers.drainage(px, w, h, F.lit(1.0), 1.0, px.where(f"y = {h - 1}").select("node"), 64)
    assert got.count() == w * h and abs(got.where(f"node >= {w * (h - 1)}").agg(F.sum("total")).first()[0] / (4 * math.pi * 6371000.0**2) - 1) < 1e-6
    assert made.count("peeled") < 12 and made.count("moved") < 16


def test_drainage_of_a_cone_and_over_a_pole(spark):
    from sphaera.operators import rivers

    w, h = 12, 6
    px = spark.range(w * h).selectExpr(f"CAST(floor(id / {w}) AS BIGINT) AS y", f"id % {w} AS x", "id AS node").selectExpr("*", "1000.0D + 50 * y AS z")
    out = px.where("y = 0 AND x = 3").select("node")
    got = {r.node: r for r in rivers.drainage(px, w, h, F.lit(1.0), 1.0, out).collect()}
    area = {r.node: r.a for r in px.select("node", rivers.pixel_area(F.col("y"), w, h).alias("a")).collect()}
    assert abs(sum(area.values()) - 4 * math.pi * 6371000**2) < 1e3
    # Rows fall to the north; the first row is level but for the outlet's way across the pole and along it.
    assert len(got) == w * h and all(got[n].total >= area[n] - 1e-6 for n in got)
    assert abs(got[3].total - sum(area.values())) < 1e-3 * area[3]
    assert abs(got[w * (h - 1) + 5].total - area[w * (h - 1) + 5]) < 1e-6
    small = {r.node: round(r.total) for r in rivers.drainage(px, w, h, F.lit(1.0), 1.0, out, 9).collect()}
    assert small == {n: round(r.total) for n, r in got.items()}


def test_tributaries_as_taken_one_by_one(spark):
    from sphaera.operators import rivers

    rng = random.Random(12)
    n = 300
    rec = {i: rng.randint(max(0, i - 12), i - 1) if i and rng.random() > 0.01 else None for i in range(n)}
    accum = dict.fromkeys(range(n), 1.0)
    for i in reversed(range(n)):
        if rec[i] is not None:
            accum[rec[i]] += accum[i]
    accum = {i: x * rng.choice([0.2, 0.5, 1.0, 2.0]) for i, x in accum.items()}  # where drained areas only grow downwards, last cells are the greatest
    ocean = {i: i in (4, 40) for i in range(n)}
    for threshold, most in ((20.0, None), (20.0, 3), (60.0, 400)):
        is_channel = {i: accum[i] > threshold and not ocean[i] for i in range(n)}
        taken, want = set(), []
        for start in sorted((i for i in range(n) if threshold / 8 < accum[i] <= threshold and not ocean[i]), key=lambda i: (-accum[i], i)):
            way = [start]
            while way[-1] not in taken and not is_channel[way[-1]] and rec[way[-1]] is not None and not ocean[rec[way[-1]]]:
                way.append(rec[way[-1]])
            if is_channel[way[-1]] and len(way) >= 3:
                want.append((start, len(way), accum[start]))
            taken |= set(way)
        cells = spark.createDataFrame([(i, accum[i], ocean[i]) for i in range(n)], "node long, accum double, ocean boolean")
        got = rivers.tributaries(cells, spark.createDataFrame(list(rec.items()), "node long, receiver long"), threshold, most=most).collect()
        assert sorted(map(tuple, got)) == sorted(want[:most]) and want


def test_hearths_of_odd_groups(spark):
    from sphaera.operators import ranking

    far = [(i, "big", 5, *v) for i, v in enumerate([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)] * 6)]
    near = [(100 + i, "crowd", i, 1.0, 0.0, 0.0) for i in range(40)]
    odd = [(200, "one", 1, 0.0, 0.0, 1.0), (201, None, 9, 0.0, 0.0, 1.0), (202, "one", None, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(far + near + odd, "place long, kind string, n long, px double, py double, pz double")
    got = sorted(map(tuple, ranking.hearths(df, "kind", "n", "place").collect()))
    assert got == [("big", 1, 0), ("big", 2, 1), ("big", 3, 2), ("crowd", 1, 139), ("one", 1, 200)]
    assert ranking.hearths(df.limit(0), "kind", "n", "place").count() == 0


def test_nearest_of_many_targets_meets_few_of_them(spark):
    from sphaera.operators import places as at

    targets = grid.fibonacci_sphere(spark, 20_000)
    points = grid.fibonacci_sphere(spark, 300).selectExpr("id AS place", "x AS px", "z AS py", "y AS pz")
    side = at.side_for(targets)
    assert at.within(points, "place", targets, side, True).count() < 300 * 20
    got = {r["place"]: (r["id"], round(r["chord2"], 9)) for r in at.nearest(points, "place", targets, side, many=True).collect()}
    t = [(r["id"], r["x"], r["y"], r["z"]) for r in targets.collect()]
    for p in points.collect()[::7]:
        d, i = min((round((p["px"] - x) ** 2 + (p["py"] - y) ** 2 + (p["pz"] - z) ** 2, 9), i) for i, x, y, z in t)
        assert got[p["place"]] == (i, d)
    far = targets.where("id >= 19990")  # all near one pole: the cubes are doubled for the points that find none
    assert at.nearest(points, "place", far, 0.05, many=True).count() == at.nearest(points, "place", far, 0.05).count() == 300
    assert at.nearest(points, "place", targets.limit(0), at.side_for(targets.limit(0)), many=True).count() == 0


def test_each_cell_is_looked_from_once(spark, monkeypatch):
    from sphaera.operators import places as at

    world = grid.cells(spark, 2).select("cell", "x", "y", "z").withColumn("height", (F.col("cell") * 977 % 4000).cast("double"))
    points = spark.createDataFrame([(i, 10 + i / 50, 20.0) for i in range(12)] + [(99, -120.0, -40.0)], "place long, lon double, lat double")
    made = {}
    monkeypatch.setattr(at, "cut", lambda df, name="step", cut=at.cut: made.setdefault(name, cut(df, name)) if name != "near" else cut(df, name))
    seen = {r["place"]: tuple(r)[1:] for r in at.viewsheds(points, world, 2, rays=4, far=100.0).collect()}
    stands = {r["place"]: r["stand"] for r in made["stands"].collect()}
    assert made["rays"].count() == len(set(stands.values())) * 4 * 12 < 13 * 4 * 12
    assert len(seen) == 13 and all(seen[a] == seen[b] for a in seen for b in seen if stands[a] == stands[b])


def test_points_without_a_coordinate_are_not_located(spark):
    points = spark.createDataFrame([(1, 0.0, 0.6, 0.8), (2, None, None, None), (3, 0.0, 0.0, 1.0)], "place long, px double, py double, pz double")
    got = fields.locate(points, "place", 4).groupBy("place").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).orderBy("place").collect()
    assert [(r["place"], round(r["w"], 9)) for r in got] == [(1, 1.0), (3, 1.0)] and got[1]["n"] == 1


def test_parts_of_meanders_are_sorted_once(spark):
    from sphaera.operators import rivers

    rows = [(r, i, 1.0, 0.1 * i, 0.05 * r, 30.0) for r in (1, 2) for i in range(5)]
    plan = rivers.meander(spark.createDataFrame(rows, "river long, ord long, x double, y double, z double, width_m double"), 40.0, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Generate")].count("Sort [") == 1


def test_copied_targets_of_many_points_are_not_broadcast(spark):
    """Spark takes 27 copies of a table for as small as the table: they would be gathered on the driver."""
    from sphaera.operators import places

    points = grid.fibonacci_sphere(spark, 400).toDF("key", "px", "py", "pz")
    towns = grid.fibonacci_sphere(spark, 90).toDF("id", "x", "y", "z").selectExpr("named_struct('town', id, 'name', concat('T', id)) AS id", "x", "y", "z")
    plan = places.within(points, "key", towns, 0.3, many=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = {r.key: r for r in places.nearest(points, "key", towns, 0.1, many=True).select("key", "id.*", "chord2").collect()}
    p, t = points.toPandas(), towns.select("id.town", "x", "y", "z").toPandas()
    far = ((p[["px", "py", "pz"]].to_numpy()[:, None] - t[["x", "y", "z"]].to_numpy()[None]) ** 2).sum(axis=2)
    assert len(got) == 400 and all(abs(far[i].min() - got[k].chord2) < 2e-9 and got[k].name == f"T{got[k].town}" for i, k in enumerate(p["key"]))
