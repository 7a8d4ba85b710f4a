"""Every query with SQL gives what DuckDB gives."""

import pytest
from conftest import rows

from sphaera import world_queries  # noqa: F401  registers its queries
from sphaera.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    assert rows(QUERIES[name](spark, data)) == rows(duck.execute(ORACLES[name]).fetchdf())


def test_spaced_places_keep_their_distance(spark, data):
    import math

    from sphaera.operators import ranking
    from sphaera.queries import places

    got = ranking.spaced(places(spark, data), "score", "place", 12.0, 40).collect()
    v = [(math.cos(math.radians(r.lat)) * math.cos(math.radians(r.lon)), math.sin(math.radians(r.lat)), math.cos(math.radians(r.lat)) * math.sin(math.radians(r.lon))) for r in got]
    assert 1 < len(got) <= 40
    assert all(sum(a * b for a, b in zip(p, q)) <= math.cos(math.radians(12)) + 1e-12 for i, p in enumerate(v) for q in v[:i])


def test_spaced_places_are_found_behind_a_hot_place(spark):
    from sphaera.operators import ranking

    hot = [(i, 0.001 * (i % 50), 0.001 * (i // 50), 1000 - i % 7) for i in range(400)]
    rest = [(1000 + i, 20.0 * i, -40.0, 10 - i) for i in range(8)]
    df = spark.createDataFrame(hot + rest + [(2000, None, 1.0, 5000)], "place long, lon double, lat double, score long")
    got = [r.place for r in ranking.spaced(df, "score", "place", 12.0, 5).orderBy("score", ascending=False).collect()]
    assert got == [0, 1000, 1001, 1002, 1003]
    assert ranking.spaced(df.limit(0), "score", "place", 12.0, 5).count() == 0
    assert ranking.spaced(df, "score", "place", 12.0, 20).count() == 9


@pytest.mark.parametrize("name", ["jn_nearest_cell", "q_describe"])
def test_places_between_two_cells_fall_to_the_greater(spark, tmp_path, name):
    """On the equator cells of both sides are equally near to the last bit. SQL leaves such ties open: on one thread it finds the greater cell."""
    import duckdb

    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"COPY (SELECT unnest([8500, 59500, 110500, 314500, 17])::BIGINT AS c_custkey, 1.0::DOUBLE AS c_acctbal) TO '{tmp_path}/customer.parquet'")
    c.execute(f"COPY (SELECT range AS s_suppkey FROM range(0, 40)) TO '{tmp_path}/supplier.parquet'")
    for t in ("customer", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path))) == rows(c.execute(ORACLES[name]).fetchdf())
