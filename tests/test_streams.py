"""Streams in several micro-batches, out of order and with late rows, against what the rows give at once."""

import datetime
import os
import random

import pyarrow.parquet as pq
import pytest

from sphaera.streaming import live
from sphaera.streaming.news import drain

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def us(seconds):
    return int(START.timestamp()) * 1_000_000 + seconds * 1_000_000


@pytest.fixture
def streamed(spark, tmp_path):
    """Lists of rows as a stream of as many micro-batches."""

    def make(batches, schema):
        folder = tmp_path / f"s{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        for i, rows in enumerate(batches):
            path = str(folder / f"{i:03}.parquet")
            pq.write_table(spark.createDataFrame(rows, schema).toArrow(), path)
            os.utime(path, (1_000_000 + i, 1_000_000 + i))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


ROWS = "scene long, entry long, viewer string, text string, seq long, edit boolean"


def test_edits_reach_feeds_in_any_order(spark, streamed):
    rng = random.Random(3)
    own = [(s, e, v, f"said {s} {e}", None, False) for s in (1, 2) for e in range(8) for v in "abc"]
    pens = [(s, e, None, f"edit {n}", n, True) for s in (1, 2) for e in range(5) for n in rng.sample(range(20), 3)]
    odd = [(1, 0, None, None, 99, True), (1, 0, None, "no number", None, True), (None, 1, "a", "x", None, False), (1, 6, None, "b", 5, True), (1, 6, None, "a", 5, True), (1, 7, "d", None, None, False), (3, 1, None, "of no one", 1, True)]
    rows = own + pens + odd
    rng.shuffle(rows)
    s = streamed([rows[i::5] for i in range(5)], ROWS)
    put = drain(live.corrections(s.where("NOT edit").select("scene", "entry", "viewer", "text"), s.where("edit").select("scene", "entry", "text", "seq")))
    got = {(r.scene, r.entry, r.viewer): r.text for r in live.shown(put).collect()}
    last = {}
    for scene, e, _, text, n, edit in rows:
        if edit and text is not None and n is not None:
            last[scene, e] = max(last.get((scene, e), (-1, "")), (n, text))
    assert got == {(s, e, v): last[s, e][1] if (s, e) in last else t for s, e, v, t, _, edit in rows if not edit and s is not None}
    assert put.count() > len(got)  # some were shown before the edit came


def states_at_once(rows, idle, passed):
    out = []
    for task in {r[0] for r in rows}:
        now = last = None
        for t, kind in sorted((r[1], r[2]) for r in rows if r[0] == task and r[1] <= passed):
            if now == "running" and t - last > idle:
                out.append((task, last + idle, "idle"))
                now = "idle"
            if kind in ("done", "error"):
                out.append((task, t, kind))
                now = kind
                break
            if now != "running":
                out.append((task, t, "running"))
                now = "running"
            last = t
        if now == "running" and last + idle <= passed:
            out.append((task, last + idle, "idle"))
    return sorted(out)


def test_tasks_turn_idle_wake_and_end(spark, streamed):
    rng = random.Random(8)
    rows = [(rng.randint(1, 6), t, "progress") for t in rng.sample(range(0, 3000), 120)] + [(1, 1500, "done"), (2, 900, "error"), (7, 2999, "progress")]
    rows.sort(key=lambda r: r[1] + rng.randint(0, 40))  # up to 40 s out of order, 60 are allowed
    batches = [[(k, at(t), kind) for k, t, kind in rows[i : i + 25]] for i in range(0, len(rows), 25)]
    late = [(3, at(5), "done"), (None, at(2999), "progress"), (4, None, "done"), (4, at(2999), None)]
    s = streamed([*batches, late], "task long, at timestamp, type string")
    got = sorted((r.task, r.us, r.state) for r in drain(live.task_states(s, 120.0, "60 seconds")).collect())
    want = states_at_once(rows, 120, 2999 - 60)
    assert got == [(k, us(t), x) for k, t, x in want]
    assert {x for _, _, x in want} == {"running", "idle", "done", "error"}
    assert drain(live.task_states(streamed([[(1, at(0), "progress")]], "task long, at timestamp, type string").where("task > 1"))).count() == 0


def test_passages_close_and_late_samples_are_dropped(spark, streamed):
    first = [(1, at(0), 3.0), (1, at(50), 1.0), (2, at(10), 2.0), (1, at(90), 1.0)]
    second = [(1, at(400), 5.0), (2, at(60), 0.5), (3, at(5000), 1.0)]
    third = [(3, at(5010), 0.5)]
    fourth = [(2, at(100), 0.1), (1, at(9000), 9.0)]  # the first of these comes after its passage has closed
    s = streamed([first, second, third, fourth], "pair long, at timestamp, apart double")
    got = sorted((r.pair, r.a, r.b, r.n, r.least, r.c) for r in drain(live.passages(s, "100 seconds", "60 seconds")).selectExpr("pair", "unix_micros(first) AS a", "unix_micros(last) AS b", "n", "least", "unix_micros(closest) AS c").collect())
    assert got == [(1, us(0), us(90), 3, 1.0, us(50)), (1, us(400), us(400), 1, 5.0, us(400)), (2, us(10), us(60), 2, 0.5, us(60)), (3, us(5000), us(5010), 2, 0.5, us(5010))]


def test_time_goes_on_by_far_samples_too(spark, streamed):
    rows = [(1, at(0), 3.0), (1, at(50), 1.0), (9, at(5000), 90.0)]  # the last one is far apart, and closes the passage
    got = drain(live.passages(streamed([rows], "pair long, at timestamp, apart double"), "100 seconds", "60 seconds", "apart < 20")).collect()
    assert [(r.pair, r.n, r.least) for r in got] == [(1, 2, 1.0)]


def test_passages_of_events_equal_sql_where_the_last_events_are_far(spark, tmp_path):
    import duckdb

    from sphaera import world_queries

    c = duckdb.connect()
    c.execute("CREATE TABLE events AS SELECT * FROM (VALUES (1, TIMESTAMP '2024-05-01 00:00:00', 7, 'view', 5.0::DOUBLE), (2, TIMESTAMP '2024-05-01 01:00:00', 7, 'view', 4.0), (3, TIMESTAMP '2024-05-03 00:00:00', 8, 'view', 50.0)) v(event_id, ts, user_id, event_type, value)")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = c.execute(world_queries.ORACLES["ss_conjunctions"]).fetchall()
    got = world_queries.ss_conjunctions(spark, str(tmp_path)).select("pair", "first", "last", "n", "least", "closest").collect()
    assert len(want) == 1 and [tuple(r) for r in got] == want


def test_entries_of_a_scene_share_one_state():
    import pandas as pd

    class State:
        exists = False

        def update(self, value):
            self.get, self.exists = value, True

    state, columns = State(), ["entry", "viewer", "text", "seq", "edit"]
    call = lambda *r: [tuple(x) for d in live._correct((5, 0), iter([pd.DataFrame(r, columns=columns)]), state) for x in d[["scene", "entry", "viewer", "text"]].itertuples(index=False)]
    assert sorted(call((1, "a", "one", None, False), (2, "a", "two", None, False), (2, "b", "two", None, False))) == [(5, 1, "a", "one"), (5, 2, "a", "two"), (5, 2, "b", "two")]
    assert sorted(call((2, None, "new", 3, True))) == [(5, 2, "a", "new"), (5, 2, "b", "new")]
    assert call((2, None, "old", 2, True)) == []


def test_last_half_millisecond_of_an_hour_counts_to_the_next_as_in_sql(spark, tmp_path):
    import duckdb

    from sphaera import world_queries

    c = duckdb.connect()
    times = ("00:59:59.999499", "00:59:59.999500", "00:59:59.999999", "01:00:00", "01:59:59.9997", "02:59:59.9994", "03:09:59.9999", "04:10:00")
    for last in ("04:59:59", "05:10:00", "05:09:59.9995"):  # hours end that the watermark has passed, to the microsecond
        rows = ", ".join(f"({i}, TIMESTAMP '2024-05-01 {t}', 7, {'NULL' if i == 3 else repr('view')}, 5.0::DOUBLE)" for i, t in enumerate((*times, last)))
        c.execute(f"CREATE OR REPLACE TABLE events AS SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value)")
        folder = tmp_path / last.replace(":", "-")
        folder.mkdir()
        c.execute(f"COPY events TO '{folder}/events.parquet'")
        want = c.execute(world_queries.ORACLES["ss_windows"]).fetchall()
        got = world_queries.ss_windows(spark, str(folder)).select("hour", "event_type", "n")
        assert got.schema["hour"].dataType.simpleString() == "bigint"
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
