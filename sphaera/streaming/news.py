"""Structured Streaming: news that is delivered when it is due, feeds, and windows over events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

OUT = "seat long, item long, arrives_day long, delivered_day long"
STATE = "items array<bigint>, days array<bigint>, clock bigint"


def _deliver(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A seat's pending news and its clock; what has arrived by the clock leaves the state."""
    items, days, clock = (list(x) if not isinstance(x, int) else x for x in state.get) if state.exists else ([], [], -(1 << 62))
    for b in batches:
        fresh = b[b["item"].notna()]
        items += fresh["item"].astype("int64").tolist()
        days += fresh["arrives_day"].astype("int64").tolist()
        if b["clock"].notna().any():
            clock = max(clock, int(b["clock"].max()))
    due = sorted((d, i) for i, d in zip(items, days, strict=True) if d <= clock)
    rest = [(i, d) for i, d in zip(items, days, strict=True) if d > clock]
    state.update(([i for i, _ in rest], [d for _, d in rest], clock))
    yield pd.DataFrame({"seat": [key[0]] * len(due), "item": [i for _, i in due], "arrives_day": [d for d, _ in due], "delivered_day": [clock] * len(due)})


#: Parts that a seat's pending news are kept in, so that a busy seat is no one task's.
PARTS = 16


def deliveries(messages: DataFrame) -> DataFrame:
    """A stream of messages (seat, item, arrives_day, clock; either part may be null) -> what each seat learns, once, when its clock has come to it.

    State is kept per seat and part, holds only what is pending, and the clock of a message goes to all parts of its seat."""
    own = messages.where("item IS NOT NULL").select("seat", F.pmod(F.xxhash64("item"), F.lit(PARTS)).alias("part"), "item", "arrives_day", F.lit(None).cast("long").alias("clock"))
    ticks = messages.where("clock IS NOT NULL").select("seat", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"), F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("arrives_day"), F.col("clock").cast("long").alias("clock"))
    both = own.select("seat", "part", F.col("item").cast("long").alias("item"), F.col("arrives_day").cast("long").alias("arrives_day"), "clock").unionByName(ticks)
    return both.groupBy("seat", "part").applyInPandasWithState(_deliver, OUT, STATE, "append", "NoTimeout")


def _scene(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One ledger: whether a scene is open; rows in the order of seq."""
    open_ = bool(state.get[0]) if state.exists else False
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for kind in rows["type"]:
        if kind == "scene":
            out.append("refused" if open_ else "opened")
            open_ = True
        else:
            out.append(("said" if kind == "say" else "settled") if open_ else "refused")
            open_ = open_ and kind != "settle"
    state.update((open_,))
    yield pd.DataFrame({"ledger": [key[0]] * len(rows), "seq": rows["seq"].to_numpy(), "type": rows["type"].to_numpy(), "verdict": out})


def scenes(entries: DataFrame) -> DataFrame:
    """A stream of entries (ledger, seq, type: scene, say or settle) with a verdict: a scene opens if none is open, and only an open one is spoken in or settles."""
    return entries.groupBy("ledger").applyInPandasWithState(_scene, "ledger long, seq long, type string, verdict string", "open boolean", "append", "NoTimeout")


def edited(feed: DataFrame, edits: DataFrame) -> DataFrame:
    """feed (scene, entry, viewer, text) with the author's last edits (scene, entry, text, seq), in all feeds that hold an entry."""
    last = edits.groupBy("scene", "entry").agg(F.max_by("text", "seq").alias("__new"))
    return feed.join(last, ["scene", "entry"], "left").select("scene", "entry", "viewer", F.coalesce("__new", "text").alias("text"))


def progress(events: DataFrame, now: float, idle: float = 120) -> DataFrame:
    """events (task, at, type: progress, done or error) -> task, state: done, error, idle if nothing has come for so long, or running."""
    last = events.groupBy("task").agg(F.max("at").alias("last"), F.max_by("type", "at").alias("type"))
    return last.select("task", F.when(F.col("type").isin("done", "error"), F.col("type")).when(now - F.col("last") > idle, "idle").otherwise("running").alias("state"))


def feed(entries: DataFrame, cast: DataFrame) -> DataFrame:
    """A stream (or table) of entries (scene, seat, layer, ...) to the seats of its scene, the inner life of others hidden. Stateless."""
    out = entries.join(cast.select("scene", F.col("seat").alias("viewer")), "scene")
    return out.where((F.col("layer") != "inner") | (F.col("seat") == F.col("viewer")))


def counts_per_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", start: str = "0 seconds") -> DataFrame:
    """Native extra: counts per event type and window of a stream, with a watermark for late rows; windows begin at `start` after whole ones since 1970."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, startTime=start).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it put out, as a table."""
    spark = stream.sparkSession
    from ..tables import shared_dir

    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path + "/out").option("checkpointLocation", path + "/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path + "/out")
    raise ValueError("only append is put out to files")


def deliver_once(spark: SparkSession, path: str, schema, to_messages) -> DataFrame:
    """Deliveries over files in a folder read as a stream; to_messages maps a row of them to messages."""
    raw = spark.readStream.schema(schema).parquet(path)
    return drain(deliveries(to_messages(raw)))
