"""Keyed state over streams that come late and out of order: edits that reach feeds, tasks that turn idle, passages that close.

What is put out doesn't depend on how rows are dealt to micro-batches. States and passages wait for the watermark; rows that come after it are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


#: Entries of a scene that are kept in one state are those whose numbers are alike but for so many last bits.
TOGETHER = 6


def _correct(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Some entries of a scene: the last edit of each and the viewers who hold it. New viewers get the text as it stands, known ones a correction when an
    edit is later than the last."""
    entries, seqs, texts, held, viewers = state.get if state.exists else ([], [], [], [], [])
    edits = {e: (n, t) for e, n, t in zip(entries, seqs, texts, strict=True)}
    holders: dict[int, list[str]] = {}
    for e, v in zip(held, viewers, strict=True):
        holders.setdefault(e, []).append(v)
    fresh: dict[int, dict] = {}
    newer = set()
    for b in batches:
        for e, viewer, own, n, edit in zip(b["entry"].tolist(), b["viewer"], b["text"], b["seq"], b["edit"], strict=True):
            if not edit:
                fresh.setdefault(e, {})[viewer] = own if isinstance(own, str) else None
            elif isinstance(own, str) and not pd.isna(n) and (e not in edits or (int(n), own) > edits[e]):
                edits[e] = (int(n), own)
                newer.add(e)
    rows = []
    for e in {*fresh, *newer}:
        (seq, text), known, new = edits.get(e, (None, None)), holders.get(e, []), fresh.get(e, {})
        rows += [(e, v, text, seq) for v in known if e in newer and v not in new]
        rows += [(e, v, own if seq is None else text, seq) for v, own in new.items()]
        holders[e] = sorted({*known, *new})
    have = [(e, v) for e, vs in holders.items() for v in vs]
    state.update((list(edits), [n for n, _ in edits.values()], [t for _, t in edits.values()], [e for e, _ in have], [v for _, v in have]))
    if not rows:
        return
    out = pd.DataFrame(rows, columns=["entry", "viewer", "text", "seq"]).astype({"viewer": object, "text": object})
    out["seq"] = out["seq"].astype("Int64")
    yield out.assign(scene=key[0])[["scene", "entry", "viewer", "text", "seq"]]


def corrections(feed: DataFrame, edits: DataFrame) -> DataFrame:
    """Streams feed (scene, entry, viewer, text) and edits (scene, entry, text, seq), each in any order and either first -> scene, entry, viewer,
    text, seq: what a viewer has to show from then on; seq is that of the edit, null for the entry's own text.

    The edit of the greatest seq wins (on a tie the greater text); one without text or seq is none, and rows without scene, entry or viewer are left
    out. An entry that comes to a viewer again is put out again. State is an entry's last edit and its viewers, that of up to 64 entries of a scene together: a call costs more than an entry."""
    keys = (F.col("scene").cast("long").alias("scene"), F.col("entry").cast("long").alias("entry"))
    own = feed.where("scene IS NOT NULL AND entry IS NOT NULL AND viewer IS NOT NULL").select(*keys, "viewer", "text", F.lit(None).cast("long").alias("seq"), F.lit(False).alias("edit"))
    pen = edits.where("scene IS NOT NULL AND entry IS NOT NULL").select(*keys, F.lit(None).cast("string").alias("viewer"), "text", F.col("seq").cast("long").alias("seq"), F.lit(True).alias("edit"))
    keyed = own.unionByName(pen).withColumn("part", F.shiftright("entry", TOGETHER)).groupBy("scene", "part")
    return keyed.applyInPandasWithState(_correct, "scene long, entry long, viewer string, text string, seq long", "entries array<bigint>, seqs array<bigint>, texts array<string>, held array<bigint>, viewers array<string>", "append", "NoTimeout")


def shown(corrected: DataFrame) -> DataFrame:
    """corrections() as a table -> scene, entry, viewer, text: that of the greatest seq of each viewer, on a tie the greater text."""
    last = F.max_by("text", F.struct(F.col("seq").isNotNull(), "seq", "text"))
    return corrected.groupBy("scene", "entry", "viewer").agg(last.alias("text"))


def _watch(idle_us: int):
    """The helper of task_states(): a task's rows above the watermark, and, of those below, the last one's time and what it left the task as."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, kinds, last, now = state.get if state.exists else ([], [], None, None)
        held = list(zip(at, kinds, strict=True))
        if not state.hasTimedOut:
            for b in batches:
                held += zip(b["us"].tolist(), b["type"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        held.sort(key=lambda r: (r[0], r[1] in ("done", "error"), r[1]))
        out = []
        while held and held[0][0] <= passed and now not in ("done", "error"):
            t, kind = held.pop(0)
            if now == "running" and t - last > idle_us:
                out.append((last + idle_us, "idle"))
                now = "idle"
            if kind in ("done", "error"):
                now = kind
                out.append((t, now))
            elif now != "running":
                now = "running"
                out.append((t, now))
            last = t
        if now == "running" and last + idle_us <= passed and not (held and held[0][0] <= last + idle_us):
            now = "idle"
            out.append((last + idle_us, now))
        if now in ("done", "error"):
            held = []
        state.update(([t for t, _ in held], [k for _, k in held], last, now))
        due = [t for t, _ in held[:1]] + ([last + idle_us] if now == "running" else [])
        if due:
            state.setTimeoutTimestamp(max(-(-min(due) // 1000), passed // 1000 + 1))
        if out:
            yield pd.DataFrame({"task": pd.Series([key[0]] * len(out), dtype="int64"), "us": pd.Series([t for t, _ in out], dtype="int64"), "state": pd.Series([s for _, s in out], dtype=object)})

    return run


def task_states(events: DataFrame, idle: float = 120.0, late: str = "10 seconds") -> DataFrame:
    """A stream of events (task, at, type: done and error end a task, others are progress) -> task, us (microseconds since 1970), state: running
    where a task begins or wakes, idle where nothing has come for so many seconds (its timer fires), done or error where it ends.

    Rows wait in the task's state until the watermark has passed them, so they may come out of order; what comes for an ended task is dropped, and so are
    rows with a null. Of rows of one moment an end comes last."""
    rows = events.where("task IS NOT NULL AND at IS NOT NULL AND type IS NOT NULL").select(F.col("task").cast("long").alias("task"), F.col("at").cast("timestamp").alias("at"), "type").withWatermark("at", late)
    rows = rows.withColumn("us", F.unix_micros("at"))
    return rows.groupBy("task").applyInPandasWithState(_watch(int(idle * 1_000_000)), "task long, us long, state string", "at array<bigint>, kinds array<string>, last bigint, now string", "append", "EventTimeTimeout")


def passages(samples: DataFrame, step: str, late: str = "1 hour", near: str | None = None) -> DataFrame:
    """A stream of samples (pair, at, apart) of pairs that are near each other -> pair, first, last, n, least, closest: a passage is open until no sample
    has come within the step, and is put out when the watermark has passed that; closest is the time of the least distance, of equal ones the first.

    Samples may be of pairs that are far apart too: `near` (SQL over samples) tells the others, but time goes on by all samples."""
    timed = samples.withWatermark("at", late)
    # A filter that doesn't ask for the time is moved to before the watermark, which would then be of the near samples only.
    s = (timed.where(F.when(F.col("at").isNotNull(), F.expr(near))) if near else timed).groupBy("pair", F.session_window("at", step).alias("w"))
    return s.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), F.min(F.struct("apart", "at")).alias("m")).select("pair", "first", "last", "n", F.col("m.apart").alias("least"), F.col("m.at").alias("closest"))
