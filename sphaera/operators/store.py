"""Entities with multi-valued attributes, locks, generation merges and changesets, as append-only tables.

entries (entity, kind, attr, value, source 'gen' or 'user', valid_from, valid_to, rev) and locks (entity, attr or '*') are logs;
nothing is rewritten, and what holds is resolved when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import resolve


def locked(locks: DataFrame) -> DataFrame:
    """locks log (entity, attr, locked boolean, rev) -> entity, attr locked now: the latest row decides."""
    now = locks.groupBy("entity", "attr").agg(F.max_by("locked", "rev").alias("on"))
    return now.where("on").select("entity", "attr")


def apply_generation(entries: DataFrame, locks: DataFrame, batch: DataFrame, rev: int) -> DataFrame:
    """batch (entity, kind, attr, value) over entries -> rows to append, with `action`.

    New entities are created; those fully locked ('*') are left alone; of the others the attributes that aren't locked are
    written, and a retired one comes back. An entity of the batch's kinds that the batch lacks is retired if it was generated, no
    user ever wrote to it, nothing of it is locked and it isn't retired yet."""
    on = locked(locks)
    full, some = on.where("attr = '*'").select("entity"), on.select("entity").distinct()
    known = entries.groupBy("entity").agg(F.max("kind").alias("kind"), F.max((F.col("source") == "gen").cast("int")).alias("gen"), F.max((F.col("source") == "user").cast("int")).alias("user"))
    retired = resolve(entries.where("attr = '_retired'")).where("value = 'true'").select("entity")
    incoming = batch.select("entity", "kind").distinct()
    open_ = incoming.join(full, "entity", "left_anti")
    existing = open_.join(known.select("entity"), "entity", "left_semi")
    row = lambda df, value, action: df.select("entity", "kind", F.col("attr") if "attr" in df.columns else F.lit("_retired").alias("attr"), value.alias("value"), F.lit("gen").alias("source"), F.lit(None).cast("double").alias("valid_from"), F.lit(None).cast("double").alias("valid_to"), F.lit(rev).cast("long").alias("rev"), action.alias("action"))
    writes = batch.join(open_.select("entity"), "entity", "left_semi").join(on, ["entity", "attr"], "left_anti").join(known.select("entity", F.lit(1).alias("__known")), "entity", "left")
    written = row(writes, F.col("value"), F.when(F.col("__known").isNull(), "created").otherwise("updated"))
    back = row(existing.join(retired, "entity", "left_semi"), F.lit("false"), F.lit("returned"))
    gone = known.join(incoming.select("kind").distinct(), "kind", "left_semi").join(incoming.select("entity"), "entity", "left_anti").where("gen = 1 AND user = 0")
    gone = gone.join(some, "entity", "left_anti").join(retired, "entity", "left_anti")
    return written.unionByName(back).unionByName(row(gone, F.lit("true"), F.lit("retired")))


def merge_counts(entries: DataFrame, locks: DataFrame, batch: DataFrame) -> DataFrame:
    """created, updated, retired: entities, each counted once."""
    rows = apply_generation(entries, locks, batch, 0)
    known = entries.select("entity").distinct().withColumn("known", F.lit(1))
    full = locked(locks).where("attr = '*'").select("entity")
    seen = batch.select("entity").distinct().join(known, "entity", "left").join(full, "entity", "left_anti")
    a = seen.agg(F.count_if(F.col("known").isNull()).alias("created"), F.count_if(F.col("known").isNotNull()).alias("updated"))
    b = rows.where("action = 'retired'").agg(F.countDistinct("entity").alias("retired"))
    return a.crossJoin(b)  # two single rows


def compact_timeless(entries: DataFrame) -> DataFrame:
    """entries without generated timeless values that a later one has replaced."""
    timeless = (F.col("source") == "gen") & F.col("valid_from").isNull() & F.col("valid_to").isNull()
    latest = Window.partitionBy("entity", "attr", timeless).orderBy(F.desc("rev"))
    return entries.withColumn("__n", F.row_number().over(latest)).where(~timeless | (F.col("__n") == 1)).drop("__n")


def preview(canon: DataFrame, ops: DataFrame) -> DataFrame:
    """What canon would be with a staged changeset's ops (rows like entries, without rev): a plan, nothing is written. ops win ties."""
    top = canon.agg(F.coalesce(F.max("rev"), F.lit(0)).alias("top"))
    return canon.unionByName(ops.crossJoin(F.broadcast(top)).withColumn("rev", F.col("top") + 1).drop("top").select(*canon.columns))


def find(entries: DataFrame, kind: str | None = None, name: str | None = None, as_of=None, retired: bool = False) -> DataFrame:
    """entity, name of entities by kind and part of the name in any case, without retired ones."""
    rows = entries if kind is None else entries.where(F.col("kind") == kind)
    now = resolve(rows.where(F.col("attr").isin("name", "_retired")), as_of)
    wide = now.groupBy("entity").agg(F.max(F.when(F.col("attr") == "name", F.col("value"))).alias("name"), F.max(F.when(F.col("attr") == "_retired", F.col("value"))).alias("r"))
    if name is not None:
        wide = wide.where(F.contains(F.lower("name"), F.lit(name.lower())))
    return (wide if retired else wide.where("r IS NULL OR r != 'true'")).select("entity", "name")


def snapshot(entries: DataFrame, locks: DataFrame, as_of=None) -> DataFrame:
    """entity, kind, attrs (map of what holds), locked (sorted names; '*' is the whole entity)."""
    kinds = entries.groupBy("entity").agg(F.max("kind").alias("kind"))
    now = resolve(entries, as_of).groupBy("entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "value")))).alias("attrs"))
    held = locked(locks).groupBy("entity").agg(F.sort_array(F.collect_set("attr")).alias("locked"))
    none = F.array().cast("array<string>")
    return kinds.join(now, "entity", "left").join(held, "entity", "left").select("entity", "kind", F.coalesce("attrs", F.map_from_arrays(none, none)).alias("attrs"), F.coalesce("locked", none).alias("locked"))


def edit(entries: DataFrame, edits: DataFrame, rev: int) -> DataFrame:
    """Rows to append for edits (entity, attr, value, valid_from, valid_to) of entities that are there, by a user."""
    kinds = entries.groupBy("entity").agg(F.max("kind").alias("kind"))
    return edits.join(kinds, "entity").select("entity", "kind", "attr", "value", F.lit("user").alias("source"), "valid_from", "valid_to", F.lit(rev).cast("long").alias("rev"))


def entity_name(rows: DataFrame, entries: DataFrame, column: str, as_of=None) -> DataFrame:
    """rows with `name`: what the entity in a column is called, null if it has no name."""
    names = resolve(entries.where("attr = 'name'"), as_of).select(F.col("entity").alias(column), F.col("value").alias("name"))
    return rows.join(names, column, "left")


#: What a changeset's log says of it.
STAGED, MERGED, DROPPED = "staged", "merged", "dropped"


def stage(changeset: str, label: str, day: float, ops: DataFrame) -> DataFrame:
    """ops (action 'create', 'set_attr', 'lock' or 'unlock', entity, kind, attr, value, valid_from, valid_to) as rows of the log of changesets."""
    mine = {"changeset": F.lit(changeset), "label": F.lit(label), "day": F.lit(float(day))}
    return ops.select(*(c.alias(n) for n, c in mine.items()), *ops.columns)


def status(events: DataFrame) -> DataFrame:
    """events (changeset, status, seq) -> changeset, status: the last one, but a merged changeset stays merged."""
    return events.groupBy("changeset").agg(F.when(F.max(F.col("status") == MERGED), MERGED).otherwise(F.max_by("status", "seq")).alias("status"))


def merge(canon: DataFrame, log: DataFrame, events: DataFrame) -> DataFrame:
    """canon and what its merged changesets set: an op's value holds from its own day on or else the changeset's, as a user's, later changesets above earlier ones."""
    seq = events.where(F.col("status") == MERGED).groupBy("changeset").agg(F.min("seq").alias("seq"))
    top = canon.agg(F.coalesce(F.max("rev"), F.lit(0)).alias("top"))
    sets = log.where("action = 'set_attr'").join(seq, "changeset").crossJoin(F.broadcast(top))
    rows = sets.select("entity", "kind", "attr", "value", F.lit("user").alias("source"), F.coalesce("valid_from", "day").alias("valid_from"), "valid_to", (F.col("top") + F.col("seq")).alias("rev"))
    return canon.unionByName(rows.select(*canon.columns))


def merged_locks(locks: DataFrame, log: DataFrame, events: DataFrame) -> DataFrame:
    """locks and what merged changesets lock and unlock."""
    seq = events.where(F.col("status") == MERGED).groupBy("changeset").agg(F.min("seq").alias("seq"))
    top = locks.agg(F.coalesce(F.max("rev"), F.lit(0)).alias("top"))
    rows = log.where("action IN ('lock', 'unlock')").join(seq, "changeset").crossJoin(F.broadcast(top)).select("entity", F.coalesce("attr", F.lit("*")).alias("attr"), (F.col("action") == "lock").alias("locked"), (F.col("top") + F.col("seq")).alias("rev"))
    return locks.unionByName(rows.select(*locks.columns))


def timeline(log: DataFrame, events: DataFrame) -> DataFrame:
    """ord, changeset, label, day, ops of the merged changesets by story day, then in the order they were staged (of their names)."""
    done = status(events).where(F.col("status") == MERGED).select("changeset")
    by = log.join(done, "changeset", "left_semi").groupBy("changeset").agg(F.first("label").alias("label"), F.first("day").alias("day"), F.count("*").alias("ops"))
    from .ranking import ranked

    return ranked(by.withColumn("back", -F.col("day")), "back", "changeset").select(F.col("rank").alias("ord"), "changeset", "label", "day", "ops")
