"""Values in time: as-of resolution with precedence, intervals, trails and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALWAYS = -1e18


def resolve(entries: DataFrame, as_of: Column | None = None) -> DataFrame:
    """entries (entity, attr, value, source, valid_from, valid_to, rev) -> entity, attr, value that holds.

    Of the entries whose [valid_from, valid_to) holds as_of (all, if none is given): a user's before a generated one, one with an
    interval before a timeless one, then the latest valid_from and rev. A partial aggregate: one row per attribute is shuffled
    from each task."""
    if as_of is not None:
        entries = entries.where((F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of)))
    dated = (F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()).cast("int")
    rank = F.struct((F.col("source") == "user").cast("int"), dated, F.coalesce("valid_from", F.lit(ALWAYS)), "rev")
    return entries.groupBy("entity", "attr").agg(F.max_by("value", rank).alias("value"))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Every row of left with right's latest value not after it, by key: one sort of the union instead of a range join.

    Of right rows of equal key and time the greatest value is taken."""
    r = right.groupBy(key, F.col(since).alias("__t")).agg(F.max(value).alias("__v")).withColumn("__left", F.lit(0))
    u = left.withColumns({"__t": F.col(at), "__left": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn(value, F.last("__v", ignorenulls=True).over(order)).where("__left = 1").drop("__t", "__left", "__v")


def interval_of(at: Column, spans: list[tuple[str, float, float | None]]) -> Column:
    """Name of the first span (name, start, stop or None for no end) of an author's list that holds a day, or null; no join."""
    out = F.lit(None).cast("string")
    for name, start, stop in reversed(spans):
        inside = at >= start
        out = F.when(inside if stop is None else inside & (at < stop), name).otherwise(out)
    return out


def trail(rows: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """Consecutive pairs of a key's rows in time: each row with the one before, as prev_ columns."""
    order = Window.partitionBy(key).orderBy(at, *columns)
    out = rows.select("*", *(F.lag(c).over(order).alias(f"prev_{c}") for c in (at, *columns)))
    return out.where(F.col(f"prev_{at}").isNotNull())


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, run, value, first, last, n of the runs of equal values."""
    w = Window.partitionBy(key).orderBy(order)
    changed = rows.withColumn("__new", (~F.lag(value).over(w).eqNullSafe(F.col(value)) | F.lag(order).over(w).isNull()).cast("int"))
    numbered = changed.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def sessions(rows: DataFrame, key: list[str], at: str, gap: float, best: str) -> DataFrame:
    """Sessions of rows not more than `gap` apart: start, stop, n, and the time of the smallest `best`."""
    w = Window.partitionBy(*key).orderBy(at)
    cut = rows.withColumn("__new", F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1)))
    numbered = cut.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "session").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("n"), F.min_by(at, F.struct(best, at)).alias("peak"), F.min(best).alias("least"))
