"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of code points other than space, \t, \n, \v, \f and \r. bytes.split() cuts UTF-8 at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other code point kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The column's texts as UTF-8 bytes, some at a time so that a batch isn't held twice; null is empty."""
    for at in range(0, len(column), 256):
        for x in column.slice(at, 256).cast(pa.large_binary()).to_pylist():
            yield b"" if x is None else x


_SCRATCH: dict[str, dict] = {}


def scratch(operator: str) -> dict:
    """What tasks of an operator keep from one to the next in a Python worker. Workers go from one operator to another: what others
    have kept is let go."""
    others = [k for k in _SCRATCH if k != operator]
    for other in others:
        del _SCRATCH[other]
    if others:
        give_back()
    return _SCRATCH.setdefault(operator, {})


def give_back() -> None:
    """Hand to the system what this Python worker has freed. Arrow's pool and malloc keep it otherwise, and over the steps of a job it adds
    up, while the executor's heap grows as well."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, with give_back() at the end of each task."""

    @wraps(run)
    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return then


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset a new one is set on a single machine; a cluster has to name one."""
    have = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sphaera-"))
        have = spark.sparkContext.getCheckpointDir()
    return have


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more; else they stay until the driver
    happens to collect its garbage, and add up over the steps of a job. For steps that shuffle much."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within the block Spark deletes the shuffle files of a query when it ends, with no need of release(): for steps that are stored and not run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def forget(df: DataFrame) -> None:
    """Delete a table made by stored() that no later plan reads."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """Tables of an operator's steps; those made within the block are deleted at its end, when the result has been stored outside it."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def forget(self, df: DataFrame) -> None:
        """Delete a table of a step that no later one reads before the block's end."""
        self.tables = [t for t in self.tables if t is not df]
        forget(df)

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *error) -> None:
        for t in self.tables:
            forget(t)


#: A key with more than one in so many rows is heavy; there are fewer such keys than that.
HEAVY = 1000


def join_unique(rows: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row at most for each value of `on` (rows has nulls in it only where how is left).

    Heavy keys of rows, fewer than HEAVY whatever the input, take their partners from a broadcast table; the others are shuffled."""
    sizes = rows.groupBy(on).agg(F.count("*").alias("__n"))
    # One pass finds the heavy ones: those above their share of the total, which is one row.
    least = sizes.agg((F.sum("__n") / HEAVY).alias("__least"))
    heavy = stored(sizes.crossJoin(F.broadcast(least)).where("__n > __least AND __n > 10000").select(on), "heavy")
    if not heavy.limit(1).count():
        return rows.join(side, on, how)
    few = side.join(F.broadcast(heavy), on, "left_semi")
    hot = rows.join(F.broadcast(heavy), on, "left_semi").join(F.broadcast(few), on, how)
    rest = rows.join(F.broadcast(heavy), on, "left_anti").join(side, on, how)
    return hot.unionByName(rest)


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df as a table sorted into ranges over all tasks, with the number of each row's range (__p) and its place there from 0 (__i)."""
    place = F.monotonically_increasing_id()
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place)
    written = stored(ranges, "ranges")
    return written.withColumns({"__p": F.shiftright("__at", 33).cast("int"), "__i": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at")


def before_ranges(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """in_ranges() with __before_x for each sum x: what it is over the ranges before a row's own. The window runs over one row for each range."""
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("__p").agg(*(e.alias(n) for n, e in sums.items()))
    return rows.join(F.broadcast(ranges.select("__p", *(F.sum(n).over(before).alias(f"__before_{n}") for n in sums))), "__p")


def sparse(counts: np.ndarray) -> bytes:
    """Values (eight bytes each) and places (four) of the counts that aren't 0."""
    at = np.flatnonzero(counts)
    return counts[at].astype(np.int64).tobytes() + at.astype(np.int32).tobytes()


def dense(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of sparse()."""
    n = len(payload) // 12
    return np.frombuffer(payload, np.int32, n, 8 * n), np.frombuffer(payload, np.int64, n)


def tree_sum(parts: DataFrame, fold: Callable[[pa.Table], pa.Table], fan: int = 256, finish: Callable[[pa.Table], pa.Table] | None = None, schema: str | None = None) -> DataFrame:
    """parts (part, task, payload, ...) of a pass over a corpus, written as a table and folded by `part`.

    fold() makes one row of some rows of one part. Rows of more than `fan` tasks are folded in rounds, so that no group holds more
    than `fan` rows, however many tasks there were; the rounds are the logarithm of their number. finish() turns the last row of a
    part into one of `schema`, in the same task."""
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    own, names = parts.schema, parts.columns

    def some(t: pa.Table) -> pa.Table:
        task = pa.array([t.column("task")[0].as_py() // fan], pa.int32())
        return fold(t.drop_columns("task")).append_column("task", task).select(names)

    while tasks > fan:
        parts = parts.groupBy("part", F.floor(F.col("task") / fan).alias("__some")).applyInArrow(some, own)
        tasks = -(-tasks // fan)
    last = (lambda t: finish(fold(t.drop_columns("task")))) if finish else (lambda t: fold(t.drop_columns("task")))
    return parts.groupBy("part").applyInArrow(last, schema or T.StructType([f for f in own if f.name != "task"]))



def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """df's columns but those whose names an operator gives to its own results (names compare without case)."""
    own = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in own]
