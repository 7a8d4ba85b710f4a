"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target by its weight, and target over size is the source's repetition
rate. A document is emitted floor(rate) times, and once more with a probability of rate's fraction, decided by a hash of
the seed and its columns, so that reruns and retried tasks decide alike.

Rows that are equal in all columns can't be told apart, so they are decided together: of m such rows, floor(m * fraction) get the
further copy, and one more by the group's draw. Which of them is of no account. They are found by 128 bits of hashes, counted, and
unfolded again from one row in chunks that are dealt to all tasks, so that a group of any size is no one task's.

Targets: the sources share the total by weight; none gets more than `most` times its size, and what a capped source leaves
is shared among the others by weight until none is above. In closed form: target = min(cap, level * weight), where level
is found in one pass over the sources in the order of cap / weight, the order in which they reach their caps.

Nulls and edges: a null source is a source of its own (last in order); a null text has size 0; a source of size 0 has
target 0 and its documents are taken floor(0) = 0 times; of repeated rows as many get a further copy as their number asks for; rows
that differ in any column (but maps, which aren't looked at) are decided each; columns besides doc_id, text and source are carried through untouched, whatever their names, but for those in RESULT, which the
operator's own replace; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import before_ranges, in_ranges, read, stored, without, word_count

RESULT = ("size", "source_size", "target", "copies")
#: Source tables of at most so many rows are broadcast (under 1 MB); larger ones are joined by salted keys.
BROADCAST_SOURCES, SALTS = 10_000, 64
#: Hashes of repeated rows (16 bytes each) that are broadcast at most, and rows that are unfolded by a task at once.
BROADCAST_REPEATS, CHUNK = 200_000, 10_000


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """sources and `weight`: the weights in turn, over the sources by code point, null last."""
    rows = in_ranges(sources, F.col("source").asc_nulls_last())
    place = F.col("__i") + F.coalesce("__before_n", F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    return before_ranges(rows, {"n": F.count("*")}).select(*(F.col(f"`{c}`") for c in sources.columns), weight.alias("weight"))


def source_sizes(docs: DataFrame) -> DataFrame:
    """One row per source: source, source_size. Partial sums leave one row per source and task for the shuffle."""
    return docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """sources (source, source_size, weight > 0) and their `target`. Sources are sorted into ranges, within which the running sums
    are taken, so that no task sees them all."""
    ratio = F.col("source_size") / F.col("weight")
    rows = before_ranges(in_ranges(sources, ratio, F.col("source").asc_nulls_last()), {"size": F.sum("source_size"), "weight": F.sum("weight")})
    within = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, n: F.coalesce(F.col(f"__before_{n}"), F.lit(0)) + F.coalesce(F.sum(c).over(within), F.lit(0))
    total = rows.agg(F.sum("source_size").alias("__size"), F.sum("weight").alias("__weight"))
    level = (F.col("__size") - most * before("source_size", "size")) / (F.col("__weight") - before("weight", "weight"))
    # Those before the first source whose cap exceeds its share of what is left are capped; that source's level is everybody's.
    capped = rows.join(F.broadcast(total)).withColumn("__level", level).withColumn("__open", most * F.col("source_size") > F.col("__level") * F.col("weight"))
    everybodys = capped.agg(F.min_by(F.when(F.col("__open"), F.col("__level")), F.when(F.col("__open"), ratio)).alias("__level"))
    cap = most * F.col("source_size")
    out = [F.col(f"`{c}`") for c in sources.columns]
    return rows.join(F.broadcast(everybodys)).select(*out, F.coalesce(F.least(cap, F.col("__level") * F.col("weight")), cap).cast("double").alias("target"))


def _draw(row: Column, seed: int) -> Column:
    """Uniform in [0, 1) by a hash of the row."""
    return F.pmod(F.xxhash64(F.lit(seed), row), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _with_targets(docs: DataFrame, aims: DataFrame) -> DataFrame:
    aims = aims.select(F.col("source").alias("__source"), "source_size", "target")
    if aims.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(aims), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    salted = aims.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return docs.withColumn("__salt", key).join(salted.withColumnRenamed("__salt", "__s"), F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__s"))).drop("__source", "__salt", "__s")


def plan(docs: DataFrame, weights: DataFrame | None = None, most: float = 3.0, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and copies. weights: (source, weight) for every source; by default 5, 2, 1 in turn."""
    docs = docs.select(*[F.col(f"`{c}`") for c in without(docs, RESULT)])
    sizes = source_sizes(docs)
    if weights is None:
        weighted = cyclic_weights(sizes)
    else:
        w = weights.select(F.col("source").alias("__w"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.join(w, F.col("source").eqNullSafe(F.col("__w"))).drop("__w")
    # One row per source, computed once: the check of its size and the join both read it.
    aims = stored(targets(weighted, most).select("source", "source_size", "target"), "targets")
    rows = _with_targets(docs.withColumn("size", word_count(F.col("text"))), aims)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    known = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    known += [c.isNull() for c in known]  # the hash passes over nulls
    hashes = {"__a": F.xxhash64(*known), "__b": F.xxhash64(F.lit(seed), *known)}
    repeats = stored(docs.select(*(h.alias(n) for n, h in hashes.items())).groupBy("__a", "__b").agg(F.count("*").alias("__m")).where("__m > 1"), "repeats")
    n, out = repeats.count(), [*docs.columns, "size", "source_size", "target", "copies"]
    out = [F.col(f"`{c}`") for c in out]
    rows = rows.withColumns(hashes)
    one = lambda df: df.withColumn("copies", (whole + F.when(_draw(F.col("__b"), seed) < rate - whole, 1).otherwise(0)).cast("int")).select(*out)
    if not n:
        return one(rows)
    side = F.broadcast(repeats) if n <= BROADCAST_REPEATS else repeats
    keys = ["__a", "__b"]
    held = F.struct(*(F.col(f"`{f}`") for f in rows.columns if f not in keys))
    group = rows.join(side.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.first(held).alias("__row"), F.count("*").alias("__m")).select(*keys, "__m", "__row.*")
    # How many of the group get the further copy, and how many don't; either in chunks.
    more = F.floor(F.col("__m") * (rate - whole) + _draw(F.col("__b"), seed))
    parts = F.filter(F.array(F.struct((whole + 1).alias("copies"), more.alias("n")), F.struct(whole.alias("copies"), (F.col("__m") - more).alias("n"))), lambda x: x["n"] > 0)
    parts = group.withColumn("__part", F.explode(parts))
    chunks = parts.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__part.n") - 1) / CHUNK)))).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = F.least(F.lit(CHUNK), F.col("__part.n") - F.col("__chunk") * CHUNK)
    again = chunks.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), size))).withColumn("copies", F.col("__part.copies").cast("int")).select(*out)
    return one(rows.join(side.select(*keys), keys, "left_anti")).unionByName(again)


def mix(docs: DataFrame, weights: DataFrame | None = None, most: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: every row of docs as often as plan() says, with docs' columns. Copies are made row by row, in place."""
    columns = [F.col(f"`{c}`") for c in without(docs, RESULT)]
    rows = plan(docs, weights, most, seed).where("copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
