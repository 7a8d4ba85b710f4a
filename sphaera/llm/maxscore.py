"""Exact top-k search by MaxScore over sharded postings.

The terms of a vector are its dimensions, its weights the components scaled to integers; a score is an integer inner
product. A shard is an inverted index of SHARD vectors with the postings of each term and, per term, the least and greatest
weight in the shard, which bound what the term can add to a query's score. For a query the terms are ordered by the width of
these bounds. With the k-th best score so far as threshold, the terms whose bounds together can't lift a vector to it are
non-essential. The postings of the essential ones are traversed to give every vector of the shard a partial score; only
vectors that can still compete are probed in the other terms, bound by bound, and drop out as soon as they can't. Each
task's best k of each query are merged in the end.

Vectors and queries are packed into blocks of SHARD rows, which are written once. Each query first gets a threshold from one block
of candidates (SEED rows at most, broadcast): its k-th best score there is never above the one over all. Groups of candidate blocks
then meet groups of query blocks (GROUP_BYTES of either at most, on average) in one task for each pair of groups, so that neither the
driver nor a task holds all queries or all candidates. Every query has to meet every candidate; the threshold is what saves work.

Ties go to the smaller vec_id; bounds are compared so that ties are never lost. Nulls and edges: vectors that are null or
hold a null or a non-finite component take no part, nor do rows without vec_id; a vector shorter than another has weight 0
in the terms it lacks; repeated rows are candidates each, and a query repeated under one id is asked once, with its
smallest vector; a row is its query's own when the ids agree; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Steps, read, stored

SCALE, K, EVERY = 64, 20, 20
#: Vectors of a shard, candidates that give the first thresholds, and bytes of a group of candidates or queries.
SHARD, SEED, GROUP_BYTES = 1024, 1024, 32 << 20
#: Non-essential terms probed between two looks at who still competes.
PROBE = 12


def weights(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double, null for vectors that take no part."""
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the arrays in column, filled up or cut to width."""
    n = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return column.flatten().to_numpy().reshape(-1, width).astype(np.float64)
    out = np.zeros((len(n), width))
    for i, r in enumerate(column.to_pylist()):
        out[i, : min(len(r), width)] = r[:width]
    return out


class _Shard:
    """Postings of a block of vectors: one row of `index` per term, and the bounds of each term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.index = ids[order], np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.index.min(axis=1), self.index.max(axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> int:
        """Improve each query's (scores, ids), best first, by this shard; least: what a score has to reach at any rate. Returns the number of postings looked at."""
        add_low, add_high = np.minimum(queries * self.low, queries * self.high), np.maximum(queries * self.low, queries * self.high)
        order_of = np.argsort(add_low - add_high, axis=1, kind="stable")  # widest bounds first
        tail = lambda x: np.concatenate([np.cumsum(np.take_along_axis(x, order_of, 1)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
        most, wide = tail(add_high), tail(add_high - add_low)  # what terms from here on can add, and by how much it can vary
        sure, looked = add_low.sum(axis=1), 0
        index = self.index
        if (np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high))).max(initial=0) < 1 << 24:  # whole numbers that half the bytes hold exactly
            index, queries = index.astype(np.float32), queries.astype(np.float32)
        for q in range(len(queries)):
            order = order_of[q]
            scores, ids = best[q]
            floor = max(least[q], scores[k - 1]) if len(scores) >= k else least[q]
            if most[q, 0] < floor:
                continue
            # Above its least possible score a vector needs floor - sure; the narrowest terms whose widths together stay below that are non-essential.
            short = wide[q] < floor - sure[q]
            essential = max(1, int(short.argmax())) if short.any() else len(order)
            terms = order[:essential]
            part = queries[q, terms] @ index[terms]
            looked += essential * len(part)
            alive = np.flatnonzero(part + most[q, essential] >= floor)
            part = part[alive]
            for at in range(essential, len(order), PROBE):
                if not len(alive):
                    break
                terms = order[at : at + PROBE]
                part = part + queries[q, terms] @ index[np.ix_(terms, alive)]
                looked += len(terms) * len(alive)
                on = part + most[q, min(at + PROBE, len(order))] >= floor
                alive, part = alive[on], part[on]
            own = self.ids[alive] != query_ids[q]
            alive, part = alive[own], part[own]
            if len(part) > k:
                edge = np.partition(part, len(part) - k)[len(part) - k]
                keep = part >= edge
                alive, part = alive[keep], part[keep]
            if len(part):
                s, i = np.concatenate([scores, part.astype(np.float64)]), np.concatenate([ids, self.ids[alive]])
                top = np.lexsort((i, -s))[:k]
                best[q] = s[top], i[top]
        return looked


_BLOCKS = "block long, n int, ids binary, weights binary"


def _blocks(vectors: DataFrame, width: int) -> DataFrame:
    """vectors (vec_id, weights) -> blocks of SHARD of them: block, n, ids and weights (eight bytes each, row by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for at in range(0, b.num_rows, SHARD):
                cut = b.slice(at, SHARD)
                row = [first + made, cut.num_rows, cut.column(0).to_numpy().astype(np.int64).tobytes(), _matrix(cut.column(1), width).tobytes()]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.binary()), pa.array([row[3]], pa.binary())], names=["block", "n", "ids", "weights"])

    return vectors.select(F.col("vec_id").cast("long"), "weights").mapInArrow(run, _BLOCKS)


def _arrays(n: int, ids: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(weights, np.float64).reshape(n, -1)


def _with_least(queries: DataFrame, seed: tuple[np.ndarray, np.ndarray] | None, k: int) -> DataFrame:
    """Blocks of queries with `least`: each one's k-th best score among the seed's vectors but its own id, or -infinity if there are fewer."""
    shared = queries.sparkSession.sparkContext.broadcast(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, i, w in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                ids, weights = _arrays(n, i, w)
                least = np.full(n, -np.inf)
                if shared.value is not None and len(shared.value[0]) > k:
                    seed_ids, vectors = shared.value
                    scores = np.where(ids[:, None] == seed_ids, -np.inf, weights @ vectors.T)
                    least = np.partition(scores, len(seed_ids) - k, axis=1)[:, len(seed_ids) - k]
                out.append(least.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=["block", "n", "ids", "weights", "least"])

    return queries.mapInArrow(run, _BLOCKS + ", least binary")


def _searcher(k: int, looked=None):
    """What a group of candidates shows for a group of queries; looked: an accumulator of postings looked at."""

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        rows = queries.to_pylist()
        asked = [(*_arrays(r["n"], r["ids"], r["weights"]), np.frombuffer(r["least"], np.float64)) for r in rows]
        best = [[(np.empty(0), np.empty(0, np.int64)) for _ in ids] for ids, _, _ in asked]
        for n, i, w in zip(*(candidates.column(c) for c in ("n", "ids", "weights")), strict=True):
            shard = _Shard(*_arrays(n.as_py(), i.as_py(), w.as_py()))
            for (ids, weights, least), found in zip(asked, best, strict=True):
                seen = shard.search(ids, weights, least, found, k)
                if looked is not None:
                    looked.add(seen)
        flat = [(q, s, i) for (ids, _, _), found in zip(asked, best, strict=True) for q, (s, i) in zip(ids, found, strict=True)]
        n = [len(s) for _, s, _ in flat]
        some = lambda at, kind: np.concatenate([x[at] for x in flat]).astype(kind) if flat else np.empty(0, kind)
        return pa.table({"query_id": np.repeat(np.array([q for q, _, _ in flat], np.int64), n), "vec_id": some(2, np.int64), "score": some(1, np.int64)})

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, looked=None) -> DataFrame:
    """candidates and queries (vec_id, weights array<double>, both sound) -> query_id, rank from 1, vec_id, score."""
    with Steps() as steps:
        asked = queries.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("weights").alias("weights"))
        width = max(1, asked.agg(F.max(F.size("weights"))).first()[0] or 0)
        held = steps.stored(_blocks(candidates, width), "candidates")
        first = held.orderBy(F.desc("n"), "block").limit(1).select("n", "ids", "weights").first()
        seed = None
        if first:
            ids, vectors = _arrays(*first)
            seed = (ids[:SEED], vectors[:SEED])
        asks = steps.stored(_with_least(_blocks(asked, width), seed, k), "queries")
        groups = lambda t: max(1, -(-(t.agg(F.sum("n")).first()[0] or 0) * width * 8 // GROUP_BYTES))
        g, h = groups(held), groups(asks)
        g = max(g, min(held.count(), candidates.sparkSession.sparkContext.defaultParallelism))
        dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
        c = held.select(dealt(g).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"), "n", "ids", "weights")
        a = asks.select(F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("g"), dealt(h).alias("h"), "n", "ids", "weights", "least")
        found = c.groupBy("g", "h").cogroup(a.groupBy("g", "h")).applyInArrow(_searcher(k, looked), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return stored(out, "top")


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", weights(F.col("embedding")).alias("weights")).where("weights IS NOT NULL AND vec_id IS NOT NULL")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0)).select("query_id", "rank", "vec_id", "score")


_ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""

QUERIES = {"op4_maxscore": op4_maxscore}
ORACLES = {"op4_maxscore": _ORACLE}
