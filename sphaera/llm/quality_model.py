"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated output.

Words are split where letters and digits meet other characters, and each part is hashed into one of BUCKETS. A bucket has a
sparse random index vector (a few signs at hashed places); its word vector is the sum of the index vectors seen within
WINDOW places of it, over all documents, scaled to length 1. A document's features are the mean and the standard deviation of its
parts' vectors and the root mean square of the steps from one to the next, rarer parts weighing more. Whatever the corpus, the
vectors take BUCKETS * DIM floats (8 MB), so they can be broadcast; each task adds up its own in whole numbers, and blocks of
buckets are summed in a tree, so that the sums are exact and the same in any order.

The network is fitted on the driver, on the features of at most about TRAIN labelled documents (768 bytes each); the
temperature that divides its logits is chosen on a part of them left out of the fitting.

Nulls and edges: a null or empty text has all features 0 and is scored like any other; a label that is null, has no document
or whose document has no id isn't learned; of several labels of a document the mean counts, rounded; of rows that share a labelled id
one is learned from, repeated rows are scored each; with no labels of one of the two kinds every score is the share of label 1 (0.5 without any); other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, read, scratch, tree_sum, utf8

BUCKETS, DIM, SIGNS, WINDOW, BLOCK = 1 << 15, 64, 2, 2, 1 << 8
FEATURES = 3 * DIM
#: About so many labelled documents are learned from; the bound of the fitting.
TRAIN = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 2e-3, 1e-2
SMOOTH = 1e-3
#: Words that a worker keeps the parts of.
CACHE = 400_000
_PARTS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+")


class _Parts(dict):
    """word -> the buckets of its parts, four bytes each."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = np.array([zlib.crc32(p) % BUCKETS for p in _PARTS.findall(word)], "<i4").tobytes()
        return out


def _parts() -> _Parts:
    kept = scratch("quality_model")
    if "parts" not in kept:
        kept["parts"] = _Parts()
    return kept["parts"]


def _buckets(text: bytes, parts: _Parts) -> np.ndarray:
    return np.frombuffer(b"".join(map(parts.__getitem__, text.split())), "<i4")


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, DIM, (BUCKETS, SIGNS)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, SIGNS))


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of neighbours' index vectors and its counts, by blocks of buckets."""
    from pyspark import TaskContext

    places, signs = _index_vectors()
    sums, counts = np.zeros(BUCKETS * DIM, np.int64), np.zeros(BUCKETS, np.int64)

    def add(texts: list[np.ndarray]) -> None:
        # Texts are parted by WINDOW places without a word.
        gap = np.full(WINDOW, -1, np.int32)
        ids = np.concatenate([x for t in texts for x in (t, gap)])
        counts[:] += np.bincount(ids[ids >= 0], minlength=BUCKETS)
        for d in range(1, WINDOW + 1):
            a, b = ids[:-d], ids[d:]
            both = (a >= 0) & (b >= 0)
            a, b = a[both].astype(np.int64), b[both].astype(np.int64)
            for x, y in ((a, b), (b, a)):
                for j in range(SIGNS):
                    sums[:] += np.bincount(x * DIM + places[y, j], weights=signs[y, j], minlength=BUCKETS * DIM).astype(np.int64)

    held, size, parts = [], 0, _parts()
    for b in batches:
        for t in utf8(b.column(0)):
            held.append(_buckets(t, parts))
            size += len(held[-1])
            if size > 2_000_000:
                add(held)
                held, size = [], 0
    if held:
        add(held)
    width = BLOCK * DIM
    payload = [_packed(sums[i * width : (i + 1) * width], counts[i * BLOCK : (i + 1) * BLOCK]) for i in range(BUCKETS // BLOCK)]
    task = np.full(len(payload), TaskContext.get().partitionId(), np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(payload)), pa.int32()), pa.array(task), pa.array(payload, pa.binary())], names=["part", "task", "payload"])


def _packed(sums: np.ndarray, counts: np.ndarray) -> bytes:
    """Sums and counts, four bytes for each sum where they are enough."""
    small = not len(sums) or np.abs(sums).max() < 1 << 31
    return counts.tobytes() + sums.astype(np.int32 if small else np.int64).tobytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    small = len(payload) == BLOCK * (8 + 4 * DIM)
    return np.frombuffer(payload, np.int32 if small else np.int64, BLOCK * DIM, 8 * BLOCK).astype(np.int64), np.frombuffer(payload, np.int64, BLOCK)


def _add_blocks(block: pa.Table) -> pa.Table:
    both = [_unpacked(x) for x in block.column("payload").to_pylist()]
    return pa.table({"part": block.column("part")[:1], "payload": pa.array([_packed(sum(s for s, _ in both), sum(c for _, c in both))], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM word vectors over all docs, times the weight of their words."""
    with Steps() as steps:
        parts = steps.stored(docs.select("text").mapInArrow(_context_sums, "part int, task int, payload binary"), "sums")
        total = tree_sum(parts, _add_blocks).toArrow().sort_by("part")
    if not total.num_rows:
        return np.zeros((BUCKETS, DIM), np.float32)
    both = [_unpacked(x) for x in total.column("payload").to_pylist()]
    sums, counts = np.concatenate([s for s, _ in both]).reshape(BUCKETS, DIM).astype(np.float64), np.concatenate([c for _, c in both])
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    weight = SMOOTH / (SMOOTH + counts / max(1, counts.sum()))
    return (unit * weight[:, None]).astype(np.float32)


def _features(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    out, parts = np.zeros((len(texts), FEATURES), np.float32), _parts()
    for i, t in enumerate(texts):
        if len(ids := _buckets(t, parts)):
            v = vectors[ids]
            out[i, :DIM] = mean = np.add.reduce(v, axis=0) / len(ids)
            out[i, DIM : 2 * DIM] = np.sqrt(np.maximum(np.einsum("ij,ij->j", v, v) / len(ids) - mean * mean, 0))
            steps = v[1:] - v[:-1]
            out[i, 2 * DIM :] = np.sqrt(np.einsum("ij,ij->j", steps, steps) / len(ids))
    return out


@dataclass
class Network:
    """Features are standardised, go through tanh units and a logistic one, whose logit is divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, left_out: np.ndarray) -> Network:
    """A network for x (rows of features) and y (0 or 1) by Adam; the temperature by the log-loss on the rows left out."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        zero = np.zeros((FEATURES, HIDDEN))
        odds = np.clip(share, 1e-6, 1 - 1e-6)
        return Network(np.zeros(FEATURES), np.ones(FEATURES), zero, np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(odds / (1 - odds))))
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    use = np.flatnonzero(~left_out) if (~left_out).any() else np.arange(len(y))
    z, t = (x[use] - mean) / scale, y[use]
    p = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for at in range(0, len(t), BATCH):
            i = order[at : at + BATCH]
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -60, 60))) - t[i]) / len(i)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[i].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if left_out.any():
        s = np.where(y[left_out] > 0.5, 1, -1) * net.logits(x[left_out])
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda u: np.logaddexp(0, -s / u).mean()))
    return net


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; of no id, that of the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = TRAIN) -> Network:
    """labels (doc_id, label 0 or 1) that may be learned from. Of more than `most`, a share by hash of the id that leaves about as many."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("label")).cast("double").alias("label"))
    n = known.count()
    share = int((1 << 20) * min(1.0, most / max(1, n)))
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < share).limit(2 * most)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(list(utf8(b.column(1))), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("label", T.DoubleType()), T.StructField("x", T.BinaryType())])
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInArrow(run, schema)
    # One row for each id, however many share it; 2 * most at the utmost.
    rows = found.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("label").alias("label")).toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
    left = np.array([zlib.crc32(f"{i}/left".encode()) % 8 == 0 for i in rows.column("doc_id").to_pylist()], bool)
    return fit(x, rows.column("label").to_numpy(), left)


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """doc_id and score of every row; a map."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(net.scores(_features(list(utf8(part.column(1))), vectors).astype(np.float64)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(fold(F.col("doc_id")) != 0)
    vectors = word_vectors(docs)
    out = score(docs, vectors, train(docs, labels, vectors))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
