"""Best-fit packing of tokenised documents into sequences by the sum of squares.

A document is its token ids and one END id; one longer than a sequence is cut into full pieces and a rest. Pieces are
dealt evenly to shards of about SHARD pieces or SHARD_TOKENS tokens, and each shard packs its own, longest first: a piece goes where, after
placing it, the sum over all residual gaps of (number of open sequences with that gap) ** 2 is smallest, be it an open
sequence or a new one. A shard holds lengths, ids of documents and, if asked for, token ids, never texts, and its size doesn't grow with the input.

The tokenizer lower-cases, drops white space and never joins what white space parts, so ids are looked up word by word in
a cache of words already encoded; encoding a whole text gives the same ids.

Nulls and edges: a null text is empty, hence the END id alone; doc_id may be null or repeated, each row is a document of its
own; other columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, read, scratch, stored, tidied, utf8

#: A shard has about so many pieces at most, and so many tokens (four bytes each where pieces carry their ids).
CAPACITY, END, SHARD, SHARD_TOKENS = 4096, 1, 30_000, 24_000_000
#: Words that a worker keeps the ids of, some 200 bytes each.
CACHE, SEEN = 600_000, 1 << 22
#: Rows whose pieces a worker makes and puts out at once.
ROWS = 250
_TAIL = re.compile(rb"(.*[0-9a-z])([.,;:!?%$&*#|]+)", re.DOTALL)


class _Ids(dict):
    """word -> its ids, little-endian, four bytes each. A word is kept from the second time it comes, so that those that come once, of
    which there are the most, take no room."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.seen, self.marks = Tokenizer.from_file(path), bytearray(SEEN), 0

    def __missing__(self, word: bytes) -> bytes:
        if cut := _TAIL.fullmatch(word):  # the tokenizer cuts there too
            ids = self[cut[1]] + self[cut[2]]
        else:
            ids = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        at = hash(word) % SEEN
        if self.seen[at]:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        else:
            self.seen[at] = 1
            self.marks += 1
            if self.marks > SEEN // 2:
                self.seen, self.marks = bytearray(SEEN), 0
        return ids


def _words(path: str) -> _Ids:
    kept = scratch("packing")
    if path not in kept:
        kept[path] = _Ids(path)
    return kept[path]


def _ids(text: bytes, words: _Ids) -> bytes:
    if b"<|" not in text:  # special tokens are matched before letters are lowered
        text = text.lower()
    return b"".join(map(words.__getitem__, text.split())) + END.to_bytes(4, "little")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids (binary, four bytes each) if asked for."""
    path = path or tokenizer_path()
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType(), False), *(T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32"))]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            row, out = [], []
            for i, text in enumerate(utf8(b.column(1))):
                ids = _ids(text, words)
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    row.append(i)
                    out.append((p, at // 4, len(cut) // 4, zlib.crc32(cut), cut))
            p, start, length, crc, cut = zip(*out, strict=True) if out else ((),) * 5
            columns = [b.column(0).take(pa.array(row, pa.int32())), pa.array(p, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            made = pa.RecordBatch.from_arrays(columns + ([pa.array(cut, pa.binary())] if with_ids else []), names=[f.name for f in fields])
            del row, out, p, start, length, crc, cut, columns
            yield made
            if with_ids:
                give_back()

    return docs.select("doc_id", "text").mapInArrow(tidied(run), T.StructType(fields))


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the order given."""
    n = np.zeros(capacity + 1, np.int64)  # open sequences by residual gap; full and unopened ones don't count
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    none = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # Moving a sequence from gap g to g - s changes the sum of squares by 2 * (n[g - s] - n[g] + 1), without the part of n[0] for a perfect fit.
        here = n[s:capacity]
        cost = np.where(here > 0, 2 * (n[: capacity - s] - here + 1), none)
        if s < capacity and here[0]:
            cost[0] = 1 - 2 * here[0]
        best = int(cost.argmin()) if s < capacity else 0
        fresh = 2 * n[capacity - s] + 1 if s < capacity else 0
        if s == capacity or cost[best] > fresh or cost[best] == none:
            gap, at, made = capacity, made, made + 1
        else:
            gap = s + best
            at = open_at[gap].pop()
            n[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > s:
            n[gap - s] += 1
            open_at[gap - s].append(at)
    return sequence, offset


def placed(held: list[pa.RecordBatch], capacity: int, first: int) -> Iterator[pa.RecordBatch]:
    """The batches of a shard, one by one, with sequence_id (from `first`) and offset; they leave `held` as they go, and rows keep their order."""
    length = np.concatenate([b.column("length").to_numpy() for b in held])
    order = np.argsort(-length, kind="stable")
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    sequence[order], offset[order] = place(length[order], capacity)
    at = 0
    held.reverse()
    while held:
        b = held.pop()
        own = slice(at, at := at + b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence[own] + first), pa.array(offset[own])], names=[*b.schema.names, "sequence_id", "offset"])


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """items (any columns, `length` among them) with sequence_id and offset. A task holds its shard once and puts it out batch by batch."""
    schema = T.StructType([*(f for f in items.schema if f.name not in ("sequence_id", "offset")), T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])
    names = [f.name for f in schema][:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if "ids" in names:
            scratch("shards")  # the worker's words make room for token ids
        held = [b for b in batches if b.num_rows]
        if held:
            yield from placed(held, capacity, TaskContext.get().partitionId() << 32)

    n, tokens = items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    shards = max(1, -(-n // shard), -(-tokens // SHARD_TOKENS))
    return items.select(*names).repartition(shards).mapInArrow(tidied(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """packed pieces with ids -> sequence_id, ids (binary) of each sequence; a group is one sequence, of bounded size."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs with their places. Texts are tokenised once, into a table of pieces that stays in the shared folder."""
    return pack(stored(pieces(docs, path, capacity, with_ids), "pieces"), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
