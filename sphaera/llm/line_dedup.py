"""Removal of repeated lines by an exact set-similarity join.

A line (texts are cut at line feeds) is the set of its words. A line goes if an earlier one, by doc_id and line number, has
a Jaccard similarity of THRESHOLD or more with it; lines of equal sets are the common case and are settled by a grouping.

For the others the words of each set are ordered by rarity, rarest first, and only a prefix of them is posted: two sets as
similar as asked for share a word of their prefixes, at places from which enough of both is left (positional filter), and
their sizes differ little (length filter). A set also carries 64 parities of its words' hashes; in how many of them two sets
differ is a lower bound on the words they don't share. Postings travel in blocks by hash of their word, are sorted by word,
and within a word each set is held against the earlier ones until some (FIRST) have passed all filters, so that a family of
thousands of near copies costs each member a few looks and no list of all its pairs is ever made. Candidates are verified
on the hashes (64 bits) of all their words; of large sets, 1024 parities are compared before. A set whose first candidates all fail and that had more is looked at again, against all. The lines
themselves travel in the same blocks, by hash of their sets, once for each set and run of texts: the copies in a run are
known to be copies without meeting the others.

Rarity is a table of TABLE counts by hash, of fixed size whatever the corpus: any order that all tasks share gives the same
result. A word whose count is 1 occurs nowhere else and needs no posting, and sets too small to be similar to any
but an equal one have none. Texts are hashed many at a time, by numpy.

Hot words: two sets whose rarest common word is hot (a count of HOT or more) have a second common word within their prefixes
lengthened by one, as similar sets of four words or more share two at least. Hot words are therefore posted in pairs with each later word of
the longer prefix, which parts a hot word's list by its companions, and never alone.

Nulls and edges: doc_id may be of any type that sorts; ids that aren't integers are numbered in their order first. A null text has no
lines; lines without words are never removed; a null doc_id comes first; of rows that share doc_id (null included), lines of equal
number and words are the same place and don't remove each other, others do; columns besides doc_id and text
are carried through, n_chars is set anew where there is one; a text whose lines all go is empty; an empty table stays so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, dense, give_back, read, release, scratch, sparse, stored, tidied, tree_sum, utf8

#: The similarity asked for, as a fraction.
THRESHOLD = (4, 5)
TABLE, PARTS = 1 << 22, 32
#: A word that occurs so often is posted in pairs.
HOT = 1 << 16
#: Candidates of a set for a word: at most so many of which few parities differ (TELLING; of sets without a common word half do), and so many in all.
FIRST = (4, 16)
TELLING = 18
#: Sets of more words are verified by parities first.
SHORT = 96
#: Bytes hashed at once, and words of the corpus for each block of postings.
CHUNK, BLOCK_WORDS = 1 << 18, 600_000
#: Bits of the filters of documents and sets that are read again to verify candidates.
FILTER = 1 << 23
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 4096
View = Callable[[bytes], bytes]
_NONE = np.iinfo(np.int64).min  # a null doc_id within postings; it comes first


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK bytes, with the number of the first."""
    held: list[bytes] = []
    at = size = 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size > CHUNK:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of texts, in order: the line they stand in, counted through all texts, and their hash; also each text's first line."""
    buffer = b"\n".join(texts) + b"\n" + bytes(8)
    a = np.frombuffer(buffer, np.uint8, len(buffer) - 8)
    word = ~_SPACE[a]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    feeds = np.flatnonzero(a == 10)
    line = np.searchsorted(feeds, begin)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    first = np.concatenate([[0], np.searchsorted(feeds, ends[:-1])])
    # Eight bytes of every word at a time, those behind its end masked; its length counts too.
    eight = np.ndarray((len(a),), "<u8", buffer, strides=(1,))
    size = end - begin
    h = _mix((eight[begin] & _MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _P))
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < LONG_WORD:
        h[more] = _mix(h[more] * _P + (eight[begin[more] + at] & _MASK[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in more.tolist():
        h[i] = np.uint64(xxhash.xxh64_intdigest(buffer[begin[i] : end[i]]))
    return line, h, first


def rarity(docs: DataFrame, view: View = bytes) -> tuple[np.ndarray, int]:
    """A class of rarity for each hash slot of words (0: once in all docs; then in steps of a fourth of a power of two), and the number of words.

    Each task sends on the slots that it has met; they are summed in a tree, and a byte for each slot comes to the driver."""

    part = TABLE // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scratch("line_dedup")
        total = np.zeros(TABLE, np.uint32)
        for b in batches:
            for _, texts in _chunks(map(view, utf8(b.column(0)))):
                np.add.at(total, (_hashes(texts)[1] % np.uint64(TABLE)).astype(np.int64), np.uint32(1))
        payload = [sparse(total[k * part : (k + 1) * part].astype(np.int64)) for k in range(PARTS)]
        task = np.full(PARTS, TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(task), pa.array(payload, pa.binary())], names=["part", "task", "payload"])

    def add(t: pa.Table) -> pa.Table:
        sums = np.zeros(part, np.int64)
        for x in t.column("payload").to_pylist():
            at, n = dense(x)
            sums[at] += n
        return pa.table({"part": t.column("part")[:1], "payload": pa.array([sparse(sums)], pa.binary())})

    with Steps() as steps:
        parts = steps.stored(docs.select("text").mapInArrow(tidied(run), "part int, task int, payload binary"), "counts")
        out = tree_sum(parts, add, finish=_classes, schema="part int, classes binary, n long").toArrow().sort_by("part")
    if not out.num_rows:
        return np.zeros(TABLE, np.uint8), 0
    return np.frombuffer(b"".join(out.column("classes").to_pylist()), np.uint8), sum(out.column("n").to_pylist())


def _class(count: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(count, 1))) + (count > 1)).astype(np.uint8)


def _classes(row: pa.Table) -> pa.Table:
    at, n = dense(row.column("payload")[0].as_py())
    sums = np.zeros(TABLE // PARTS, np.int64)
    sums[at] = n
    return pa.table({"part": row.column("part"), "classes": pa.array([_class(sums).tobytes()], pa.binary()), "n": pa.array([int(n.sum())], pa.int64())})


class _Sets:
    """The distinct words of each line of some texts: their hashes sorted by line, rarity and hash, and per line its number, start and size."""

    def __init__(self, texts: list[bytes], rare: np.ndarray | None = None) -> None:
        line, code, self.first = _hashes(texts)
        k = rare[(code % np.uint64(TABLE)).astype(np.int64)].astype(np.uint64) if rare is not None else np.zeros(len(code), np.uint64)
        key = (line.astype(np.uint64) << np.uint64(40)) | (k << np.uint64(32)) | (code >> np.uint64(32))
        order = np.argsort(key)
        key, sorted_code = key[order], code[order]
        if ((key[1:] == key[:-1]) & (sorted_code[1:] != sorted_code[:-1])).any():  # half hashes that agree by chance
            order = np.lexsort((code, k, line))
            sorted_code = code[order]
        at = line[order]
        new = np.ones(len(order), bool)
        new[1:] = (at[1:] != at[:-1]) | (sorted_code[1:] != sorted_code[:-1])
        order = order[new]
        self.h, self.rare = code[order], k[order]
        at = line[order]
        self.start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
        self.size = np.diff(np.append(self.start, len(at)))
        self.doc = np.searchsorted(self.first, at[self.start], "right") - 1
        self.line = (at[self.start] - self.first[self.doc]).astype(np.int32)

    def signature(self, kind: int) -> np.ndarray:
        """Half (0 or 1) of a hash of the set."""
        return np.add.reduceat(_mix(self.h * np.uint64(2 * kind + 1) + np.uint64(kind + 1)), self.start).view(np.int64) if len(self.start) else np.empty(0, np.int64)


#: Blocks hold these columns one after the other: postings, and lines.
_POSTING = (("code", np.uint32), ("sa", np.int64), ("doc", np.int64), ("line", np.int32), ("n", np.int32), ("pos", np.int32), ("parity", np.uint64))
_LINE = (("sa", np.int64), ("sb", np.int64), ("doc", np.int64), ("line", np.int32))
_POSTINGS, _LINES, _COPIES = range(3)


def _packed(kind: int, block: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each block: kind, block, n, payload."""
    order = np.argsort(block, kind="stable")
    ends = np.flatnonzero(np.diff(block[order], append=-1)) + 1
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    columns = [c[order] for c in columns]
    payload = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), kind, np.int32)), pa.array(block[order][begins].astype(np.int32)), pa.array((ends - begins).astype(np.int32)), pa.array(payload, pa.binary())], names=["kind", "block", "n", "payload"])


def _unpacked(t: pa.Table, kind: int, layout: tuple) -> dict[str, np.ndarray]:
    parts = []
    for k, n, payload in zip(t.column("kind").to_pylist(), t.column("n").to_pylist(), t.column("payload"), strict=True):
        if k == kind:
            columns, at = [], 0
            for _, dtype in layout:
                columns.append(np.frombuffer(payload.as_buffer(), dtype, n, at))
                at += n * np.dtype(dtype).itemsize
            parts.append(columns)
    return {name: np.concatenate([p[i] for p in parts]) if parts else np.empty(0, dtype) for i, (name, dtype) in enumerate(layout)}


def _blocks(docs: DataFrame, rare: np.ndarray, blocks: int, threshold: tuple[int, int], view: View) -> DataFrame:
    """kind, block, n, payload: postings of the lines' prefixes by block of words, and lines by block of sets."""
    up, down = threshold
    shared = docs.sparkSession.sparkContext.broadcast(rare)
    hot, least = int(_class(np.array([HOT]))[0]), -(-up // (down - up)) if down > up else 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posted: list[list[np.ndarray]] = []
        lined: list[list[np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if any(len(p[0]) for p in posted):
                block, *columns = (np.concatenate(c) for c in zip(*posted, strict=True))
                yield _packed(_POSTINGS, block, columns)
            if lined:
                sa, sb, doc, line = (np.concatenate(c) for c in zip(*lined, strict=True))
                order = np.lexsort((line, doc, sb, sa))
                sa, sb, doc, line = sa[order], sb[order], doc[order], line[order]
                first = np.ones(len(sa), bool)
                first[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
                yield _packed(_LINES, (sa[first] % blocks), [sa[first], sb[first], doc[first], line[first]])
                of = np.flatnonzero(first)[np.cumsum(first) - 1]
                copy = (doc != doc[of]) | (line != line[of])
                if copy.any():
                    yield _packed(_COPIES, np.arange(copy.sum()) % blocks, [sa[copy], sb[copy], doc[copy], line[copy]])

        for b in batches:
            ids = b.column(0).fill_null(_NONE).to_numpy()
            for at, texts in _chunks(map(view, utf8(b.column(1)))):
                s = _Sets(texts, shared.value)
                if not len(s.start):
                    continue
                sa, doc = s.signature(0), ids[s.doc + at]
                order = np.lexsort((s.line, doc, sa))
                once = order[np.concatenate([[True], sa[order][1:] != sa[order][:-1]])]
                prefix = np.zeros(len(sa), np.int64)
                prefix[once] = s.size[once] - -(-up * s.size[once] // down) + 1
                place = np.arange(len(s.rare)) - np.repeat(s.start, s.size)
                posts = (place < np.repeat(prefix, s.size)) & (s.rare > 0) & (np.repeat(s.size, s.size) >= least)
                lined.append([sa, s.signature(1), doc, s.line])
                sets = np.repeat(np.arange(len(sa)), s.size)
                odd = _parity(s)
                single = np.repeat(-(-up * s.size // down) < 2, s.size)  # of which one common word may be enough
                alone, first = np.flatnonzero(posts & ((s.rare < hot) | single)), np.flatnonzero(posts & (s.rare >= hot))
                # A hot word with each one after it, up to the place behind the prefix.
                ahead = np.minimum(prefix[sets[first]], s.size[sets[first]] - 1) - place[first]
                one = np.repeat(first, ahead)
                other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
                keep = np.concatenate([alone, one])
                code = np.concatenate([s.h[alone], _mix(s.h[one] * _P + s.h[other])])
                of = sets[keep]
                row = (code >> np.uint64(32), sa[of], doc[of], s.line[of], s.size[of], place[keep], odd[of])
                posted.append([(code % np.uint64(blocks)).astype(np.int64), *(c.astype(t) for c, (_, t) in zip(row, _POSTING, strict=True))])
                count += len(keep)
                if count > 300_000:
                    yield from flush()
                    posted, lined, count = [], [], 0
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "kind int, block int, n int, payload binary")


def _parity(s: _Sets) -> np.ndarray:
    """Of each set, bit by bit, the parity of the number of words whose hash falls there."""
    return np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), s.h & np.uint64(63)), s.start)


#: What blocks show: pairs, copies (x alone), and members of words whose lists weren't looked through (x alone).
_PAIRS, _COPY, _MEMBERS = range(3)
_FOUND = "what int, xa long, xd long, xl int, ya long, yd long, yl int, code long, n int, parity long"


def _met(code: np.ndarray) -> np.ndarray:
    """Of sorted codes, those that are there more than once."""
    same = np.zeros(len(code) + 1, bool)
    same[1:-1] = code[1:] == code[:-1]
    return same[1:] | same[:-1]


_FOUND_TYPES = pa.schema([("what", pa.int32()), ("xa", pa.int64()), ("xd", pa.int64()), ("xl", pa.int32()), ("ya", pa.int64()), ("yd", pa.int64()), ("yl", pa.int32()), ("code", pa.int64()), ("n", pa.int32()), ("parity", pa.int64())])


def _matcher(threshold: tuple[int, int], first: tuple[int, int]):
    """What a block shows: copies of lines, and for a set the earlier ones of its word that pass all filters, at most as many as `first` says."""
    up, down = threshold

    def alone(what: int, sa: np.ndarray, doc: np.ndarray, line: np.ndarray, code=None, n=None, parity=None) -> pa.Table:
        none = pa.nulls(len(sa), pa.int64())
        more = [none if x is None else pa.array(x) for x in (code, n, parity)]
        return pa.table([pa.array(np.full(len(sa), what, np.int32)), sa, doc, line, none, none, none.cast(pa.int32()), more[0], more[1].cast(pa.int32()), more[2]], schema=_FOUND_TYPES)

    def copies(t: pa.Table) -> pa.Table:
        c, known = _unpacked(t, _LINES, _LINE), _unpacked(t, _COPIES, _LINE)
        order = np.lexsort((c["line"], c["doc"], c["sb"], c["sa"]))
        c = {k: v[order] for k, v in c.items()}
        new = np.ones(len(order), bool)
        new[1:] = (c["sa"][1:] != c["sa"][:-1]) | (c["sb"][1:] != c["sb"][:-1])
        of = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.empty(0, np.int64)
        late = (c["doc"] != c["doc"][of]) | (c["line"] != c["line"][of])
        sa, doc, line = (np.concatenate([c[k][late], known[k]]) for k in ("sa", "doc", "line"))
        return alone(_COPY, sa, doc, line)

    def match(t: pa.Table) -> pa.Table:
        c = _unpacked(t, _POSTINGS, _POSTING)
        # Words with one posting are of no use, and of a set's postings for a word the first stays.
        order = np.argsort(c["code"])
        order = order[_met(c["code"][order])]
        order = order[np.lexsort((c["line"][order], c["doc"][order], c["code"][order]))]
        again = order[np.argsort((c["code"][order].astype(np.uint64) << np.uint64(32)) | (c["sa"][order].view(np.uint64) >> np.uint64(32)), kind="stable")]
        code, sa = c["code"][again], c["sa"][again]
        twin = np.zeros(len(c["code"]), bool)
        twin[again[1:]] = (code[1:] == code[:-1]) & (sa[1:] == sa[:-1])
        order = order[~twin[order]]
        order = order[_met(c["code"][order])]
        c = {k: v[order] for k, v in c.items()}
        code, doc, line, parity = c["code"], c["doc"], c["line"], c["parity"]
        n, pos = c["n"].astype(np.int64), c["pos"].astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
        rank = np.arange(len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code))))
        at, xs, ys = np.flatnonzero(rank > 0), [], []
        strong, hits = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        d = 1
        while len(at):
            x, y = at, at - d
            nx, ny = n[x], n[y]
            need = -(-up * (nx + ny) // (up + down))
            apart = nx + ny - 2 * need
            odd = np.bitwise_count(parity[x] ^ parity[y]).astype(np.int64)
            ok = (down * np.minimum(nx, ny) >= up * np.maximum(nx, ny)) & (np.minimum(nx - pos[x], ny - pos[y]) >= need) & (odd <= apart)
            ok &= (doc[x] != doc[y]) | (line[x] != line[y])
            if ok.any():
                xs.append(x[ok])
                ys.append(y[ok])
                hits[x[ok]] += 1
                strong[x[ok]] += odd[ok] <= TELLING
            d += 1
            at = at[rank[at] >= d]
            at = at[(strong[at] < first[0]) & (hits[at] < first[1])]
        x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (xs, ys))
        none = pa.nulls(len(x), pa.int64())
        pairs = pa.table([pa.array(np.zeros(len(x), np.int32)), c["sa"][x], doc[x], line[x], c["sa"][y], doc[y], line[y], none, none.cast(pa.int32()), none], schema=_FOUND_TYPES)
        # The postings of a word in which a set has stopped early: that set may have to look again. Its own have the code as it is, the others -1 less it.
        stopped = ((strong >= first[0]) | (hits >= first[1])) & (rank > hits)
        group = np.cumsum(rank == 0) - 1
        rows = np.flatnonzero(np.isin(group, group[stopped]))
        own = code[rows].astype(np.int64)
        return pa.concat_tables([pairs, alone(_MEMBERS, c["sa"][rows], doc[rows], line[rows], np.where(stopped[rows], own, -1 - own), n[rows].astype(np.int32), parity[rows].view(np.int64))])

    def both(t: pa.Table) -> pa.Table:
        give_back()  # what the block before took
        return pa.concat_tables([copies(t), match(t)])

    return both


def _filter(values: DataFrame) -> np.ndarray:
    """A bit for each slot that a value of the (long) column v falls into: a filter of fixed size."""
    slots = values.select(F.pmod("v", F.lit(FILTER)).alias("s"))
    bits = slots.groupBy(F.floor(F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s % 64 AS INT))")).alias("b")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)
    out[bits.column("w").to_numpy()] = bits.column("b").to_numpy()
    return out


def _has(filtered: np.ndarray, v: np.ndarray) -> np.ndarray:
    s = v % FILTER
    return (filtered[s >> 6] >> (s & 63)) & 1 == 1


def _place(d: str, l: str) -> str:
    """SQL: a number for a line of a document."""
    return f"CAST((CAST({d} AS DECIMAL(38)) * 31 + {l} * 1000003) % {FILTER} AS BIGINT)"


def _lines_in(filtered: np.ndarray, doc: int, n: int) -> np.ndarray:
    """Which of a document's n lines may be in a filter of _place."""
    first = int(np.fmod(doc * 31, FILTER)) if abs(doc) < 1 << 53 else int(np.sign(doc)) * (abs(doc) * 31 % FILTER)
    v = first + np.arange(n, dtype=np.int64) * 1_000_003
    return _has(filtered, v)


def _where(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Filters of documents and lines for lines (d, l)."""
    return _filter(lines.select(F.col("d").alias("v"))), _filter(lines.select(F.expr(_place("d", "l")).alias("v")))


def _sets_of(docs: DataFrame, pairs: DataFrame, whole: bool, view: View) -> DataFrame:
    """sa, n, words (their hashes) and bits (1024 parities of them) of the sets in pairs, read again from the lines that hold them, which
    filters of fixed size find. Unless asked for whole, sets of more than SHORT words have bits and no words, the others words alone."""
    ends = pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")).union(pairs.select("yd", "yl")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_where(ends))

    def named(ids: list[int], texts: Iterator[bytes], in_lines: np.ndarray) -> Iterator[bytes]:
        for d, t in zip(ids, texts, strict=True):
            parts = t.split(b"\n")
            for k in np.flatnonzero(_lines_in(in_lines, d, len(parts))).tolist():
                yield parts[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_docs, in_lines = shared.value
        for b in batches:
            cut = b.filter(pa.array(_has(in_docs, b.column(0).fill_null(_NONE).to_numpy())))
            ids = cut.column(0).fill_null(_NONE).to_pylist()
            for _, some in _chunks(named(ids, map(view, utf8(cut.column(1))), in_lines)):
                s = _Sets(some)
                if not len(s.start):
                    continue
                long_ = (s.size > SHORT) & (not whole)
                kept = np.where(long_, 0, s.size)
                words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)).astype(np.int32)), pa.array(s.h[~np.repeat(long_, s.size)].view(np.int64)))
                rows = np.cumsum(long_) - 1
                of = np.repeat(np.arange(len(s.size)), s.size)
                odd = np.bincount(rows[of[long_[of]]] * 1024 + (s.h[long_[of]] & np.uint64(1023)).astype(np.int64), minlength=1024 * int(long_.sum())) & 1
                bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
                bits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(long_, 16, 0))).astype(np.int32)), pa.array(bits))
                yield pa.RecordBatch.from_arrays([pa.array(s.signature(0)), pa.array(s.size.astype(np.int32)), words, bits], names=["sa", "n", "words", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "sa long, n int, words array<long>, bits array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, threshold: tuple[int, int], view: View, steps: Steps) -> DataFrame:
    """xa, xd, xl of the later sets of those pairs that are as similar as asked for."""
    up, down = threshold

    def joined(pairs: DataFrame, whole: bool) -> DataFrame:
        w = _sets_of(docs, pairs, whole, view)  # read once: both joins take it from one shuffle
        return pairs.join(w.toDF("xa", "nx", "wx", "bx"), "xa").join(w.toDF("ya", "ny", "wy", "by"), "ya")

    similar = F.expr(f"{down} * size(array_intersect(wx, wy)) >= {up} * (nx + ny - size(array_intersect(wx, wy)))")
    apart = F.expr(f"aggregate(zip_with(bx, by, (a, b) -> bit_count(a ^ b)), 0, (s, x) -> s + x) <= nx + ny - 2 * ceil({up} * (nx + ny) / {up + down})")
    both_long = (F.size("wx") == 0) & (F.size("wy") == 0)
    either_long = (F.size("wx") == 0) | (F.size("wy") == 0)
    # One long and one short set of similar sizes are looked at whole.
    seen = joined(pairs, False).withColumn("sure", ~either_long).where(F.when(both_long, apart).when(either_long, F.lit(True)).otherwise(similar))
    seen = steps.stored(seen.select("xa", "xd", "xl", "ya", "yd", "yl", "sure").distinct(), "seen")
    sure = seen.where("sure").select("xa", "xd", "xl").distinct()
    open_ = seen.where("NOT sure").drop("sure").join(sure.select("xa"), "xa", "left_anti")
    if not open_.limit(1).count():
        return sure
    return steps.stored(sure.union(joined(open_, True).where(similar).select("xa", "xd", "xl")).distinct(), "similar")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id (a long) and text, and for ids that aren't integers the table (doc_id, number) of theirs, numbered in their order."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = stored(ids.withColumn("number", F.monotonically_increasing_id()), "numbers")
    return docs.select("doc_id", "text").join(ids, "doc_id", "left").select(F.col("number").alias("doc_id"), "text"), ids


def repeated(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, view: View = bytes) -> DataFrame:
    """The lines that go: doc_id, line, sa (half of the set's hash, which tells rows of one doc_id apart), each once. view: what texts
    are read as."""
    up, down = threshold
    named = docs.schema["doc_id"]
    docs, numbers = _numbered(docs)
    rare, words = rarity(docs, view)
    blocks = max(1, words // BLOCK_WORDS)
    with Steps() as steps:
        found = steps.stored(_blocks(docs, rare, blocks, threshold, view).groupBy("block").applyInArrow(_matcher(threshold, FIRST), _FOUND), "found")
        release(docs.sparkSession)
        place = ("xa", "ya", "xd", "xl", "yd", "yl")
        pairs = steps.stored(found.where(F.col("what") == _PAIRS).select(*place).dropDuplicates(["xa", "ya"]), "pairs")
        similar = _verified(docs, pairs, threshold, view, steps)
        members = found.where(F.col("what") == _MEMBERS).select("xa", "xd", "xl", "code", "n", "parity")
        again = steps.stored(members.where("code >= 0").join(similar.select("xa"), "xa", "left_anti"), "again")
        if again.limit(1).count():
            # Those whose first candidates have all failed: now with all earlier ones of the words in which there are more. The conditions are
            # part of the join, which makes no row of pairs that fail them.
            others = members.select(F.when(F.col("code") < 0, -1 - F.col("code")).otherwise(F.col("code")).alias("code"), *(F.col(a).alias(b) for a, b in (("xa", "ya"), ("xd", "yd"), ("xl", "yl"), ("n", "m"), ("parity", "odd"))))
            earlier = "(yd < xd OR (yd = xd AND yl < xl))"
            near = f"{down} * least(n, m) >= {up} * greatest(n, m) AND bit_count(parity ^ odd) <= n + m - 2 * ceil({up} * (n + m) / {up + down})"
            rest = again.join(others, "code").where(f"{earlier} AND {near}").select(*place).dropDuplicates(["xa", "ya"]).join(pairs.select("xa", "ya"), ["xa", "ya"], "left_anti")
            similar = similar.union(_verified(docs, steps.stored(rest, "pairs"), threshold, view, steps))
        gone = found.where(F.col("what") == _COPY).select("xa", "xd", "xl").union(similar.select("xa", "xd", "xl"))
        gone = gone.select(F.when(F.col("xd") != _NONE, F.col("xd")).alias("number"), F.col("xl").alias("line"), F.col("xa").alias("sa")).distinct()
        out = stored(gone, "gone")
    release(docs.sparkSession)
    if numbers is None:
        return out.select(F.col("number").cast(named.dataType).alias("doc_id"), "line", "sa")
    return out.join(numbers, "number", "left").select("doc_id", "line", "sa")


def _by_row(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs (__row, __doc, __text), of which many may share an id -> __row, __lines: those that go. Rows are told apart by the words of their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _chunks(utf8(b.column(2))):
                s = _Sets(texts)
                row = pa.array(s.doc + at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(s.line), pa.array(s.signature(0))], names=["__row", "d", "l", "s"])

    schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField("d", docs.schema["__doc"].dataType), T.StructField("l", T.IntegerType()), T.StructField("s", T.LongType())])
    lines = docs.select("__row", "__doc", "__text").mapInArrow(tidied(run), schema)
    here = lines.join(gone, F.col("d").eqNullSafe(gone["doc_id"]) & (F.col("l") == gone["line"]) & (F.col("s") == gone["sa"]), "left_semi")
    return here.groupBy("__row").agg(F.array_sort(F.collect_set("l")).alias("__lines"))


def with_gone(docs: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of docs, and `__lines`: the numbers of a row's lines that go, in order, or null.

    An id that one row alone has takes a list of its own few lines. Rows that share an id are named one by one and written first, so
    that no list grows with their number."""
    shared = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id")), "shared")
    wanted = [f"__c{i}" for i in range(len(columns))]
    docs = docs.select(*(F.col(f"`{c}`").alias(w) for c, w in zip(columns, wanted, strict=True)), F.col("doc_id").alias("__doc"), F.col("text").alias("__text"))
    one = gone.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__d")).agg(F.array_sort(F.collect_set("line")).alias("__lines"))
    if not shared.limit(1).count():
        return docs.join(one, F.col("__doc") == F.col("__d"), "left").select(*wanted, "__lines")
    same = F.col("__doc").eqNullSafe(F.col("__id"))
    few = one.join(shared, F.col("__d") == F.col("__id"), "left_anti")
    plain = docs.join(shared, same, "left_anti").join(few, F.col("__doc") == F.col("__d"), "left").select(*wanted, "__lines")
    odd = stored(docs.join(shared, same, "left_semi").withColumn("__row", F.monotonically_increasing_id()), "sharing")
    return plain.unionByName(odd.join(_by_row(odd, gone), "__row", "left").select(*wanted, "__lines"))


def drop_lines(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs, with docs' columns, without the lines that repeated() names. Rows are joined by id, at every size: as many documents as a
    corpus has may lose lines."""
    gone = repeated(docs, threshold)
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    rows = with_gone(docs, gone, docs.columns)
    schema = T.StructType([T.StructField(f"__c{i}", docs.schema[c].dataType) for i, c in enumerate(docs.columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for t, cut in zip(b.column(text_at).to_pylist(), b.column(len(schema)).to_pylist(), strict=True):
                if t is not None and cut:
                    drop = set(cut)
                    t = "\n".join(p for k, p in enumerate(t.split("\n")) if k not in drop)
                kept.append(t)
            out = list(b.columns[: len(schema)])
            out[text_at] = pa.array(kept, b.schema.field(text_at).type)
            if chars_at is not None:
                out[chars_at] = pa.array([None if t is None else len(t) for t in kept], pa.int64()).cast(b.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(tidied(run), schema).toDF(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(read(spark, sf_dir, "documents"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed and removed_lines of every row of docs."""
    docs = docs.select("doc_id", "text")
    out = with_gone(docs, repeated(docs), ["doc_id"])
    lines = F.coalesce("__lines", F.array().cast("array<int>"))
    return out.select(F.col("__c0").alias("doc_id"), F.size(lines).cast("long").alias("n_removed"), F.array_join(lines, ",").alias("removed_lines"))


#: A plain join of the rarest words of line sets, verified on the whole sets.
_ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(a))) AS k, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
w AS (SELECT doc_id, k, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS ws FROM l),
s AS (SELECT ws, row_number() OVER () AS sid, len(ws) AS n, fst FROM (SELECT ws, min((doc_id, k)) AS fst FROM w WHERE len(ws) > 0 GROUP BY ws)),
x AS (SELECT sid, n, unnest(ws) AS word FROM s), f AS (SELECT word, count(*) AS c FROM x GROUP BY word),
p AS (SELECT sid, n, word, row_number() OVER (PARTITION BY sid ORDER BY c, word) AS i FROM x JOIN f USING (word)),
pre AS (SELECT sid, n, word FROM p WHERE i <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.sid AS a, b.sid AS b FROM pre a JOIN pre b USING (word) WHERE a.sid <> b.sid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
sim AS (SELECT a, min(y.fst) AS fst FROM c JOIN s x ON x.sid = a JOIN s y ON y.sid = b WHERE 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (x.n + y.n) GROUP BY a),
gone AS (SELECT doc_id, w.k FROM w JOIN s ON s.ws = w.ws LEFT JOIN sim ON sim.a = s.sid WHERE s.fst < (doc_id, w.k) OR sim.fst < (doc_id, w.k))
SELECT d.doc_id, count(g.k) AS n_removed, coalesce(string_agg(CAST(g.k AS VARCHAR), ',' ORDER BY g.k), '') AS removed_lines
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id GROUP BY d.doc_id
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": _ORACLE}
