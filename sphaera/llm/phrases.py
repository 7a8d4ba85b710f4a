"""Phrase collocation mining with dictionary-encoded words and fixed-width keys.

One pass cuts texts into pieces and words and writes shards of SHARD words at most: the words as numbers of the shard's own dictionary, and that
dictionary with its counts. Counts of equal words are added up over the shards; the frequent ones get dense ids, and each shard learns the
ids of its own words only, so no task holds the dictionary of the corpus. All other words break their pieces.

Then phrases grow level by level, two to LONGEST words. A shard numbers the frequent shorter phrases that it holds, makes the pairs that overlap, sorts
the packed pairs by radix and counts runs; each different phrase becomes one key of 16 bytes (four ids, big-endian). A shard cuts its keys into ranges
of their mixed bits, a row of arrays for each range; rows of a range meet in a task, which sorts the keys by radix, adds up runs of equal ones
and tells the shards which of their phrases are frequent, and how often they come. A phrase whose parts aren't frequent is never made, which loses
nothing, as no phrase comes more often than its parts.

So a shard that holds a phrase knows the counts of all its parts, and the first one to hold it scores it, with no join. It also says which
phrases that one covers. Both go by ranges of mixed keys once more: a task drops what is covered and puts out the best of each lang.

A shard may end anywhere: the next one begins with up to LONGEST - 1 words of it, and phrases that lie within this lead aren't counted again.

Nulls and edges: a null text is empty, a null lang is `und`; other columns are not read; equal rows count each; the byte 0xFF, which isn't UTF-8, parts
pieces; of phrases with equal scores and counts the smaller one in UTF-8 order is first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Steps, before_ranges, in_ranges, join_unique, read, stored, tidy, utf8

LEAST, MOST, LONGEST, SCALE, COVERED = 30, 2000, 4, 2_000_000, 80
#: Words of a shard, and the bits of a word's number in it: three of them fit a 64-bit code.
SHARD, BITS = 1 << 20, 21
#: A long text is read in slices of about so many bytes, which end at breaks or white space.
SLICE = 1 << 22
_BREAK = b"\xff"
_SIGNS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + 10 * _BREAK + b" ")
KEY = 4 * LONGEST
_LAST = np.uint64((1 << BITS) - 1)
#: Keys are dealt to 2^BUCKETS buckets, which are counted in lots of about LOT rows; scored ones, which are fewer, to 2^SCORED_BUCKETS.
BUCKETS, SCORED_BUCKETS, LOT = 13, 10, 1 << 19


class _Shard:
    """Words of each lang, numbered from 1 as they come; 0 is a break."""

    def __init__(self, lead: list[tuple[str, bytes]]) -> None:
        self.words: list[tuple[str, bytes]] = []
        self.langs: dict[str, dict[bytes, int]] = {}
        self.numbers: list[np.ndarray] = []
        self.size, self.lead = 0, len(lead)
        for lang, word in lead:
            self.add([word], lang)

    def add(self, words: list[bytes], lang: str) -> None:
        own, numbers = self.langs.setdefault(lang, {_BREAK: 0}), []
        for w in words:
            k = own.get(w)
            if k is None:
                self.words.append((lang, w))
                k = own[w] = len(self.words)
            numbers.append(k)
        self.numbers.append(np.array(numbers, np.uint32))
        self.size += len(numbers)

    def rows(self, shard: int) -> pa.RecordBatch:
        """The shard's words with their counts, and in a row of its own the numbers, its langs and which of them a number's word is of."""
        numbers = np.concatenate([np.empty(0, np.uint32), *self.numbers])
        counts = np.bincount(numbers[self.lead :], minlength=len(self.words) + 1)[1:]
        n = len(self.words)
        lang, word = zip(*self.words, strict=True) if n else ((), ())
        which = pa.array(lang, pa.string()).dictionary_encode()
        of = np.append(0, which.indices.to_numpy()).astype(np.uint32)
        columns = [
            pa.array(np.full(n + 1, shard)),
            pa.array([*lang, None], pa.string()),
            pa.array([*word, None], pa.binary()),
            pa.array(np.append(np.arange(1, n + 1), 0).astype(np.int64)),
            pa.array(np.append(counts, self.lead).astype(np.int64)),
            pa.array([None] * n + [numbers.tobytes()], pa.binary()),
            pa.array([None] * n + [which.dictionary.to_pylist()], pa.list_(pa.string())),
            pa.array([None] * n + [of.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "word", "code", "n", "numbers", "langs", "lang_of"])


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with a break between pieces and at its end."""
    text = text.translate(_SIGNS)
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            cuts = [k for k in (text.find(b" ", at + SLICE), text.find(_BREAK, at + SLICE)) if k >= 0]
            end = min(cuts, default=end)
        yield text[at:end].replace(_BREAK, b" \xff ").split()
        at = end
    yield [_BREAK]


def encode(docs: DataFrame, shard: int) -> DataFrame:
    """docs (lang, text) -> a row for each shard and word: shard, lang, word, code (its number), n; and one for each shard with its
    numbers, langs (a list), lang_of (places in it by a word's number), and in n its lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made, held = TaskContext.get().partitionId() << 24, 0, _Shard([])
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                for words in _slices(text) if text else ():
                    at = 0
                    while at < len(words):
                        room = shard - (held.size - held.lead)
                        held.add(words[at : at + room], lang)
                        at += room
                        if held.size - held.lead >= shard:
                            tail = np.concatenate(held.numbers[-LONGEST:])[1 - LONGEST :]
                            tail = tail[len(tail) - np.argmin(np.append(tail[::-1], 0)) :]  # what follows the last break
                            lead = [held.words[k - 1] for k in tail.tolist()]
                            yield held.rows(first + made)
                            made, held = made + 1, _Shard(lead)
        if held.size > held.lead:
            yield held.rows(first + made)

    return docs.select(F.coalesce("lang", F.lit("und")), "text").mapInArrow(run, "shard long, lang string, word binary, code long, n long, numbers binary, langs array<string>, lang_of binary")


def radix_order(codes: np.ndarray) -> np.ndarray:
    """The order of unsigned codes: stable passes over their 16-bit digits from the last on, which numpy sorts by radix."""
    order, bits = np.arange(len(codes)), int(codes.max()).bit_length() if len(codes) else 0
    for shift in range(0, bits, 16):
        digit = (codes[order] >> np.uint64(shift)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and how often each comes."""
    codes = codes[radix_order(codes)]
    start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[start], np.diff(np.append(start, len(codes)))


def _keys(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """Four ids in two numbers as a binary column of KEY bytes a row."""
    n, rows = len(high), np.stack([high, low], 1).astype(">u8")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, KEY * (n + 1), KEY, dtype=np.int32)), pa.py_buffer(rows.tobytes())])


def _cells(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """Values as a binary column whose rows begin at the places `start`."""
    ends = (np.append(start, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def _values(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of _cells(), and how many a row has."""
    values, sizes = [], []
    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(x):
            at = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset).astype(np.int64)
            size = np.dtype(kind).itemsize
            sizes.append(np.diff(at) // size)
            values.append(np.frombuffer(x.buffers()[2] or b"", np.uint8, at[-1] - at[0], at[0]).view(kind))
    return np.concatenate([np.empty(0, kind), *values]), np.concatenate([np.empty(0, np.int64), *sizes])


def pairs(numbers: np.ndarray, lead: int, words: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the phrases of `words` words in a shard whose two parts without the last and without the first word are among the frequent ones
    (codes, in order): the codes of both parts and the counts."""
    numbers = numbers.astype(np.uint64)
    size = len(numbers) - words + 2  # places of the parts
    if size < 2 or not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    part = np.zeros(size, np.uint64)
    for i in range(words - 1):
        part = part << np.uint64(BITS) | numbers[i : i + size]
    at = np.minimum(np.searchsorted(codes, part), len(codes) - 1)
    frequent = codes[at] == part
    both = frequent[:-1] & frequent[1:]
    base = np.uint64(len(codes))
    packed = at[:-1].astype(np.uint64) * base + at[1:].astype(np.uint64)
    pair, n = runs(packed[both])
    # Those within the lead were counted in the shard before; longer ones are still made of them here.
    again = packed[: max(0, lead - words + 1)][both[: max(0, lead - words + 1)]]
    np.subtract.at(n, np.searchsorted(pair, again), 1)
    return codes[(pair // base).astype(np.int64)], codes[(pair % base).astype(np.int64)], n


def _bucket(high: np.ndarray, low: np.ndarray | None, bits: int) -> np.ndarray:
    mixed = high * np.uint64(0x9E3779B97F4A7C15)
    if low is not None:
        mixed ^= low * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.uint16)


PACKED = "bucket int, shard long, high binary, low binary, code binary, n binary"


def _pack(shard: int, high: np.ndarray, low: np.ndarray | None, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Phrases of a shard by the bucket of their key, a row for each: keys that are equal meet in a bucket. Pairs have no second half."""
    bucket = _bucket(high, low, BUCKETS)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    columns = [
        pa.array(bucket[start].astype(np.int32)),
        pa.array(np.full(len(start), shard, np.int64)),
        _cells(high[order], start),
        pa.nulls(len(start), pa.binary()) if low is None else _cells(low[order], start),
        _cells(code[order], start),
        _cells(n[order].astype(np.int64), start),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "shard", "high", "low", "code", "n"])


def _made(shards: DataFrame, parts: DataFrame | None, words: int) -> DataFrame:
    """shards (shard, lead, numbers, ids; a row for each) and the codes of their frequent phrases of a word less (shard, codes; none: words) -> PACKED, the phrases of
    `words` words."""

    def phrases(shard: pa.Table | pa.RecordBatch, codes: np.ndarray) -> pa.RecordBatch:
        numbers, ids = (np.frombuffer(shard.column(c)[0].as_buffer(), np.uint32) for c in ("numbers", "ids"))
        one, two, n = pairs(numbers, shard.column("lead")[0].as_py(), words, codes)
        last = two & _LAST
        key = np.zeros((LONGEST, len(one)), np.uint64)
        for i in range(words - 1):
            key[i] = ids[(one >> np.uint64(BITS * (words - 2 - i)) & _LAST).astype(np.int64)]
        key[words - 1] = ids[last.astype(np.int64)]
        half = np.uint64(32)
        low = None if words == 2 else key[2] << half | key[3]
        # A code of LONGEST words doesn't fit and isn't needed.
        code = one << np.uint64(BITS) | last if words < LONGEST else np.zeros(len(one), np.uint64)
        return _pack(shard.column("shard")[0].as_py(), key[0] << half | key[1], low, code, n)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = b.slice(i, 1)
                yield phrases(shard, np.flatnonzero(np.frombuffer(shard.column("ids")[0].as_buffer(), np.uint32)).astype(np.uint64))

    def of_phrases(shard: pa.Table, codes: pa.Table) -> pa.Table:
        if not shard.num_rows or not codes.num_rows:
            return pa.Table.from_batches([_pack(0, *(np.empty(0, np.uint64) for _ in range(4)))])
        found = _values(codes.column("codes"), np.uint64)[0]
        return pa.Table.from_batches([phrases(shard, found[radix_order(found)])])

    shards = shards.select("shard", "lead", "numbers", "ids")
    if parts is None:
        return shards.mapInArrow(of_words, PACKED)
    return shards.groupBy("shard").cogroup(parts.select(F.col("shard").alias("of"), "codes").groupBy("of")).applyInArrow(of_phrases, PACKED)


def _lots(batches: Iterator[pa.RecordBatch], sized: str) -> Iterator[pa.Table]:
    """Rows sorted by bucket in lots of whole buckets, of about LOT values in the column `sized`."""
    held, size, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        bucket = b.column(0).to_numpy()
        before = np.append(0, np.cumsum(_values(b.column(b.schema.get_field_index(sized)), np.uint64)[1]))
        at = 0
        for edge in np.flatnonzero(np.append(bucket[0] != last, bucket[1:] != bucket[:-1])).tolist():
            if size + before[edge] - before[at] >= LOT:
                yield pa.Table.from_batches([*held, b.slice(at, edge - at)])
                held, size, at = [], 0, edge
        held.append(b.slice(at))
        size, last = size + int(before[-1] - before[at]), bucket[-1]
    if held:
        yield pa.Table.from_batches(held)


def _sums(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """PACKED sorted by bucket -> lots of some buckets each: shard, code, high, low, f, first of the rows whose keys come `least` times or more, by shard."""

    def count(t: pa.Table) -> tuple[np.ndarray, ...]:
        high, sizes = _values(t.column("high"), np.uint64)
        low, code, n = _values(t.column("low"), np.uint64)[0], _values(t.column("code"), np.uint64)[0], _values(t.column("n"), np.int64)[0]
        order = radix_order(low) if len(low) else np.arange(len(high))
        order = order[radix_order(high[order])]
        low = low if len(low) else np.zeros(len(high), np.uint64)
        a, b = high[order], low[order]
        start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        f = np.add.reduceat(n[order], start)
        often = f >= least
        on = order[np.repeat(often, np.diff(np.append(start, len(order))))]
        first = np.zeros(len(high), bool)
        first[order[start[often]]] = True
        f = np.repeat(f[often], np.diff(np.append(start, len(order)))[often])
        shard = np.repeat(t.column("shard").to_numpy(), sizes)[on]
        by = radix_order(shard.astype(np.uint64))
        on = on[by]
        return shard[by], code[on], high[on], low[on], f[by], first[on]

    yield from map(count, _lots(batches, "code"))


def _buckets(packed: DataFrame) -> DataFrame:
    return packed.repartition("bucket").sortWithinPartitions("bucket")


def _counted(made: DataFrame, least: int) -> DataFrame:
    """made (key, shard, code, n) -> the same rows with f, the sum of n over their key, if that is `least` or more; first: one row of each key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _values(b.column(0), np.dtype(">u8"))[0].astype(np.uint64).reshape(-1, 2)
            shard, code, n = (b.column(i).to_numpy() for i in (1, 2, 3))
            for x in np.unique(shard):
                own = shard == x
                yield _pack(x, key[own, 0], key[own, 1], code[own].astype(np.uint64), n[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, code, high, low, f, first in _sums(batches, least):
            columns = [_keys(high, low), pa.array(f), pa.array(shard), pa.array(code.astype(np.int64)), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "f", "shard", "code", "first"])

    packed = made.select("key", "shard", "code", "n").mapInArrow(pack, PACKED)
    return _buckets(packed).mapInArrow(run, "key binary, f long, shard long, code long, first boolean")


def _often(packed: DataFrame, least: int) -> DataFrame:
    """PACKED -> rows of a shard and lot: shard, codes and counts of the phrases that come `least` times or more, and keys and f of those that this row
    is the first to hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, code, high, low, f, first in _sums(batches, least):
            start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.empty(0, np.int64)
            firsts = np.append(0, np.cumsum(first))[start]
            keys = np.stack([high[first], low[first]], 1).astype(">u8")
            bytes_ = _cells(keys.reshape(-1), firsts * 2)
            columns = [pa.array(shard[start]), _cells(code, start), _cells(f, start), bytes_, _cells(f[first], firsts)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "codes", "counts", "keys", "f"])

    return _buckets(packed).mapInArrow(run, "shard long, codes binary, counts binary, keys binary, f binary")


def _found(often: DataFrame) -> DataFrame:
    """key, f of each phrase of _often()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _values(b.column(0), np.dtype(">u8"))[0].reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([_keys(key[:, 0], key[:, 1]), pa.array(_values(b.column(1), np.int64)[0])], names=["key", "f"])

    return often.select("keys", "f").mapInArrow(run, "key binary, f long")


def _with_ids(numbers: DataFrame, own: DataFrame) -> DataFrame:
    """numbers (shard, n, numbers, langs, lang_of) and the frequent words of shards (of, code, id, f) -> a row for each shard: shard, lead, numbers, langs,
    lang_of, and ids and counts, by a word's number (0: not frequent)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = left.column("numbers")[0].as_py() if left.num_rows else b""
        held = np.frombuffer(numbers, np.uint32)
        ids = np.zeros(int(held.max()) + 1 if len(held) else 0, np.uint32)
        counts = np.zeros(len(ids), np.int64)
        if left.num_rows:
            code = right.column("code").to_numpy()
            ids[code], counts[code] = right.column("id").to_numpy(), right.column("f").to_numpy()
        columns = [left.column(c) for c in ("shard", "n", "numbers", "langs", "lang_of")] + [pa.array([x.tobytes()] * left.num_rows, pa.binary()) for x in (ids, counts)]
        return pa.table(columns, names=["shard", "lead", "numbers", "langs", "lang_of", "ids", "counts"])

    schema = "shard long, lead long, numbers binary, langs array<string>, lang_of binary, ids binary, counts binary"
    return numbers.groupBy("shard").cogroup(own.groupBy("of")).applyInArrow(run, schema)


def _score(a: np.ndarray, both: np.ndarray) -> np.ndarray:
    """SCALE * a // both in two steps: exact up to 2^63 / 2000 occurrences."""
    whole, rest = np.divmod(a * (SCALE // 1000), both)
    return whole * 1000 + rest * 1000 // both


RATED = "bucket int, lang string, high binary, low binary, a binary, l binary, r binary"


def _rated(coded: DataFrame, often: list[DataFrame], covered: int) -> DataFrame:
    """RATED, a row for each shard, lang and bucket: the phrases of _often() with the counts of their lowest-scoring cut, from the shard that is the first to
    hold them; and without a lang (a, l and r are 0) those that one of them covers."""

    def run(shard: pa.Table, parts: pa.Table) -> pa.Table:
        rows = []
        if shard.num_rows and parts.num_rows:
            ids, of = (np.frombuffer(shard.column(c)[0].as_buffer(), np.uint32) for c in ("ids", "lang_of"))
            by_id = np.argsort(ids, kind="stable")
            tables = {1: (np.arange(len(ids)), np.frombuffer(shard.column("counts")[0].as_buffer(), np.int64))}

            def count(number: np.ndarray) -> np.ndarray:
                code = np.zeros(len(number), np.uint64)
                for i in range(number.shape[1]):
                    code = code << np.uint64(BITS) | number[:, i].astype(np.uint64)
                codes, counts = tables[number.shape[1]]
                return counts[np.searchsorted(codes, code)]

            def put(lang: np.ndarray, key: np.ndarray, *counts: np.ndarray) -> None:
                key = np.pad(key, ((0, 0), (0, LONGEST - key.shape[1]))).astype(np.uint64)
                rows.append((lang, *(key[:, i] << np.uint64(32) | key[:, i + 1] for i in (0, 2)), *counts))

            for m in range(2, LONGEST + 1):
                level = parts.filter(pc.equal(parts.column("words"), m))
                if m < LONGEST:  # no phrase is a part of the longest ones'
                    codes, counts = _values(level.column("codes"), np.uint64)[0], _values(level.column("counts"), np.int64)[0]
                    order = radix_order(codes)
                    tables[m] = codes[order], counts[order]
                key = _values(level.column("keys"), np.dtype(">u4"))[0].astype(np.uint32).reshape(-1, LONGEST)[:, :m]
                a = _values(level.column("f"), np.int64)[0]
                number = by_id[np.searchsorted(ids, key, sorter=by_id)]
                least = left = right = None
                for k in range(1, m):
                    l, r = count(number[:, :k]), count(number[:, k:])  # noqa: E741
                    score = _score(a, l + r)
                    if least is None:
                        least, left, right = score, l, r
                    lower = score < least
                    least, left, right = np.where(lower, score, least), np.where(lower, l, left), np.where(lower, r, right)
                put(of[number[:, 0]].astype(np.int64), key, a, left, right)
                # A phrase's parts of a word less: those that are shorter lie in one of them, which comes at least as often.
                for i in (0, 1) if m > 2 else ():
                    hit = 100 * a >= covered * count(number[:, i : i + m - 1])
                    none = np.zeros(np.count_nonzero(hit), np.int64)
                    put(none - 1, key[hit, i : i + m - 1], none, none, none)
        lang, high, low, a, l, r = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64), *np.empty((2, 0), np.uint64), *np.empty((3, 0), np.int64))  # noqa: E741
        bucket = _bucket(high, low, SCORED_BUCKETS)
        order = np.lexsort((bucket, lang))
        lang, bucket = lang[order], bucket[order]
        start = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1]))) if len(lang) else np.empty(0, np.int64)
        names = [*(shard.column("langs")[0].as_py() if len(lang) else ()), None]  # -1 is the last
        columns = [pa.array(bucket[start].astype(np.int32)), pa.array([names[i] for i in lang[start]], pa.string()), *(_cells(x[order], start) for x in (high, low, a, l, r))]
        return pa.table(columns, names=["bucket", "lang", "high", "low", "a", "l", "r"])

    parts = None
    for m, x in enumerate(often, 2):
        codes = [F.col(c) if m < LONGEST else F.lit(None).cast("binary").alias(c) for c in ("codes", "counts")]
        x = x.select(F.col("shard").alias("of"), F.lit(m).alias("words"), *codes, "keys", "f")
        parts = x if parts is None else parts.unionByName(x)
    return coded.select("shard", "langs", "lang_of", "ids", "counts").groupBy("shard").cogroup(parts.groupBy("of")).applyInArrow(run, RATED)


def _best(rated: DataFrame, most: int) -> DataFrame:
    """_rated() -> key, lang, a, l, r, score of the phrases that none covers: of each task the first `most` of a lang by score and a, with ties."""

    def best(lang: np.ndarray, score: np.ndarray, a: np.ndarray) -> np.ndarray:
        order = np.lexsort((-a, -score, lang))
        lang, score, a = lang[order], score[order], a[order]
        start = np.flatnonzero(np.append(True, lang[1:] != lang[:-1])) if len(lang) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(lang)))
        last = np.repeat(start + np.minimum(size, most) - 1, size)
        return order[(score > score[last]) | (score == score[last]) & (a >= a[last])]

    def left(t: pa.Table, names: dict[str | None, int]) -> tuple[np.ndarray, ...]:
        high, sizes = _values(t.column("high"), np.uint64)
        low, a, l, r = (_values(t.column(c), k)[0] for c, k in (("low", np.uint64), ("a", np.int64), ("l", np.int64), ("r", np.int64)))  # noqa: E741
        lang = np.repeat(np.array([names.setdefault(x, len(names)) for x in t.column("lang").to_pylist()], np.int64), sizes)
        order = radix_order(low)
        order = order[radix_order(high[order])]
        x, y = high[order], low[order]
        start = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        free = np.minimum.reduceat(a[order], start) > 0
        on = order[np.repeat(free, np.diff(np.append(start, len(order))))]
        return lang[on], _score(a[on], l[on] + r[on]), a[on], l[on], r[on], high[on], low[on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = {}, None
        for lot in _lots(batches, "a"):
            new = left(lot, names)
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            on = best(*held[:3])
            held = tuple(x[on] for x in held)
        if held is not None:
            lang, score, a, l, r, high, low = held  # noqa: E741
            columns = [_keys(high, low), pa.array(list(names), pa.string()).take(pa.array(lang)), *map(pa.array, (a, l, r, score))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "a", "l", "r", "score"])

    return _buckets(rated).mapInArrow(run, "key binary, lang string, a long, l long, r long, score long")


def _word_key(i: Column) -> Column:
    return F.rpad(F.unhex(F.lpad(F.hex(i), 8, "0")), KEY, F.unhex(F.lit("00")))


def _part(key: Column, start: Column, words: Column) -> Column:
    """Words of a key, as a key: `words` of them from `start` (from 0) on."""
    return F.rpad(F.substring(key, start * 4 + 1, words * 4), KEY, F.unhex(F.lit("00")))


def _levels(docs: DataFrame, steps: Steps, least: int, shard: int) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Frequent words (id, key, lang, word, f), totals (lang, n) of all words, the shards of _with_ids() and _often() of the phrases of 2 to LONGEST words."""
    shards = steps.stored(encode(docs, shard), "shards")
    own = shards.where("word IS NOT NULL").select("shard", "lang", "word", "code", "n")
    totals = steps.stored(own.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    n = steps.stored(totals.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    ranges = in_ranges(totals.where(F.col("f") >= least), F.col("lang"), F.col("word"))
    numbered = before_ranges(ranges, {"rows": F.count("*")})
    place = F.coalesce("__before_rows", F.lit(0)) + F.col("__i") + 1
    words = steps.stored(numbered.select(place.alias("id"), "lang", "word", "f").withColumn("key", _word_key(F.col("id"))), "dictionary")
    if words.count() >= 1 << 32:
        raise ValueError("more frequent words than a key has room for")
    steps.forget(totals)
    known = own.join(words, ["lang", "word"]).select(F.col("shard").alias("of"), "code", "id", "f")
    coded = steps.stored(_with_ids(shards.where("numbers IS NOT NULL").select("shard", "n", "numbers", "langs", "lang_of"), known), "coded")
    steps.forget(shards)
    often = []
    for m in range(2, LONGEST + 1):
        often.append(steps.stored(_often(_made(coded, often[-1] if often else None, m), least), "often"))
    return words, n, coded, often


def frequent(docs: DataFrame, steps: Steps, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (id, key, lang, word, f), phrases (key, words, f) that come `least` times or more, and totals (lang, n) of all words, as rows; top_phrases()
    needs no such rows."""
    with tidy(docs.sparkSession):
        words, n, _, often = _levels(docs, steps, least, shard)
    phrases = None
    for m, x in enumerate(often, 2):
        x = _found(x).select("key", F.lit(m).alias("words"), "f")
        phrases = x if phrases is None else phrases.unionByName(x)
    return words, phrases, n


def _cut(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows (key, words, a, k) with the lang, l, r and score of their cut after k words."""
    cuts = rows.withColumns({"one": _part(F.col("key"), F.lit(0), F.col("k")), "two": _part(F.col("key"), F.col("k"), F.col("words") - F.col("k"))})
    cuts = join_unique(cuts, parts.select(F.col("key").alias("one"), F.col("f").alias("l"), "lang"), "one")
    cuts = join_unique(cuts, parts.select(F.col("key").alias("two"), F.col("f").alias("r")), "two")
    # Decimals are exact where the product passes 64 bits.
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * {SCALE} div CAST(l + r AS DECIMAL(20, 0))")
    return cuts.withColumn("score", score).select("key", "words", "a", "lang", "score", "k", "l", "r")


def scored(words: DataFrame, phrases: DataFrame, covered: int = COVERED, most: int | None = None) -> DataFrame:
    """key, words, a, l, r, score, lang of the phrases of frequent() that no longer one covers, by their lowest-scoring cut; with `most`, of those at
    least that can be among the first `most` of their lang. It joins rows, for those who want all phrases; top_phrases() has them scored in the shards.

    The cut after the first word comes first. It is the only one of pairs, and no phrase scores more than by it: longer ones that are below `most`
    pairs of their lang by it need no other cut."""
    # A phrase's parts of a word less: those that are shorter lie in one of them, which comes at least as often.
    longer = phrases.where("words > 2")
    inner = longer.select(_part(F.col("key"), F.lit(0), F.col("words") - 1).alias("key"), "f").unionByName(longer.select(_part(F.col("key"), F.lit(1), F.col("words") - 1).alias("key"), "f"))
    around = inner.groupBy("key").agg(F.max("f").alias("around"))
    left = phrases.withColumnRenamed("f", "a").join(around, "key", "left").where(f"around IS NULL OR 100 * around < {covered} * a").drop("around")
    parts = words.select("key", "f", "lang").unionByName(phrases.where(f"words < {LONGEST}").select("key", "f", F.lit(None).cast("string").alias("lang")))
    with Steps() as steps:
        first = steps.stored(_cut(left.withColumn("k", F.lit(1)), parts), "first")
        if most is not None:
            near = Window.partitionBy("lang").orderBy(F.desc("score"))
            best = first.where("words = 2").withColumn("near", F.row_number().over(near)).where(f"near <= {most}")
            least = best.groupBy("lang").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(f"n = {most}").select("lang", "least")
            first = first.join(F.broadcast(least), "lang", "left").where("least IS NULL OR score >= least").drop("least").select(first.columns)
        more = first.where("words > 2").select("key", "words", "a", F.explode(F.expr("sequence(2, words - 1)")).alias("k"))
        cuts = first.unionByName(_cut(more, parts))
        lowest = cuts.groupBy("key", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"), F.max("lang").alias("lang"))
        return stored(lowest.select("key", "words", "a", "x.l", "x.r", "x.score", "lang"), "scored")


def top_phrases(docs: DataFrame, least: int = LEAST, most: int = MOST, covered: int = COVERED, shard: int = SHARD) -> DataFrame:
    """docs (lang, text) -> the first `most` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    with Steps() as steps, tidy(docs.sparkSession):
        words, n, coded, often = _levels(docs, steps, least, shard)
        rated = steps.stored(_best(_rated(coded, often, covered), most), "rated")
        # What can't be among the first by counts of ranges of scores, of which a lang has about a thousand, goes before the window.
        step = F.floor(F.sqrt("score"))
        counts = rated.groupBy("lang", step.alias("step")).agg(F.count("*").alias("rows"))
        above = F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("step")))
        reached = counts.withColumn("above", above).where(f"above >= {most}").groupBy("lang").agg(F.max("step").alias("least"))
        can = rated.join(F.broadcast(reached), "lang", "left").where(F.col("least").isNull() | (step >= F.col("least")))
        # Ties at the end are kept until their words are known.
        near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        top = can.withColumn("words", F.expr(" + ".join(f"int(substring(key, {4 * i + 1}, 4) <> unhex('00000000'))" for i in range(LONGEST))))
        top = top.withColumn("near", F.rank().over(near)).where(f"near <= {most}")
        at = F.explode(F.expr("sequence(0, words - 1)"))
        spelt = top.select("*", at.alias("i")).withColumn("id", F.conv(F.hex(F.substring("key", F.col("i") * 4 + 1, F.lit(4))), 16, 10).cast("long"))
        spelt = spelt.join(words.select("id", F.col("word").cast("string").alias("word")), "id")
        phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
        spelt = spelt.groupBy("key", "lang", "a", "l", "r", "score").agg(phrase.alias("phrase"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        out = spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(f"rank <= {most}").join(n, "lang")
        return stored(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(read(spark, sf_dir, "documents"))


QUERIES = {"op12_phrases": op12_phrases}
ORACLES = {
    "op12_phrases": """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
e AS (SELECT lang, piece, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
i AS (SELECT lang, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o] AS w FROM e WINDOW o AS (PARTITION BY piece ORDER BY i)),
g AS MATERIALIZED (SELECT lang, m, array_to_string(w[:m], ' ') AS g, count(*) AS f FROM i, (VALUES (1), (2), (3), (4)) AS t(m) WHERE w[m] IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, g, string_split(g, ' ') AS v, f AS a FROM g WHERE m > 1 AND f >= 30),
s AS (SELECT lang, array_to_string(v[x.s:x.s + x.m - 1], ' ') AS g, max(a) AS around FROM c, (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) AS x(s, m) WHERE x.m < c.m AND x.s + x.m - 1 <= c.m GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN s USING (lang, g) WHERE around IS NULL OR 100 * around < 80 * a),
t AS MATERIALIZED (SELECT d.*, k, array_to_string(v[1:k], ' ') AS one, array_to_string(v[k + 1:], ' ') AS two FROM d, (VALUES (1), (2), (3)) AS t(k) WHERE k < m),
k AS (SELECT t.lang, t.g, t.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * t.a) // (l.f + r.f) AS score FROM t
  JOIN g AS l ON l.lang = t.lang AND l.g = t.one JOIN g AS r ON r.lang = t.lang AND r.g = t.two),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM b)
SELECT lang, rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN n USING (lang) WHERE rank <= 2000"""
}
