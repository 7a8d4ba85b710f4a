"""Fill-in-middle transformation by a parallel automaton scan.

A text is cut into units (lines by default) and two cuts are drawn from a hash of its id; prefix, middle and suffix then change places, marked by
sentinels. Where units begin, and whether a sentinel stands in the text, is told by finite automata over its UTF-8 bytes. Any chunk of bytes emits,
for each state it may be entered in, the state it is left in (a transition function) and the units that begin in it. Functions compose
associatively, so a prefix scan over chunks gives each one's true entry state and the units before it, and only the chunks that hold a
cut are read again.

The texts of a batch are scanned together, all their chunks side by side (CHUNK bytes each). A giant text, of more than GIANT bytes, is cut into
BLOCK bytes that are spread over tasks as a table: each block emits its function and counts (a few numbers), these are composed per text,
cuts are selected in the blocks that hold them, and the text is put together again from its blocks. Such a group is one row's own text.

Nulls and edges: a null text is empty, a null doc_id hashes as the word null; doc_id may be repeated, each row is transformed by itself; a text that
is empty or holds a sentinel stays plain, as do those that the rate leaves out; bytes that aren't UTF-8 are kept as they are until the text
becomes a string; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, read, stored, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
CHUNK, GIANT, BLOCK = 256, 4 << 20, 1 << 20
#: Bytes of texts that are scanned at once.
AT_ONCE = 1 << 21


class Automaton(NamedTuple):
    """kinds: the class of each byte; step: state and class -> state; begins: state and class -> whether a unit begins at that byte. State 0 is the first."""

    kinds: np.ndarray
    step: np.ndarray
    begins: np.ndarray


def lines() -> Automaton:
    """Units are lines with their line feeds. States: at a line's start, within one."""
    kinds = np.zeros(256, np.uint8)
    kinds[10] = 1
    return Automaton(kinds, np.array([[1, 0], [1, 0]], np.uint8), np.array([[1, 1], [0, 0]], np.uint8))


def words() -> Automaton:
    """Units are words with the white space after them (ASCII's); a text's first unit takes in the white space before it."""
    kinds = np.zeros(256, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 1
    # At the start, in a word, in space after a word, in space at the start.
    return Automaton(kinds, np.array([[1, 3], [1, 2], [1, 2], [1, 3]], np.uint8), np.array([[1, 1], [0, 0], [1, 0], [0, 0]], np.uint8))


UNITS = {"line": lines, "word": words}


def finder(strings: Sequence[str]) -> Automaton:
    """Whether any of the strings stands in a text: the states are what of them has been read; the last one, which is never left, is found."""
    wanted = [s.encode() for s in strings]
    letters = sorted({b for w in wanted for b in w})
    kinds = np.zeros(256, np.uint8)
    kinds[letters] = range(1, len(letters) + 1)
    heads = sorted({w[:i] for w in wanted for i in range(len(w))}, key=lambda h: (len(h), h))
    found, place = len(heads), {h: i for i, h in enumerate(heads)}
    step = np.zeros((found + 1, len(letters) + 1), np.uint8)
    step[found] = found
    for h, i in place.items():
        for k, b in enumerate(letters, 1):
            read_ = h + bytes([b])
            if any(read_.endswith(w) for w in wanted):
                step[i, k] = found
            else:
                step[i, k] = next(place[read_[j:]] for j in range(len(read_) + 1) if read_[j:] in place)
    return Automaton(kinds, step, np.zeros_like(step))


def functions(chunks: np.ndarray, sizes: np.ndarray, a: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """chunks (place, chunk) of bytes, sizes of the chunks -> the state each is left in and the units that begin in it, for every entry state."""
    states = len(a.step)
    state = np.repeat(np.arange(states, dtype=np.uint8)[:, None], chunks.shape[1], 1)
    begun = np.zeros(state.shape, np.int64)
    step, begins, width = a.step.ravel(), a.begins.ravel(), a.step.shape[1]
    counts = bool(begins.any())
    full = int(sizes.min()) if len(sizes) else 0
    for i in range(chunks.shape[0]):
        at = state.astype(np.intp) * width + a.kinds[chunks[i]]
        new = step[at]
        if i < full:
            state = new
            if counts:
                begun += begins[at]
        else:  # some chunks have ended
            on = sizes > i
            state = np.where(on, new, state)
            if counts:
                begun += begins[at] * on
    return state, begun


def compose(state: np.ndarray, begun: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions of chunks in a row (entry state, chunk), composed from the first chunk of each text on by a scan of doubling strides: the function
    and the units of all of a text up to and with each chunk. first: place of the first chunk of each chunk's text."""
    state, begun = state.copy(), begun.copy()
    here, stride = np.arange(state.shape[1]), 1
    while (on := here[here - stride >= first]).size:
        before = on - stride
        middle = state[:, before]
        added = begun[:, before] + begun[middle, on]
        state[:, on], begun[:, on] = state[middle, on], added
        stride *= 2
    return state, begun


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers from the hash of seed and id."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def _cut(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """data as chunks (place, chunk) of `size` bytes, and their sizes."""
    n = -(-len(data) // size)
    whole = np.zeros(n * size, np.uint8)
    whole[: len(data)] = data
    sizes = np.full(n, size)
    if n:
        sizes[-1] = len(data) - (n - 1) * size
    return np.ascontiguousarray(whole.reshape(n, size).T), sizes


def _place(chunk: np.ndarray, state: int, wanted: int, a: Automaton) -> int:
    """Where unit number `wanted` (from 0) of a chunk that is entered in `state` begins."""
    for i, kind in enumerate(a.kinds[chunk].tolist()):
        if a.begins[state, kind]:
            if wanted == 0:
                return i
            wanted -= 1
        state = int(a.step[state, kind])
    raise ValueError("fewer units than asked for")


class Scan:
    """A scan of texts side by side: units of each, whether it holds a sentinel, and where units begin."""

    def __init__(self, texts: Sequence[bytes], units: Automaton, marks: Automaton, chunk: int = CHUNK) -> None:
        self.units, self.chunk = units, chunk
        parts = [-(-len(t) // chunk) for t in texts]
        self.end = np.cumsum(parts, dtype=np.int64)
        self.start = self.end - parts
        padded = bytearray(chunk * int(self.end[-1]) if texts else 0)
        sizes = np.full(len(padded) // chunk, chunk)
        for t, a, b in zip(texts, self.start.tolist(), self.end.tolist(), strict=True):
            padded[a * chunk : a * chunk + len(t)] = t
            if b > a:
                sizes[b - 1] = len(t) - (b - a - 1) * chunk
        self.bytes = np.frombuffer(padded, np.uint8).reshape(len(sizes), chunk)
        across, first = np.ascontiguousarray(self.bytes.T), np.repeat(self.start, parts)
        self.state, self.begun = (x[0] for x in compose(*functions(across, sizes, units), first))
        found = compose(*functions(across, sizes, marks), first)[0][0] == len(marks.step) - 1
        self.n = np.array([int(self.begun[b - 1]) if b > a else 0 for a, b in zip(self.start, self.end, strict=True)], np.int64)
        self.marked = [b > a and bool(found[b - 1]) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]

    def begin(self, text: int, unit: int) -> int:
        """The byte of a text at which a unit begins."""
        a, b = int(self.start[text]), int(self.end[text])
        at = a + int(np.searchsorted(self.begun[a:b], unit, "right"))
        before, state = (int(self.begun[at - 1]), int(self.state[at - 1])) if at > a else (0, 0)
        return (at - a) * self.chunk + _place(self.bytes[at], state, unit - before, self.units)


class Rule(NamedTuple):
    """How documents are transformed: units, sentinels, seed, per cent that are transformed, per cent of these with the suffix first."""

    units: str = "line"
    prefix: str = PREFIX
    suffix: str = SUFFIX
    middle: str = MIDDLE
    seed: int = SEED
    rate: int = RATE
    spm: int = SPM

    def checked(self) -> Rule:
        """Sentinels must be found again in the output whatever stands around them: none may begin as another, or itself, ends, or hold another."""
        marks = (self.prefix, self.suffix, self.middle)
        for x in marks:
            for y in marks:
                if not x or (x is not y and x in y) or any(x[-i:] == y[:i] for i in range(1, min(len(x), len(y)) + (x is not y))):
                    raise ValueError(f"sentinels {x!r} and {y!r} overlap")
        return self

    def plan(self, doc_id: object, n: int, size: int, marked: bool) -> tuple[str, int, int]:
        """Form, and the units before the middle and before the suffix."""
        h1, h2, h3, h4 = draws(doc_id, self.seed)
        if not size or marked or h3 % 100 >= self.rate:
            return "plain", 0, 0
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        return "spm" if h4 % 100 < self.spm else "psm", a, b

    def output(self, text: bytes, form: str, a: int, b: int) -> bytes:
        """The text in its form; a and b are the bytes at which middle and suffix begin."""
        if form == "plain":
            return text
        p, m, s = text[:a], text[a:b], text[b:]
        first, second, last = self.prefix.encode(), self.suffix.encode(), self.middle.encode()
        return b"".join((first, p, second, s, last, m) if form == "psm" else (second, s, first, p, last, m))


_OUT = T.StructType(
    [T.StructField("n", T.LongType(), False), T.StructField("form", T.StringType(), False), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType(), False)]
)


def _points(text: bytes) -> int:
    """Code points of a piece of UTF-8."""
    x = np.frombuffer(text, np.uint8)
    return int(((x & 0xC0) != 0x80).sum())


def _batch(ids: pa.Array, rows: list[tuple], field: str) -> pa.RecordBatch:
    n, form, p, m, out = zip(*rows, strict=True) if rows else ((),) * 5
    columns = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.binary()).cast(pa.string(), safe=False)]
    return pa.RecordBatch.from_arrays(columns, names=[field, *_OUT.names])


def _row(rule: Rule, text: bytes, n: int, form: str, a: int, b: int) -> tuple:
    out = rule.output(text, form, a, b)
    if form == "plain":
        return n, form, None, None, out
    return n, form, _points(text[:a]), _points(text[a:b]), out


def _small(docs: DataFrame, rule: Rule) -> DataFrame:
    """Documents that aren't giant: a map."""
    units, marks = UNITS[rule.units](), finder((rule.prefix, rule.suffix, rule.middle))

    def some(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        scan, rows = Scan(texts, units, marks), []
        for i, (doc_id, text, n) in enumerate(zip(ids.to_pylist(), texts, scan.n.tolist(), strict=True)):
            form, *cuts = rule.plan(doc_id, n, len(text), scan.marked[i])
            at = [0, 0] if form == "plain" else [scan.begin(i, k) if k < n else len(text) for k in cuts]
            rows.append(_row(rule, text, n, form, *at))
        return _batch(ids, rows, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, first = [], 0, 0
            for i, t in enumerate(utf8(b.column(1))):
                held.append(t)
                size += len(t)
                if size > AT_ONCE:
                    yield some(b.column(0).slice(first, len(held)), held)
                    held, size, first = [], 0, i + 1
            yield some(b.column(0).slice(first, len(held)), held)

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *_OUT]))


def _giant(docs: DataFrame, rule: Rule, block: int, steps: Steps) -> DataFrame:
    """Giant documents: blocks in a table, their functions composed per document, cuts selected in the blocks that hold them."""
    units, marks = UNITS[rule.units](), finder((rule.prefix, rule.suffix, rule.middle))
    data = F.col("text").cast("binary")
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / block).cast("int"))
    # Ids are drawn once: the table is written before anything reads it.
    blocks = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", data.alias("data"), F.explode(starts).alias("block"))
    blocks = blocks.select("row", "doc_id", "block", F.substring("data", F.col("block") * block + 1, F.lit(block)).alias("data"))
    blocks = steps.stored(blocks.repartition(F.col("row"), F.col("block")), "blocks")
    emitted = "row long, doc_id string, block int, size int, state binary, begun binary, found binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = np.frombuffer(b.column(3)[i].as_buffer(), np.uint8)
                whole = []
                for a in (units, marks):
                    chunks = _cut(text, CHUNK)
                    state, begun = compose(*functions(*chunks, a), np.zeros(len(chunks[1]), np.int64))
                    whole.append((state[:, -1].astype(np.uint8).tobytes(), begun[:, -1].tobytes()))
                columns = [[len(text)], [whole[0][0]], [whole[0][1]], [whole[1][0]]]
                columns = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), b.column(2).slice(i, 1), *columns], names=["row", "doc_id", "block", "size", "state", "begun", "found"])

    def resolve(t: pa.Table) -> pa.Table:
        """Form and cuts of a document from its blocks' functions: for each cut the block, its entry state and the unit to look for there."""
        t = t.sort_by("block")
        table = lambda name, kind: np.stack([np.frombuffer(x, kind) for x in t.column(name).to_pylist()], 1)
        first = np.zeros(t.num_rows, np.int64)
        state, begun = (x[0] for x in compose(table("state", np.uint8), table("begun", np.int64), first))
        found = compose(table("found", np.uint8), np.zeros((len(marks.step), t.num_rows), np.int64), first)[0][0]
        n, size = int(begun[-1]), sum(t.column("size").to_pylist())
        form, *cuts = rule.plan(t.column("doc_id")[0].as_py(), n, size, bool(found[-1] == len(marks.step) - 1))
        rows = []
        for k in cuts if form != "plain" else []:
            at = int(np.searchsorted(begun, k, "right"))
            rows.append((at, int(state[at - 1]), k - int(begun[at - 1])) if 0 < at < t.num_rows else (0, 0, k) if at == 0 else (t.num_rows, 0, 0))
        rows = rows or [(-1, 0, 0)]
        cut, entry, unit = zip(*rows, strict=True)
        return pa.table({"row": t.column("row")[:1].take(pa.array([0] * len(rows))), "n": pa.array([n] * len(rows)), "form": [form] * len(rows), "block": pa.array(cut, pa.int32()), "entry": pa.array(entry, pa.int32()), "unit": pa.array(unit, pa.int64())})

    wanted = blocks.withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(emit, emitted)
    wanted = steps.stored(wanted.groupBy("row").applyInArrow(resolve, "row long, n long, form string, block int, entry int, unit long"), "cuts")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [_place(np.frombuffer(x.as_buffer(), np.uint8), s, u, units) for x, s, u in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k * block + i for k, i in zip(b.column(1).to_pylist(), at, strict=True)], pa.int64())], names=["row", "at"])

    inside = blocks.join(wanted.select("row", "block", "entry", "unit"), ["row", "block"]).select("row", "block", "data", "entry", "unit").mapInArrow(select, "row long, at long")
    cuts = inside.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("at"))
    plans = wanted.groupBy("row").agg(F.first("n").alias("n"), F.first("form").alias("form")).join(cuts, "row", "left").select("row", "n", "form", F.coalesce(F.get("at", F.lit(0)), F.lit(-1)).alias("a"), F.coalesce(F.get("at", F.lit(1)), F.lit(-1)).alias("b"))
    schema = T.StructType([docs.schema["doc_id"], *_OUT])

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("block")
        text = b"".join(left.column("data").to_pylist())
        n, form, a, b = (right.column(c)[0].as_py() for c in ("n", "form", "a", "b"))
        # A cut after the last unit lies in no block.
        row = _row(rule, text, n, form, a if a >= 0 else len(text), b if b >= 0 else len(text))
        return pa.Table.from_batches([_batch(left.column("doc_id").combine_chunks().slice(0, 1), [row], "doc_id")])

    return blocks.groupBy("row").cogroup(plans.groupBy("row")).applyInArrow(build, schema)


def transform(docs: DataFrame, rule: Rule = Rule(), giant: int = GIANT, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output of every row."""
    rule, docs = rule.checked(), docs.select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    small = _small(docs.where(size <= giant), rule)
    large = docs.where(size > giant)
    if not large.limit(1).count():
        return small
    with Steps() as steps:
        return small.unionByName(stored(_giant(large, rule, block, steps), "giants"))


def restored(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that an output of transform() was made from. Sentinels stand nowhere else in it, so splitting there is exact."""
    from re import escape

    marks = [escape(x) for x in (rule.prefix, rule.suffix, rule.middle)]
    parts = F.split(output, "|".join(marks))
    # psm: nothing, prefix, suffix, middle; spm: nothing, suffix, prefix, middle.
    text = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.coalesce(text, output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(read(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), back.alias("restored_sha256"))


QUERIES = {"op13_fill_middle": op13_fill_middle}

_NUMBER = "list_sum([(instr('0123456789abcdef', substr(h, {0} + i, 1)) - 1) * CAST(pow(16, 8 - i) AS BIGINT) for i in range(1, 9)])::BIGINT"
ORACLES = {
    "op13_fill_middle": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines, {", ".join(f"{_NUMBER.format(8 * k)} AS h{k + 1}" for k in range(4))} FROM t),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:], '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
}
