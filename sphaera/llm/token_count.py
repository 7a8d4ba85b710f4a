"""Token counts by the whole-token shortcut.

A byte-level tokenizer cuts a text at its special tokens, then into pre-tokens by a pattern, and merges each pre-token on its own. prove()
finds offline, on the driver, which strings of the vocabulary the library encodes alone as one token; while counting, a pre-token among them
is one token without further work, and only the others are merged (by the library, with a bounded cache of what was merged before).
The classes of letters, digits and white space in the pattern are asked of the library too, code point by code point, as Python's and
the library's editions of Unicode differ. What is shipped to the tasks is a set of strings no larger than the vocabulary.

Texts are read whole. A long one is matched in parts of about PART code points, cut only where white space follows something else: no
pre-token reaches over such a place, and none looks past it.

Nulls and edges: a null text is empty, with 0 bytes and 0 tokens; doc_id may be null or repeated, each row is counted by itself; bytes that
aren't UTF-8 count as the replacement character does; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import read, scratch, utf8

LIMIT, PART = 1024, 1 << 20
#: Merged pre-tokens that a worker keeps, and the longest of them.
CACHE, LONGEST = 300_000, 64
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


class Proof(NamedTuple):
    """What tasks need: the tokenizer's file, the strings that are one token, the patterns of pre-tokens and of safe cuts for texts of the first
    128, the first 65,536 and of all code points (short classes match faster), and the pattern of special tokens."""

    path: str
    whole: frozenset[str]
    patterns: tuple[tuple[str, str], ...]
    special: str


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _library(path: str) -> Any:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _runs(pre: Any) -> list[tuple[int, int, str]]:
    """Runs of code points (start, end) that the library's pattern takes for letters (L), digits (N), white space (W) or others (O)."""

    def kind(c: str) -> str:
        pieces = lambda s: len(pre.pre_tokenize_str(s))
        if pieces(f"a{c}a") == 1:
            return "L"
        if pieces(f"1{c}1") == 1:
            return "N"
        return "O" if pieces(f"#{c}#") == 1 else "W"

    ascii_ = [(i, i + 1, "W" if chr(i) == " " else kind(chr(i))) for i in range(128)]
    rest = [i for i in range(128, 0x110000) if not 0xD800 <= i < 0xE000]
    # One pre-token of the row of all code points is of one class; its first tells which.
    return ascii_ + [(rest[a], rest[b - 1] + 1, kind(chr(rest[a]))) for _, (a, b) in pre.pre_tokenize_str("".join(map(chr, rest)))]


def _patterns(runs: list[tuple[int, int, str]], below: int) -> tuple[str, str]:
    """Patterns of pre-tokens and of safe cuts for texts of code points below `below`."""
    k = {"L": "", "N": "", "W": ""}
    for a, b, kind in runs:
        if kind in k and a < below:
            k[kind] += re.escape(chr(a)) + ("-" + re.escape(chr(min(b, below) - 1)) if min(b, below) - a > 1 else "")
    #: The endings that this kind of tokenizer splits off.
    endings = "'(?:s|t|re|ve|m|ll|d)"
    pretoken = f" ?[{k['L']}]+|{endings}| ?[{k['N']}]+| ?[^{k['W']}{k['L']}{k['N']}]+|[{k['W']}]+(?![^{k['W']}])|[{k['W']}]+"
    return pretoken, f"(?<=[^{k['W']}])(?=[{k['W']}])"


def prove(path: str | None = None) -> Proof:
    """Everything that counting rests on, asked of the library itself. Files of other kinds than byte-level merges are refused."""
    path = path or tokenizer_path()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    level = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or not level.get("use_regex", True) or spec["normalizer"]:
        raise ValueError(f"{path}: not a byte-level BPE without normalizer and prefix")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: special tokens that take in their surroundings")
    library = _library(path)
    added = {t["content"] for t in spec["added_tokens"]}
    strings = {library.decode([i], skip_special_tokens=False): i for i in spec["model"]["vocab"].values()}
    texts = [s for s in strings if s and s not in added]
    whole = frozenset(s for s, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if e.ids == [strings[s]])
    runs = _runs(library.pre_tokenizer)
    patterns = tuple(_patterns(runs, below) for below in (1 << 7, 1 << 16, 0x110000))
    return Proof(path, whole, patterns, "|".join(map(re.escape, sorted(added, key=len, reverse=True))))


def _bytes_as_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes with: printable bytes are themselves, the others follow from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class Counter(dict):
    """Pre-token -> number of tokens. Those of the proof are there from the start; others are merged when they come."""

    def __init__(self, proof: Proof) -> None:
        super().__init__(dict.fromkeys(proof.whole, 1))
        self.proof, self.merge, self.kept, self.merged, self.letters = proof, None, 0, 0, _bytes_as_letters()
        self.patterns = [(re.compile(p), re.compile(c)) for p, c in proof.patterns]
        self.special = re.compile(proof.special) if proof.special else None

    def __missing__(self, pretoken: str) -> int:
        if self.merge is None:
            self.merge = _library(self.proof.path).model.tokenize
        self.merged += 1
        n = len(self.merge(pretoken.encode().decode("latin-1").translate(self.letters)))
        if len(pretoken) <= LONGEST:
            if self.kept == CACHE:
                self.clear()
                self.update(dict.fromkeys(self.proof.whole, 1))
                self.kept = 0
            self[pretoken] = n
            self.kept += 1
        return n

    def _plain(self, text: str) -> int:
        pretoken, cut = self.patterns[0 if text.isascii() else 2 if _ASTRAL.search(text) else 1]
        n, at = 0, 0
        while at < len(text):
            end = len(text)
            if end - at > PART and (place := cut.search(text, at + PART)):
                end = place.start()
            n += sum(map(self.__getitem__, pretoken.findall(text[at:end])))
            at = end
        return n

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit (more tokens than limit) of every row; a map."""
    shared = docs.sparkSession.sparkContext.broadcast(prove(path))
    names = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    kinds = (T.LongType(), T.LongType(), T.BooleanType())
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, k, False) for n, k in zip(names[1:], kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = scratch("token_count")
        proof = shared.value
        if proof.path not in kept:
            kept[proof.path] = Counter(proof)
        counter = kept[proof.path]
        for b in batches:
            size, tokens = [], []
            for t in utf8(b.column(1)):
                size.append(len(t))
                tokens.append(counter.count(t.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=list(names))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


QUERIES = {"op11_token_counts": op11_token_counts}
#: Merging byte pairs has no SQL; tests hold the query against the library.
ORACLES: dict[str, str] = {}
