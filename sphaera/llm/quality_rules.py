"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document. The ledger keeps the measurements and one bit for each failed rule; a policy
is a named, versioned set of rules, hence a mask, and deciding, counting and ablating policies are bitwise operations on
the ledger that never touch a text again.

Nulls and edges: a null text counts as empty and fails `few_words`; doc_id may be null or repeated, each row is judged by
itself; no input column but doc_id, text and those asked for in `carry` is read; a carried column whose name equals one of
the ledger's is replaced by the ledger's; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, read, scratch, tidied, utf8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_stutter")
SYMBOLS, SPACE, WINDOW = b"#*$%&|<>", b" \t\n\v\f\r", 8

#: name -> SQL condition over the measurements under which the rule fails. The position is the rule's bit, so rules are only ever added at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 16 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 4 * n_lines",
    "upper_case": "2 * n_upper_words > n_words",
    "stutter": "10 * n_stutter > 3 * n_words",
}
#: (policy, version) -> rules under which a document is rejected.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("web", 1): ("few_words", "repeated_windows", "short_words", "long_words", "symbols"),
    ("web", 2): tuple(RULES),
}


def _repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of 8 found twice or more. Equal windows have equal hashes, so most texts end at the hashes; where two agree the windows themselves are compared."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
        mixed = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    seen: dict[tuple[bytes, ...], list[int]] = {}
    for i in maybe.tolist():
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            np.add.at(edge, at, 1)
            np.add.at(edge, np.asarray(at) + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, SPACE).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
        sum(map(eq, words, words[1:])),
    )


def measure(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in `carry` and one long per measurement, a row for each row of docs; a map without any shuffle."""
    keep = [c for c in carry if c not in MEASURES]
    text_at = len(keep)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(m, T.LongType(), False) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch("quality_rules")
        for b in batches:
            rows = np.array([_measure(t) for t in utf8(b.column(text_at))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:text_at], *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], names=[*keep, *MEASURES])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(tidied(run), schema)


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str, version: int) -> int:
    return sum(bit(r) for r in POLICIES[policy, version])


def ledger(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """measure() and `failed`, a long with the bit of every rule that the row fails."""
    bits = [F.when(F.expr(sql), F.lit(bit(r))).otherwise(F.lit(0)).cast("long") for r, sql in RULES.items()]
    failed: Column = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs, carry).withColumn("failed", failed)


def passes(policy: str, version: int) -> Column:
    """Whether a row of the ledger passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy, version))) == 0


def ablation(rows: DataFrame, policy: str, version: int) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that only it rejects, rows kept with it and without it.

    The ledger is first reduced to one row per set of failed rules, of which there are at most 2 ** rules."""
    m = mask(policy, version)
    sets = rows.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    per_rule = []
    for r in POLICIES[policy, version]:
        b = F.lit(bit(r))
        n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
        per_rule.append(
            F.struct(
                F.lit(r).alias("rule"),
                n(F.col("bits").bitwiseAND(b) != 0).alias("failed"),
                n(F.col("bits") == b).alias("only_here"),
                n(F.col("bits") == 0).alias("kept"),
                n(F.col("bits").bitwiseAND(~np.int64(bit(r)).item() & m) == 0).alias("kept_without"),
            )
        )
    return sets.agg(F.array(*per_rule).alias("rules")).select(F.inline("rules"))


def kept_documents(docs: DataFrame, policy: str = "web", version: int = 2) -> DataFrame:
    """The rows of docs that pass, with docs' own columns (those named like a measurement included)."""
    shadow = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(s) for c, s in shadow.items()], F.col("text"))
    return ledger(inner, list(shadow.values())).where(passes(policy, version)).select(*[F.col(s).alias(c) for c, s in shadow.items()])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", *MEASURES[:5], (~passes("base", 1)).alias("base_failed"), passes("web", 2).alias("kept"), "failed")


_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
pos AS (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS s FROM pos),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}')),
line_counts AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM lines GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines,
        len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
        len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutter
      FROM w LEFT JOIN covered c USING (rid) LEFT JOIN line_counts USING (rid)),
f AS (SELECT *, {" + ".join(f"CASE WHEN {sql} THEN {bit(r)} ELSE 0 END" for r, sql in RULES.items())} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {mask("base", 1)} <> 0 AS base_failed,
       failed & {mask("web", 2)} = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM f
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _ORACLE}
