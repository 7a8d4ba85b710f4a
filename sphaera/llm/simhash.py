"""Near duplicates by SimHash fingerprints.

A document's fingerprint has, bit by bit, the majority over the XXH64 of its shingles; documents link when their
fingerprints differ in at most RADIUS = 2 bits, and a group is a connected component of links.

Links are found between distinct fingerprints, so that copies cost one row. A fingerprint is embedded as the bit counts of
its 32 segments of two bits. The Manhattan distance of two embeddings never exceeds the Hamming distance, so links lie
within Manhattan distance 2, and of the four quarters of the axes two at least agree exactly: the grid's cells are the
counts on two quarters, and each of the six choices of two is one grid. Pairs within a cell pass the Manhattan bound first
and the exact distance then. Counts are held in unary (0, 1, 2 as 00, 01, 11), which makes the Manhattan distance the bit
count of an exclusive or.

A cell with more than CELL members is cut again by the same rule: the two quarters that it leaves open fall into four eighths,
two of which at least agree exactly, so its members go to the six choices of two. That is 36 bits of counts in place of 24, enough
for tens of billions of fingerprints at a few to a cell. Only fingerprints of equal counts can crowd such a cell as well (those of one
family, that is); they go an exact way that is linear in their number: fingerprints at distance 2 or less are those that have a point
at distance 1 or less in common, so each emits its 65 points, and those that meet at a point (65 at most) are linked to the
smallest of them.

Nulls and edges: a null or empty text, or one of white space only, has fingerprint zero and links like any other; texts of
one or two words have one shingle; doc_id null takes part, and a group's id is the smallest id that isn't null (null if
there is none); repeated rows are copies; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, join_unique, read, stored, tidied, utf8
from .graphs import components
from .line_dedup import repeated

SHINGLE, SEED, RADIUS, CELL = 3, 42, 2, 64
#: The similarity of near copies that fingerprints within RADIUS may miss, as a fraction.
SIMILAR = (4, 5)
#: Up to so many document ids are broadcast (8 bytes each) where rows are kept by id; beyond, the rows are shuffled by id.
BROADCAST_IDS = 500_000
_LOW = 0x5555555555555555


def _fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # both touch ASCII only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n < 2:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip((ends - lengths)[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * np.add.reduce(bits, axis=0, dtype=np.uint32) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in carry and fp (the 64 bits as a long) of every row."""
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([_fingerprint(t, shingle) for t in utf8(b.column(len(carry)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(fp)], names=[*carry, "fp"])

    return docs.select(*(F.col(f"`{c}`") for c in carry), F.col("text").alias("__text")).mapInArrow(tidied(run), schema)


def counts(fp: Column) -> Column:
    """Bit counts of the 32 segments in unary."""
    shifted = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(F.lit(_LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(F.lit(_LOW)), 1))


#: The choices of two of four parts.
_TWO = [(i, j) for i in range(4) for j in range(i)]


def _cells(fps: DataFrame) -> DataFrame:
    """fp, its counts c and its cell on each of the six grids."""
    quarter = lambda i: F.shiftrightunsigned(F.col("c"), 16 * i).bitwiseAND(F.lit(0xFFFF))
    cells = [F.shiftleft(quarter(i), 16).bitwiseOR(quarter(j)).bitwiseOR(F.lit(k << 32)) for k, (i, j) in enumerate(_TWO)]
    return fps.select("fp", counts(F.col("fp")).alias("c")).select("fp", "c", F.explode(F.array(*cells)).alias("cell"))


def _subcells(members: DataFrame) -> DataFrame:
    """members (fp, c, cell) of crowded cells with `sub`: what two of the eighths hold that the cell leaves open, for each choice of two."""
    quarter = lambda i: F.shiftrightunsigned(F.col("c"), 16 * i).bitwiseAND(F.lit(0xFFFF))
    others = [tuple(q for q in range(4) if q not in pair) for pair in _TWO]
    open_ = F.get(F.array(*(F.shiftleft(quarter(a), 16).bitwiseOR(quarter(b)) for a, b in others)), F.shiftrightunsigned("cell", 32).cast("int"))
    eighth = lambda i: F.shiftrightunsigned(F.col("o"), 8 * i).bitwiseAND(F.lit(0xFF))
    subs = [F.shiftleft(eighth(i), 8).bitwiseOR(eighth(j)).bitwiseOR(F.lit(k << 16)) for k, (i, j) in enumerate(_TWO)]
    return members.withColumn("o", open_).select("fp", "c", "cell", F.explode(F.array(*subs)).alias("sub"))


def _parted(members: DataFrame, keys: list[str], cap: int, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """The links within cells (named by keys) of up to `cap` members, and the members of larger cells."""
    sizes = steps.stored(members.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "cells")
    a = members.join(sizes.where(F.col("n") <= cap).select(*keys), keys)
    b = a.select(*keys, F.col("fp").alias("fp2"), F.col("c").alias("c2"))
    near = F.bit_count(F.col("c").bitwiseXOR(F.col("c2"))) <= RADIUS
    same = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS
    pairs = a.join(b, keys).where((F.col("fp") < F.col("fp2")) & near & same).select(F.col("fp").alias("u"), F.col("fp2").alias("v"))
    return pairs, members.join(sizes.where(F.col("n") > cap).select(*keys), keys, "left_semi")


def links(fps: DataFrame, cap: int = CELL) -> DataFrame:
    """fps (distinct fp) -> links (u, v): all pairs within RADIUS in cells of up to `cap` members, at the first or the second level, and
    stars with the same components in still larger ones."""
    with Steps() as steps:
        pairs, crowd = _parted(_cells(fps), ["cell"], cap, steps)
        crowd = steps.stored(crowd, "crowd")
        if crowd.limit(1).count():
            finer, crowd = _parted(_subcells(crowd), ["cell", "sub"], cap, steps)
            points = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64))]
            meets = crowd.select("fp").distinct().select("fp", F.explode(F.array(*points)).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
            stars = meets.select(F.explode("met").alias("u"), F.array_min("met").alias("v")).where("u != v")
            pairs = pairs.union(finer).union(stars)
        return stored(pairs.distinct(), "links")


def groups(docs: DataFrame, shingle: int = SHINGLE, cap: int = CELL) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = links(fps.select("fp"), cap)
    comp = components(found)
    rooted = fps.join(comp, fps.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(join_unique(rooted, ids, "root").select("fp", "component_id"), "components")
    # A fingerprint that many rows have (that of empty texts, say) is joined by broadcast.
    return join_unique(rows, named, "fp").select("doc_id", "fp", "component_id")


def shingled(text: bytes, shingle: int) -> bytes:
    """A text whose words are the shingles of text, over which fingerprints are taken; theirs are joined by a byte that UTF-8 hasn't."""
    words = text.lower().split()
    joined, n = b"\xff".join(words), len(words) - shingle + 1
    if n < 2:
        return joined
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    return b" ".join([joined[a:b] for a, b in zip(begins[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)])


def near_dedup(docs: DataFrame, shingle: int = 5, cap: int = CELL) -> DataFrame:
    """docs without near copies. Of each group of fingerprints one row stays, that of the group's id; of rows that share this id, the
    one with the smallest text. Of these rows, one goes if an earlier one (by doc_id) has a Jaccard similarity of SIMILAR or more
    with it, over their sets of shingles: an exact join, line_dedup's with a document as a line. A text without words has no shingles.

    Rows without doc_id can't stand for a row that has one, nor it for them: they are judged in the same way among themselves, by numbers
    in the order of their texts' hashes."""
    named, bare = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    out = _without_near(named, shingle, cap)
    if not bare.limit(1).count():
        return out
    # Equal texts spread over ranges; the numbers are fixed by writing them.
    salted = bare.withColumns({"__h": F.xxhash64("text"), "__salt": F.monotonically_increasing_id()}).repartitionByRange("__h", "__salt").sortWithinPartitions("__h", "__salt")
    numbered = stored(salted.drop("__h", "__salt").withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    return out.union(_without_near(numbered, shingle, cap).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))


def _without_near(docs: DataFrame, shingle: int, cap: int) -> DataFrame:
    """near_dedup() of rows that have ids."""
    kept = stored(_one_of_each(docs, shingle, cap), "kept")
    near = repeated(kept, SIMILAR, lambda t: shingled(t, shingle))
    return _without_ids(kept, stored(near.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct(), "gone"))


def _one_of_each(docs: DataFrame, shingle: int, cap: int) -> DataFrame:
    """near_dedup() by fingerprints alone."""
    found = stored(groups(docs.where("doc_id IS NOT NULL"), shingle, cap), "groups")
    shared = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared")
    gone = stored(found.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    out = _without_ids(docs, gone)
    if not shared.count():
        return out
    # Rows of one id can lie in different groups: they are told apart by their fingerprints.
    columns = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    odd = docs.join(shared, "doc_id", "left_semi").select(*[F.col(f"`{c}`").alias(x) for c, x in columns.items()], "text")
    at = found.where("doc_id = component_id").select(F.col("doc_id").alias(columns["doc_id"]), "fp").distinct()
    first = Window.partitionBy(columns["doc_id"]).orderBy(F.col(columns["text"]))
    one = fingerprints(odd, shingle, list(columns.values())).join(at, [columns["doc_id"], "fp"]).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return out.join(shared, "doc_id", "left_anti").select(*docs.columns).union(one.select(*columns.values()).toDF(*docs.columns))


def _without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    ids = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(ids, "doc_id", "left_anti")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
