"""The corpus pipeline: quality rules, line dedup, near dedup, mixing and packing, each stage over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Nulls, empty texts and the like have the results that the operators'
docstrings give them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sphaera.llm import line_dedup as lines
from sphaera.llm import mixing, packing, quality_rules, simhash
from sphaera.llm.common import read, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of documents are long; so many go to a Python worker at once, unless the session says otherwise (Spark's default is 10,000).
BATCH, SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _columns(docs: DataFrame) -> DataFrame:
    """Plans take the setting when they are run, after the stage has returned, so it can't be put back; a session's own value stays."""
    conf = docs.sparkSession.conf
    if conf.get(SETTING) == "10000":
        conf.set(SETTING, BATCH)
    return docs.select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the policy go on."""
    return quality_rules.kept_documents(_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line resembles at 0.8 or more are cut out of their texts; every document stays."""
    return lines.drop_lines(_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (fingerprints of five-word shingles) stays; of the emptied ones, one."""
    return simhash.near_dedup(_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets; a document taken k times is k rows."""
    return mixing.mix(_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their token ids and their places in sequences; packing.sequences() puts the pieces together."""
    return packing.pack_documents(_columns(docs), with_ids=True)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, tokens and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
