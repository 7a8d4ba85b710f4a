"""The pipeline's stages, each against what it has to do with its own input."""

from collections import Counter

from pyspark.sql import functions as F
from test_ops import WORD, brute_groups, brute_lines, empty, low, odd  # noqa: F401  fixtures

import corpus_pipeline as pipeline
from sphaera.llm import mixing, packing, quality_rules
from sphaera.llm.common import stored


def test_stages(spark, data):
    docs = pipeline.read(spark, data, "documents")
    kept = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, data), name)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    before, after = kept["quality_rules"]
    good = {r.doc_id for r in quality_rules.ledger(before).where(quality_rules.passes("web", 2)).collect()}
    assert {r.doc_id for r in after.collect()} == good
    before, after = kept["line_dedup"]
    gone = brute_lines([(r.doc_id, r.text) for r in before.collect()])
    want = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) not in gone) for r in before.collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want and after.where(F.col("n_chars") != F.length("text")).count() == 0
    before, after = kept["simhash_near_dedup"]
    groups = {}
    texts = {r.doc_id: r.text for r in before.collect()}
    for i, _, c in brute_groups(list(texts.items()), 5):
        groups.setdefault(c, set()).add(i)
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for d in groups if (w := low(texts[d]).split())}
    want = {d for d in groups if d not in sets or not any(5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]) for e in sets if e < d)}
    assert {r.doc_id for r in after.collect()} == want and sum(map(len, groups.values())) == before.count()
    before, after = kept["mixing"]
    plan = {r.doc_id: r.copies for r in mixing.plan(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({d: n for d, n in plan.items() if n})
    size, taken = {r.doc_id: (len(WORD.findall(r.text)), r.source) for r in before.collect()}, Counter()
    for d, n in plan.items():
        taken[size[d][1]] += n * size[d][0]
    for r in mixing.plan(before).groupBy("source").agg(F.first("target").alias("t"), F.max("size").alias("m")).collect():
        assert abs(taken[r.source] - r.t) <= 6 * r.m + 1
    before, after = kept["packing"]
    assert after.where("piece = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(after).collect()}
    words = packing._words(packing.tokenizer_path())
    back = Counter()
    for r in after.where("start = 0").collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    for (d,), rs in group_by(after.where("piece = 0 AND length < 4096").collect(), "doc_id"):
        back[d] = sorted(bytes(r.ids) for r in rs)
    for (d,), rs in group_by(before.collect(), "doc_id"):
        ids = sorted(x for r in rs if len(x := packing._ids((r.text or "").encode(), words)) < 4 * 4096)
        assert not ids or back[d] == ids


def group_by(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out.items()


def test_every_stage_takes_odd_rows_and_empty_tables(spark, odd, empty, data):
    given = odd.select(*pipeline.COLUMNS, F.col("size").alias("target"), F.col("fp").alias("__c0"))
    for name, stage in pipeline.STAGES:
        out = stage(spark, given, data)
        assert name == "packing" or out.columns == list(pipeline.COLUMNS)
        n = out.count()
        assert n <= {"mixing": 3 * odd.count(), "packing": 100}.get(name, odd.count())
        if name in ("line_dedup", "packing"):
            assert n >= odd.count()
        assert stage(spark, empty, data).count() == 0


def test_run_is_all_stages(spark, data):
    assert pipeline.run(spark, data).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
