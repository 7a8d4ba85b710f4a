"""The training-data operators against brute force and on odd inputs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import rows
from pyspark.sql import functions as F

from sphaera.llm import chat, line_dedup, maxscore, mixing, packing, quality_model, quality_rules, secret_scan, simhash, url_filter
from sphaera.llm.queries import oracle_sql, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, failed string, fp string"


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    long_ = " ".join(f"w{i % 7919}" for i in range(60_000))
    texts = [(1, "a b c d\nA b c d\na b c d"), (2, None), (3, ""), (4, " \t\n\x0b "), (5, long_), (6, "x" * 200_000), (7, "übung\u00a0macht den Meister"), (7, "übung\u00a0macht den Meister"), (7, "something else entirely here"), (None, "a b c d"), (None, None), (8, "<|endoftext|> \\b <b> </turn> \\l"), (9, "a b c d")]
    return spark.createDataFrame([(i, t, None, s, None, 5, "f", "g") for (i, t), s in zip(texts, ["s", None, "s", "t", "t", None, "s", "s", "u", "u", None, "t", "s"])], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    assert rows(queries()[name](spark, data)) == rows(duck.execute(oracle_sql()[name]).fetchdf())


# --- 1 quality rules ---


def test_rules_on_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.ledger(odd).collect()}
    assert got[5, 60_000].n_repeat_words > 50_000 and got[1, 12].n_dup_lines == 1 and got[2, 0].failed & 1
    assert quality_rules.ledger(empty).count() == 0
    kept = quality_rules.kept_documents(odd, "base", 1)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == set()


def test_ablation_counts_each_rule(docs):
    ledger = quality_rules.ledger(docs).cache()
    failed = [r.failed for r in ledger.collect()]
    names = quality_rules.POLICIES["web", 2]
    for r in quality_rules.ablation(ledger, "web", 2).collect():
        b = quality_rules.bit(r.rule)
        rest = quality_rules.mask("web", 2) & ~b
        assert (r.failed, r.only_here, r.kept, r.kept_without) == (sum(f & b > 0 for f in failed), sum(f == b for f in failed), failed.count(0), sum(f & rest == 0 for f in failed))
    assert set(names) == set(quality_rules.RULES)


def test_repeated_words_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        w = [bytes([97 + x]) for x in rng.integers(0, 2, int(rng.integers(0, 60)))]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert quality_rules._repeated_words(w) == len(covered)


# --- 2 mixing ---


def water(sizes, weights, most=3.0):
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [[10, 20, 30, 40], [1, 1000, 1000], [0, 5, 100, 1, 1, 7], [1, 1, 1, 1000]])
def test_targets_are_what_resharing_gives(spark, sizes):
    t = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(mixing.cyclic_weights(t)).orderBy("source").collect()]
    assert got == pytest.approx(water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_mix_comes_near_its_targets_and_repeats_itself(docs):
    plan = mixing.plan(docs)
    assert rows(plan) == rows(mixing.plan(docs.repartition(3)))
    by = plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("n"), F.sum(F.col("size") * F.col("size")).alias("sq")).collect()
    for r in by:
        f = r.target / r.n % 1
        assert abs(r.taken - r.target) <= 5 * (f * (1 - f) * r.sq) ** 0.5 + 1
    assert mixing.mix(docs).count() == plan.agg(F.sum("copies")).first()[0]


def test_mix_on_odd_rows(odd, empty, spark):
    plan = mixing.plan(odd)
    assert plan.count() == odd.count() and plan.where("copies > 3 OR copies < 0").count() == 0
    assert mixing.mix(empty).count() == 0
    given = spark.createDataFrame([("s", 1.0), (None, 1.0), ("t", 2.0), ("u", 1.0)], "source string, weight double")
    assert mixing.plan(odd, given).count() == odd.count()


def test_repeated_rows_are_taken_in_number(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 60)
    rows_ = [(1, "a b c d e", "s")] * 1000 + [(None, None, None)] * 50 + [(i, "w " * 20, "t") for i in range(2, 90)] + [(5, "w " * 20, "t")] * 3
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    given = spark.createDataFrame([("s", 1.0), (None, 1.0), ("t", 1.0)], "source string, weight double")
    plan = mixing.plan(df, given)
    got = plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    by = {r.source: r for r in got}
    assert by["s"].n == 1000 and by[None].n == 50 and by["t"].n == 91
    assert abs(by["s"].taken - by["s"].target) <= 5 and plan.where("source = 's'").select("copies").distinct().count() == 2
    assert rows(plan) == rows(mixing.plan(df.repartition(7), given)) and mixing.mix(df, given).count() == plan.agg(F.sum("copies")).first()[0]


def test_copies_by_brute_force(spark, data):
    """sizes, targets and copies of the query, from its documents alone."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()
    got = {r.doc_id: r for r in queries()["op2_mixing"](spark, data).collect()}
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    sources = sorted({r.source for r in docs}, key=lambda x: (x is None, (x or "").encode("utf-16-be")))
    total = [sum(size[r.doc_id] for r in docs if r.source == x) for x in sources]
    aims = dict(zip(sources, water(total, [(5, 2, 1)[i % 3] for i in range(len(sources))])))
    for r in docs:
        g, n = got[r.doc_id], size[r.doc_id]
        rate = aims[r.source] / total[sources.index(r.source)]
        assert (g["size"], g.source_size) == (n, total[sources.index(r.source)]) and abs(g.target - aims[r.source]) < 1e-6 * max(1, g.target)
        assert g.taken in ({n * int(rate), n * (int(rate) + 1)} if rate % 1 > 1e-9 else {n * round(rate)}) and g.taken <= 3 * n


def test_many_sources_go_the_salted_way(odd, monkeypatch):
    wide = rows(mixing.plan(odd))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert rows(mixing.plan(odd)) == wide


# --- 3 line dedup ---


def brute_lines(docs):
    lines = sorted(((d, k, frozenset(x.encode().split())) for d, t in docs for k, x in enumerate((t or "").split("\n")) if x.encode().split()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return {(d, k) for i, (d, k, s) in enumerate(lines) if any(5 * len(s & o) >= 4 * len(s | o) and (d, k) != (e, m) for e, m, o in lines[:i])}


@pytest.mark.parametrize("first", [(8, 64), (1, 1)])
def test_lines_equal_brute_force(docs, monkeypatch, first):
    monkeypatch.setattr(line_dedup, "FIRST", first)
    got = {(r.doc_id, r.line) for r in line_dedup.repeated(docs).collect()}
    assert got == brute_lines([(r.doc_id, r.text) for r in docs.collect()]) and got


def test_families_of_near_copies_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(25)]
    texts = []
    for d in range(120):
        w = list(base)
        for i in rng.choice(25, int(rng.integers(0, 5)), replace=False):
            w[i] = f"v{rng.integers(0, 40)}"
        texts.append((d, " ".join(w) + "\n" + " ".join(rng.permutation(w)[:12])))
    got = {(r.doc_id, r.line) for r in line_dedup.repeated(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_lines(texts)


def test_lines_of_odd_rows(odd, empty):
    out = line_dedup.drop_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {(r.doc_id, r.text) for r in out.collect()}
    # The null id comes first, so doc 1 and 9 lose the line that it has; "A b c d" differs in one of five words (3 / 5).
    assert (None, "a b c d") in texts and (1, "A b c d") in texts and (9, "") in texts and (2, None) in texts
    assert line_dedup.drop_lines(empty).count() == 0


def brute_removed(docs):
    """The op3 query on rows (doc_id, text), whatever they hold: rows of one id with equal line numbers and words are one place."""
    lines = sorted({(i is not None, i or 0, k, frozenset(x.encode().split())) for i, t in docs for k, x in enumerate((t or "").split("\n")) if x.encode().split()}, key=lambda r: r[:3])
    gone = {a for i, a in enumerate(lines) for b in lines if b[:3] < a[:3] and 5 * len(a[3] & b[3]) >= 4 * len(a[3] | b[3])}
    out = []
    for i, t in docs:
        cut = [k for k, x in enumerate((t or "").split("\n")) if x.encode().split() and (i is not None, i or 0, k, frozenset(x.encode().split())) in gone]
        out.append((i, len(cut), ",".join(map(str, cut))))
    return sorted(out, key=repr)


def test_query_of_odd_rows_equals_brute_force(spark, odd, empty):
    got = sorted((tuple(r) for r in line_dedup.removed(odd).collect()), key=repr)
    assert got == brute_removed([(r.doc_id, r.text) for r in odd.collect()])
    assert line_dedup.removed(empty).count() == 0
    shared = [(5, "one two three four\nalpha beta"), (5, "six seven eight nine\none two three four"), (5, "gamma delta\nalpha beta"), (5, "gamma delta\nalpha beta"), (None, "alpha beta"), (None, "zeta\nalpha beta"), (6, None), (6, "zeta\n\n \ngamma delta")]
    got = sorted((tuple(r) for r in line_dedup.removed(spark.createDataFrame(shared, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_removed(shared)


def test_lines_of_documents_with_other_kinds_of_ids(spark):
    texts = [("b", "one two three four five\nother words"), ("a", "x\none two three four five"), (None, "other words"), ("c", "one two three four six five"), ("c", "nothing of it")]
    got = sorted((tuple(r) for r in line_dedup.removed(spark.createDataFrame(texts, "doc_id string, text string")).collect()), key=repr)
    assert got == sorted([("a", 0, ""), ("b", 2, "0,1"), (None, 0, ""), ("c", 1, "0"), ("c", 0, "")], key=repr)
    dropped = {(r.doc_id, r.text) for r in line_dedup.drop_lines(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    assert dropped == {("a", texts[1][1]), ("b", ""), (None, "other words"), ("c", ""), ("c", "nothing of it")}


@pytest.mark.parametrize("threshold", [(4, 5), (1, 2)])
def test_hot_words_are_posted_in_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(line_dedup, "HOT", 4)
    rng = np.random.default_rng(9)
    texts = [(d, "\n".join(" ".join(f"h{x}" for x in rng.choice(9, int(rng.integers(1, 8)), replace=False)) for _ in range(4))) for d in range(60)]
    got = {(r.doc_id, r.line) for r in line_dedup.repeated(spark.createDataFrame(texts, "doc_id long, text string"), threshold).collect()}
    lines = [(d, k, frozenset(x.split())) for d, t in texts for k, x in enumerate(t.split("\n"))]
    up, down = threshold
    assert got == {(d, k) for i, (d, k, a) in enumerate(lines) if any(down * len(a & b) >= up * len(a | b) for _, _, b in lines[:i])} and len(got) < len(lines)


def test_sums_in_a_tree(spark):
    from sphaera.llm import common

    def fold(t):
        import pyarrow as pa

        n = np.zeros(4, np.int64)
        for x in t.column("payload").to_pylist():
            at, v = common.dense(x)
            n[at] += v
        return pa.table({"part": t.column("part")[:1], "payload": pa.array([common.sparse(n)], pa.binary())})

    parts = spark.createDataFrame([(p, t, bytearray(common.sparse(np.array([t, 0, 1, p])))) for p in range(3) for t in range(20)], "part int, task int, payload binary")
    for fan in (3, 256):
        got = {r.part: common.dense(bytes(r.payload)) for r in common.tree_sum(parts, fold, fan).collect()}
        assert {p: dict(zip(a.tolist(), v.tolist())) for p, (a, v) in got.items()} == {p: {0: 190, 2: 20} | ({3: 20 * p} if p else {}) for p in range(3)}


# --- 4 MaxScore ---


def test_search_on_odd_vectors(spark):
    v = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf")]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0]), (4, []), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (0, [0.5, 9.0])]
    t = spark.createDataFrame(v, "vec_id long, embedding array<float>").select("vec_id", maxscore.weights(F.col("embedding")).alias("weights")).where("weights IS NOT NULL AND vec_id IS NOT NULL")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(t, t.where("vec_id % 20 = 0"), 4).orderBy("query_id", "rank").collect()]
    # Of the two rows of id 0 the smaller vector asks.
    assert got == [(0, 1, 1, 64 * 32 + 128 * 576), (0, 2, 2, 75776), (0, 3, 5, 75776), (0, 4, 5, 75776)]
    assert maxscore.top_k(t.limit(0), t.limit(0)).count() == 0


def test_search_in_many_blocks_and_shards(spark, data, monkeypatch):
    want = rows(queries()["op4_maxscore"](spark, data))
    monkeypatch.setattr(maxscore, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(maxscore, "SHARD", 50)
    monkeypatch.setattr(maxscore, "SEED", 30)
    assert rows(queries()["op4_maxscore"](spark, data)) == want


def test_search_skips_postings(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", maxscore.weights(F.col("embedding")).alias("weights"))
    looked = spark.sparkContext.accumulator(0)
    asked = e.where("vec_id % 20 = 0")
    assert maxscore.top_k(e, asked, looked=looked).count() == 20 * asked.count()
    assert 0 < looked.value < 0.8 * asked.count() * e.count() * 64


def test_search_with_long_vectors_and_other_columns(spark):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.normal(size=3000 if i % 2 else 2500)], "x", 1.0) for i in range(60)]
    t = spark.createDataFrame(v, "vec_id long, embedding array<double>, rank string, score double").withColumn("weights", maxscore.weights(F.col("embedding")))
    w = {i: np.pad(np.floor(64 * np.array(x)), (0, 3000 - len(x))) for i, x, _, _ in v}
    got = {}
    for r in maxscore.top_k(t, t.where("vec_id < 5"), 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(5):
        best = sorted(((-int(w[q] @ w[i]), i) for i in w if i != q))[:7]
        assert [got[q][k] for k in range(1, 8)] == [(i, -x) for x, i in best]


# --- 5 secrets ---


def test_forest_on_findings_it_has_not_seen(spark, docs):
    common = secret_scan.dictionary(docs)
    model = secret_scan.train(spark, secret_scan.made_findings(1500, 1), common)
    from pyspark.ml.functions import array_to_vector

    other = spark.createDataFrame([(secret_scan.features(t, a, b, p, common), label) for t, a, b, p, label in secret_scan.made_findings(800, 2)], "features array<double>, label int").withColumn("features", array_to_vector("features"))
    out = model.transform(other)
    assert out.where("prediction = label").count() >= 0.97 * out.count()


def test_scan_finds_tokens_and_leaves_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = secret_scan.scan(docs, secret_scan.made_findings()).join(docs.select("doc_id", "text"), "doc_id").selectExpr("substring(text, start + 1, length) AS v", "is_secret").collect()
    assert all(r.is_secret == bool(re.fullmatch("[0-9a-fA-F]{40}", r.v)) for r in found) and any(r.is_secret for r in found)


def other_findings(n, seed):
    """Findings of shapes that made_findings() has none of."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    some = lambda chars, k: "".join(pick(chars) for _ in range(k))
    up, low, dig = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: pick(("river", "window", "garden", "ledger", "planet", "copper", "morning", "signal"))
    yes = (
        lambda: (f"aws_access_key_id = ", "AKIA" + some(up + dig, 16)),
        lambda: ("Authorization: Bearer ", "eyJ" + some(up + low + dig, 30) + "." + some(up + low + dig + "_-", 40)),
        lambda: ("DB_PASSWORD=", some(up + low + dig + "!#%", 11)),
        lambda: ("client_secret: ", f"{some(low + dig, 8)}-{some(low + dig, 4)}-{some(low + dig, 12)}"),
        lambda: (f"mysql://{word()}:", some(low + up + dig, 9) + "@db.example.com"),
    )
    no = (
        lambda: ("isbn ", f"978-{some(dig, 1)}-{some(dig, 4)}-{some(dig, 4)}-{some(dig, 1)}"),
        lambda: ("img src=", f"images/{word()}_{word()}_{some(dig, 2)}.png"),
        lambda: (f"{word()}: ", f"{word()}-{word()}"),
        lambda: ("file ", f"{word()}_{some(dig, 4)}_{word()}.tar.gz"),
        lambda: ("sha512: ", some("0123456789abcdef", 128)),
        lambda: ("mail ", f"{word()}{some(dig, 2)}@{word()}.org"),
        lambda: ("price=", f"EUR{some(dig, 4)}.{some(dig, 2)}"),
    )
    out = []
    for _ in range(n):
        label = int(rng.random() < 0.5)
        head, value = pick(yes if label else no)()
        head = f"{word()} {word()} " + head
        text = f"{head}{value} {word()} {word()}"
        at = [s for s in secret_scan.spans(text) if s[0] < len(head) + len(value) and s[1] > len(head)]
        out.append((text, *max(at, key=lambda s: s[1] - s[0], default=(0, 0)), "", label))
    return out


def test_forest_on_other_shapes(spark, docs):
    common = secret_scan.dictionary(docs)
    model = secret_scan.train(spark, secret_scan.made_findings(), common)
    from pyspark.ml.functions import array_to_vector

    seen = [f for f in other_findings(1000, 3)]
    df = spark.createDataFrame([(secret_scan.features(t, a, b, p, common), label) for t, a, b, p, label in seen if b > a], "features array<double>, label int").withColumn("features", array_to_vector("features"))
    hit = model.transform(df).groupBy("label", "prediction").count().collect()
    n = {(r.label, int(r.prediction)): r["count"] for r in hit}
    recall, precision = n.get((1, 1), 0) / sum(f[4] for f in seen), n.get((1, 1), 0) / max(1, n.get((1, 1), 0) + n.get((0, 1), 0))
    print("recall", recall, "precision", precision)
    assert recall >= 0.8 and precision >= 0.8


def test_candidates_of_any_kind():
    cases = {'password = "hunter22"': ["hunter22"], "pwd: a.b!c@d$e": ["a.b!c@d$e"], "ftp://joe:s3cr.t@host/": ["s3cr.t"], "my token is Zq9-x": ["Zq9-x"], "plain words only, nothing else": [], "x " + "f" * 20 + " y": ["f" * 20], "see 12ab34cd56.": ["12ab34cd56"], "abcdefgh ijklmnop": [], "key=" + "A1" * 15: ["A1" * 15]}
    assert {t: [t[a:b] for a, b in secret_scan.spans(t)] for t in cases} == cases


def test_scores_by_brute_force(spark, docs):
    """Every row is a candidate of its text, with the forest's own probability of its features."""
    findings = secret_scan.made_findings(400)
    common = secret_scan.dictionary(docs)
    model = secret_scan.train(spark, findings, common)
    from pyspark.ml.linalg import Vectors

    want = sorted((r.doc_id, a, b - a, round(float(np.mean([t.predictProbability(Vectors.dense(secret_scan.features(r.text, a, b, "", common)))[1] for t in model.trees])), 9)) for r in docs.collect() for a, b in secret_scan.spans(r.text or ""))
    got = sorted((r.doc_id, r.start, r.length, round(r.score, 9)) for r in secret_scan.scan(docs, findings).collect())
    assert got == want and want


def test_scan_of_odd_rows(odd, empty):
    f = secret_scan.made_findings(200)
    got = secret_scan.scan(odd, f).collect()
    assert {r.doc_id for r in got} == {6} and not any(r.is_secret for r in got)
    assert secret_scan.scan(empty, f).count() == 0
    assert secret_scan.scan(odd, [x for x in f if x[4] == 0]).where("score > 0").count() == 0


# --- 6 quality classifier ---


def test_classifier_on_documents_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries()["op6_quality_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.count("*"), F.count_if(F.expr("quality = predicted")), F.count_if(F.expr("quality = 1 AND predicted = 1")), F.count_if(F.expr("quality = 1"))).first()
    assert r[1] >= 0.9 * r[0] and r[2] >= 0.95 * r[3]


def test_scores_of_the_classifier_by_brute_force(spark, docs):
    """Context sums word by word, and the network's formula number by number."""
    some = docs.where("doc_id < 25")
    B, D = quality_model.BUCKETS, quality_model.DIM
    places, signs = quality_model._index_vectors()
    sums, counts, texts = np.zeros((B, D)), np.zeros(B), {}
    for r in some.collect():
        ids = [zlib.crc32(p) % B for w in (r.text or "").encode().split() for p in quality_model._PARTS.findall(w)]
        texts[r.doc_id] = ids
        for i, x in enumerate(ids):
            counts[x] += 1
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    np.add.at(sums[x], places[ids[j]], signs[ids[j]])
    v = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) * (1e-3 / (1e-3 + counts / counts.sum()))[:, None]
    got = quality_model.word_vectors(some)
    assert np.abs(got - v).max() < 1e-6
    rng = np.random.default_rng(0)
    net = quality_model.Network(rng.normal(size=3 * D), np.ones(3 * D), rng.normal(size=(3 * D, 4)), rng.normal(size=4), rng.normal(size=4), 0.1, 1.7)
    for r in quality_model.score(some, got, net).collect():
        x = np.zeros(3 * D)
        if ids := texts[r.doc_id]:
            w = got[ids].astype(float)
            x = np.concatenate([w.mean(0), w.std(0), np.sqrt(((w[1:] - w[:-1]) ** 2).sum(0) / len(ids))])
        z = np.tanh((x - net.mean) @ net.w1 + net.b1) @ net.w2 + 0.1
        assert abs(r.score - 1 / (1 + np.exp(-z / 1.7))) < 1e-4


def test_rows_that_share_a_labelled_id_are_one(odd, spark):
    v = quality_model.word_vectors(odd)
    labels = spark.createDataFrame([(7, 1), (5, 0)], "doc_id long, label int")
    many = odd.where("doc_id = 7").crossJoin(spark.range(50)).drop("id").union(odd)
    a, b = quality_model.train(odd, labels, v), quality_model.train(many, labels, v)
    assert np.allclose(a.w1, b.w1)


def test_classifier_on_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, None), (99, 1), (None, 0)], "doc_id long, label int")
    v = quality_model.word_vectors(odd)
    out = quality_model.score(odd, v, quality_model.train(odd, labels, v))
    assert out.count() == odd.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert quality_model.word_vectors(empty).shape == (quality_model.BUCKETS, quality_model.DIM)
    none = quality_model.train(odd, labels.limit(0), v)
    assert quality_model.score(odd, v, none).where("score != 0.5").count() == 0


# --- 7 packing ---


def test_pieces_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    packed = packing.pack_documents(docs).collect()
    want = set()
    for r in docs.collect():
        ids = np.array(tk.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want |= {(r.doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed} == want
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 4096 and all(a == sum(n for _, n in sorted(s)[:i]) for i, (a, _) in enumerate(sorted(s))) for s in by.values())
    assert len(by) <= -(-sum(r.length for r in packed) // 4096) + 3


def test_placement_is_the_smallest_sum_of_squares():
    rng = np.random.default_rng(3)
    lengths, cap = rng.integers(1, 17, 300), 16
    seq, off = packing.place(lengths, cap)
    gaps = Counter()
    for s, o in zip(lengths.tolist(), off.tolist()):
        def after(g):
            c = gaps.copy()
            if g < cap:
                c[g] -= 1
            if g > s:
                c[g - s] += 1
            return sum(v * v for v in c.values())
        options = [g for g in range(s, cap) if gaps[g]] + [cap]
        assert after(cap - o) == min(map(after, options))
        g = cap - o
        if g < cap:
            gaps[g] -= 1
        if g > s:
            gaps[g - s] += 1


def test_packing_of_odd_rows(odd, empty):
    got = packing.pack_documents(odd, with_ids=True)
    assert got.where("doc_id = 2 OR doc_id = 3 OR doc_id = 4").select("length").distinct().collect()[0][0] == 1
    assert packing.sequences(got).agg(F.sum(F.length("ids")) / 4).first()[0] == got.agg(F.sum("length")).first()[0]
    assert packing.pack_documents(empty).count() == 0


def test_a_shard_is_held_once_and_goes_out_batch_by_batch():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 4096, (6, 500))
    want, at = packing.place(np.sort(lengths.ravel())[::-1])
    held = [pa.RecordBatch.from_pydict({"doc_id": list(range(k * 500, k * 500 + 500)), "length": pa.array(n), "ids": [b"i" * (4 * x) for x in n.tolist()]}) for k, n in enumerate(lengths)]
    before, one = pa.total_allocated_bytes(), max(b.nbytes for b in held)
    used, ids, sums = [], [], Counter()
    for k, b in enumerate(packing.placed(held, 4096, 7 << 32)):
        used.append(pa.total_allocated_bytes() - before)
        assert len(held) == 5 - k and b.column("length").to_pylist() == lengths[k].tolist() == [len(x) // 4 for x in b.column("ids").to_pylist()]
        ids += b.column("doc_id").to_pylist()
        for s, n in zip(b.column("sequence_id").to_pylist(), b.column("length").to_pylist(), strict=True):
            sums[s - (7 << 32)] += n
    assert ids == list(range(3000)) and max(used) < one  # no second copy of the shard, nor of much of it
    assert sums == {s: int(np.sort(lengths.ravel())[::-1][want == s].sum()) for s in set(want.tolist())} and max(sums.values()) <= 4096


def test_workers_give_back_what_they_freed():
    from sphaera.llm import common

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    stays = []

    def run(batches):
        for b in batches:
            blocks = [np.ones(60_000, np.uint8) for _ in range(5000)]  # 300 MB below the size that malloc maps
            stays.append(blocks[-1])  # what is above keeps malloc from trimming by itself
            del blocks
            yield b

    at = resident()
    assert list(common.tidied(run)(iter([1, 2]))) == [1, 2] and common.tidied(run).__name__ == "run"
    assert resident() - at < 100


def test_packing_of_ties_and_shards_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 10_000)
    df = spark.createDataFrame([(i // 2, "the cat sat") for i in range(60)] + [(99, "word " * 9000)], "doc_id long, text string")
    got = packing.pack_documents(df).collect()
    assert sum(r.length for r in got) > 9000 and len(got) == 60 + -(-9001 // 4096)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        ends = [0]
        for a, n in sorted(s):
            assert a == ends[-1]
            ends.append(a + n)
        assert ends[-1] <= 4096


def test_special_tokens_are_matched_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    for t in ("<|endoftext|>x Y", "A<|STARTOFTEXT|>b", "Don't STOP!!! it's 42%", "É e\u0301 x\u00a0y ...", "a.b,c d's", "5's 'tis ''s"):
        assert packing._ids(t.encode(), packing._words(packing.tokenizer_path())) == np.array(tk.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()


# --- 8 URL filters ---


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    h = re.match(r"[^/?#]*", rest).group()
    return low(h), re.match(r"[^?#]*", rest[len(h) :]).group()


def test_urls_parts_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?y", "https://org/", "x://org", None, "", "no scheme", "a://b://c/d", "http://xorg/", "http://example.org/en/12#z", "http://example.org/en/2", "http://shop.com/fr/1", "http://COM/de/", "http://com", "ftp://Ä.com/FR/", "http://h?q=/fr/", "http://é.example.org/es"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(urls):
        h, p = parts(u)
        fits = [(a + b, v) for a, b, v in url_filter.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, key=lambda r: len(r[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, best[0])
        assert got[i].verdict == (best[1] or got[i].verdict) and got[i].verdict in ("allow", "block")


def brute_scores(urls, judged, order):
    """Interpolated Witten-Bell, symbol by symbol: grams of more than two symbols from LEAST occurrences on."""
    count = {True: Counter(), False: Counter()}
    for u, y in urls:
        s = url_filter.START + low(u)
        for i in range(1, len(s)):
            for n in range(1, min(i + 1, order + 1) + 1):
                count[y][s[i - n + 1 : i + 1]] += 1
    kept = {g for y in count for g in count[y] if len(g) <= 2 or count[True][g] + count[False][g] >= url_filter.LEAST}
    by_context = {}
    for g in kept:
        by_context.setdefault(g[:-1], []).append(g)
    A = sum(len(g) == 1 for g in kept) + 1

    def p(y, context, c):
        if context is None:
            return 1 / A
        lower = p(y, context[1:] if context else None, c)
        n = [count[y][g] for g in by_context.get(context, [])]
        total, kinds = sum(n), sum(x > 0 for x in n)
        own = count[y][context + c] if context + c in kept else 0
        return (own + kinds * lower) / (total + kinds) if total else lower

    out = {}
    for u in judged:
        s = url_filter.START + low(u)
        terms = [np.log(p(True, s[max(0, i - order) : i], s[i])) - np.log(p(False, s[max(0, i - order) : i], s[i])) for i in range(1, len(s))]
        out[u] = sum(terms) / len(terms) if terms else 0.0
    return out


@pytest.mark.parametrize("hot", [None, 3])
def test_language_models_by_brute_force(spark, monkeypatch, hot):
    if hot:  # the way of tables too large to broadcast
        monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 10)
        monkeypatch.setattr(url_filter, "HOT", hot)
    urls = [("http://aa/b", True), ("http://ab/9", True), ("https://zz/?q", False), ("x_~ö", False), ("http://aa/bc", False), ("http://aa/bd", True)]
    judged = ["", "http://aa/b", "http://ab/77", "ö", "zz", "https://Zz/?q=ü"]
    for order in (2, 5):
        model = url_filter.train(spark.createDataFrame(urls, "url string, accepted boolean"), order)
        got = {r.url: r.score for r in url_filter.score(spark.createDataFrame([(u,) for u in judged], "url string"), model, order).collect()}
        assert got == pytest.approx(brute_scores(urls, judged, order), abs=1e-4)


def test_verdicts_by_brute_force(spark):
    """The query's scores, threshold and verdicts from its pages alone."""
    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(5)).alias("fold")).collect()
    got = {r.page_id: r for r in url_filter.judge(spark.read.parquet(f"{d}/pages.parquet")).collect()}

    def ruled(u):
        h, p = parts(u)
        fits = [(a + b, v) for a, b, v in url_filter.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return max(fits, key=lambda r: len(r[0]), default=(None, None))[1]

    known = [(r.url, ruled(r.url) == "allow", r.fold) for r in pages if ruled(r.url)]
    want = brute_scores([(u, y) for u, y, f in known if f], {r.url for r in pages}, url_filter.ORDER)
    bin_ = lambda s: min(url_filter.BINS - 1, max(0, int(np.floor((s + url_filter.SPAN) / (2 * url_filter.SPAN) * url_filter.BINS))))
    yes, no = ([bin_(got_score) for u, y, f in known if f == 0 and y == kind for got_score in (want[u],)] for kind in (True, False))
    gain = [sum(b < k for b in no) / max(1, len(no)) - sum(b < k for b in yes) / max(1, len(yes)) for k in range(url_filter.BINS)]
    best = [k for k, g in enumerate(gain) if g == max(gain)]
    cut = np.mean(best) / url_filter.BINS * 2 * url_filter.SPAN - url_filter.SPAN if yes and no else 0.0
    for r in pages:
        g = got[r.page_id]
        assert abs(g.score - want[r.url]) < 1e-4
        assert g.verdict == (ruled(r.url) or ("allow" if g.score >= cut else "block")) or abs(g.score - cut) < 1e-4


def test_long_urls_ties_and_other_columns(spark):
    long_ = "http://q.net/" + "abc/" * 5000
    df = spark.createDataFrame([(1, long_, "h", "p"), (1, long_, "h", "p"), (2, None, "h", "p"), (3, "", None, None), (4, "http://a.org/x", "", ""), (5, "http://b.com/de/x", "", "")], "page_id long, url string, host string, score string")
    got = sorted((r.page_id, r.host, r.verdict) for r in url_filter.judge(df, keep=("page_id", "score")).select("page_id", "host", "verdict").collect())
    assert len(got) == 6 and got[0] == got[1] and got[0][1] == "q.net" and got[-1][2] == "block" and got[-2][2] == "allow"


def test_urls_without_anything_to_learn_from(spark):
    df = spark.createDataFrame([(1, "http://q.net/a"), (2, None)], "page_id long, url string")
    assert {(r.verdict, r.score) for r in url_filter.judge(df).collect()} == {("allow", 0.0)}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_learned_verdicts_follow_what_they_learned(spark):
    good, bad = [f"http://x.org/recipes/{i}" for i in range(60)], [f"http://y.com/de/casino-win-{i}" for i in range(60)]
    df = spark.createDataFrame([(0, u) for u in good + bad] + [(1, "http://z.net/recipes/5"), (2, "http://z.net/casino-win-7")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df).where("page_id > 0").collect()}
    assert got == {1: "allow", 2: "block"}


# --- 9 chat formatting ---


def test_escapes_come_back(spark):
    texts = ["", "\\", "<", "\\b", "\\l", "</turn>", "<turn>", "\\### Assistant: </turn> ok", "a\\\\l<\n\n", "\\\\\\l\\b<<", None]
    df = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.format_log(chat.as_events(df)).select(chat.parse(chat.formatted(F.col("turns"))).alias("t"), chat.loss_text(F.col("turns")).alias("loss")).first()
    assert [(t.role, t.text) for t in out.t] == [("user" if i % 2 else "assistant", t or "") for i, t in enumerate(texts)]
    assert out.loss == "".join(t or "" for t in texts[::2])


def test_roles_come_back(spark):
    roles = ["us\ner", "\\n", "", None, "a\\nb\n<", "assistant"]
    df = spark.createDataFrame([(1, i, r, "he\nllo" * 700) for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    out = chat.format_log(chat.as_events(df)).select(chat.parse(chat.formatted(F.col("turns"))).alias("t")).first()
    assert [(t.role, t.text) for t in out.t] == [(r or "", "he\nllo" * 700) for r in roles]


def test_very_long_turns_and_clashing_columns(spark):
    long_ = "ö<\\ " * 100_000
    df = spark.createDataFrame([(1, 0, "assistant", long_, "x", 1), (1, 0, "assistant", long_, "x", 1), (1, 0, "assistant", "b", "y", 2)], "conv_id long, turn long, role string, text string, type string, seq int")
    out = chat.format_log(chat.as_events(df)).select(chat.parse(chat.formatted(F.col("turns"))).alias("t"), chat.loss_text(F.col("turns")).alias("loss")).first()
    assert [t.text for t in out.t] == ["b", long_, long_] and out.loss == "b" + long_ + long_
    assert chat.as_events(df).where("type = 'delta'").count() == 2 * 400 + 1


def test_deltas_edits_and_regenerations_fold(spark):
    log = [(1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "he"), (1, 4, "delta", 2, None, "llo"), (1, 5, "message", 3, "user", "more"), (1, 6, "message", 4, "assistant", "ans"), (1, 7, "regenerate", 2, None, None), (1, 8, "delta", 2, None, "bye"), (1, 9, "message", 5, "user", "ok"), (1, 10, "edit", 1, None, "hey"), (None, 1, "delta", 1, None, "only"), (2, 1, "message", 1, None, None)]
    df = spark.createDataFrame(log, "conv_id long, seq long, type string, message long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in chat.format_log(df).select("conv_id", chat.parse(chat.formatted(F.col("turns"))).alias("t")).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "bye"), ("user", "ok")], None: [("assistant", "only")], 2: [("", "")]}


def test_repeated_turns_and_empty_logs(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, "n")], "conv_id long, turn long, role string, text string")
    out = chat.format_log(chat.as_events(df)).select(chat.parse(chat.formatted(F.col("turns"))).alias("t")).first()
    assert [(t.role, t.text) for t in out.t] == [("", "n"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.format_log(chat.as_events(df.limit(0))).count() == 0


# --- 10 SimHash ---


def brute_groups(docs, shingle=3):
    fps = []
    for i, t in docs:
        w = WORD.findall(low(t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[k : k + shingle] for k in range(len(w) - shingle + 1)] or [w])] if w else []
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    arr = np.array([f for _, f in fps], np.uint64)
    group = list(range(len(fps)))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(arr ^ a) <= 2) for a in arr]
    while changed:
        new = [min(group[j] for j in n) for n in near]
        changed, group = new != group, new
    least = {}
    for (i, _), g in zip(fps, group):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    return sorted(((i, f"{f:016x}", least[g]) for (i, f), g in zip(fps, group)), key=repr)


def digest(df):
    return sorted(((r[0], f"{r[1] & (1 << 64) - 1:016x}", r[2]) for r in df.select("doc_id", "fp", "component_id").collect()), key=repr)


@pytest.mark.parametrize("cap", [64, 1])
def test_groups_equal_brute_force(docs, cap):
    assert digest(simhash.groups(docs, cap=cap)) == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_of_odd_rows(odd, empty):
    assert digest(simhash.groups(odd)) == brute_groups([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.groups(empty).count() == 0


@pytest.mark.parametrize("cap", [64, 2])
def test_crowded_cells_lose_no_link(spark, cap):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    fps = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (60, 2))} | set(base)
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), cap)
    from sphaera.llm.graphs import components

    got = {r.node: r.root for r in components(links).collect()}
    arr = sorted(fps)
    want = {x: x for x in arr}
    for _ in arr:
        new = {x: min(want[y] for y in arr if bin(x ^ y).count("1") <= 2) for x in arr}
        if new == want:
            break
        want = new
    assert {x: got.get(x, x) for x in arr} == want


def test_near_dedup_keeps_one_of_each_group(odd):
    out = simhash.near_dedup(odd)
    assert out.columns == odd.columns
    kept = sorted((r.doc_id for r in out.collect()), key=repr)
    # 1 and 9 differ in text; 2, 3 and 4 have no words; 7 is there twice alike and once otherwise; rows without id stay.
    assert kept.count(None) == 2 and kept.count(7) == 1 and kept.count(2) == 1 and 3 not in kept and 4 not in kept and {1, 5, 6, 8, 9} <= set(kept)


def test_near_dedup_equals_brute_force_jaccard(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 5000)}"
    texts = []
    for base in ([word() for _ in range(n)] for n in (30, 90, 300, 1200)):
        for changes in (0, 1, 2, 4, 6, 12, 40):
            w = list(base)
            for i in rng.choice(len(w), min(changes, len(w) // 4), replace=False):
                w[i] = word()
            wide = 9 + changes  # the copies are wrapped otherwise
            texts.append((len(texts) * 7 % 29, "\n".join(" ".join(w[i : i + wide]) for i in range(0, len(w), wide))))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    by_print = {r.doc_id for r in simhash._one_of_each(df, 5, 64).collect()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for d, t in texts if (w := low(t).split())}
    want = {d for d in by_print if not any(5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]) for e in by_print if e < d)}
    assert {r.doc_id for r in simhash.near_dedup(df).collect()} == want and len(want) < len(by_print)


def test_rows_without_id_are_judged(spark):
    line, other = "one two three four five six", "lots of other words stand here now"
    long_ = " ".join(f"v{i}" for i in range(300))
    near = long_.replace("v150 ", "x ").replace("v20 ", "y ")
    df = spark.createDataFrame([(None, f"{line}\n{line}\n{other}"), (None, f"{other} too\nsome\nthing"), (1, line), (2, f"alone\n{line}"), (2, "apart\nfrom it")], "doc_id long, text string")
    got = sorted((tuple(r) for r in line_dedup.removed(df).collect()), key=repr)
    # Null rows are one document, ordered by line number; what goes from one row stays in the other, whose words there are others.
    assert got == sorted([(None, 2, "1,2"), (None, 0, ""), (1, 1, "0"), (2, 1, "1"), (2, 0, "")], key=repr)
    copies = spark.createDataFrame([(None, long_), (None, long_), (None, near), (None, None), (None, ""), (None, other), (5, other)], "doc_id long, text string")
    kept = [(r.doc_id, (r.text or "")[:4]) for r in simhash.near_dedup(copies).collect()]
    assert sorted(kept, key=repr) == sorted([(None, long_[:4]), (None, ""), (None, other[:4]), (5, other[:4])], key=repr)
