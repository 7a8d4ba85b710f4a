"""Token counts, phrase mining and fill-in-middle against the library, brute force and SQL, and on odd inputs."""

import hashlib
import random
import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sphaera.llm import fill_middle, phrases, token_count
from sphaera.llm.queries import oracle_sql, queries
from test_ops import empty, odd  # noqa: F401  fixtures


@pytest.mark.parametrize("name", ["op12_phrases", "op13_fill_middle"])
def test_query_against_sql(spark, data, duck, name):
    assert rows(queries()[name](spark, data)) == rows(duck.execute(oracle_sql()[name]).df())


# --- 11 token counts ---


@pytest.fixture(scope="module")
def proof():
    return token_count.prove()


@pytest.fixture(scope="module")
def library(proof):
    return token_count._library(proof.path)


def test_token_counts_are_the_librarys(spark, data, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    found = queries()["op11_token_counts"](spark, data).collect()
    assert len(found) == len(docs)
    for r in found:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def test_counts_of_odd_strings(proof, library):
    counter, rng = token_count.Counter(proof), random.Random(3)
    some = list(" \t\n\r 　​'sdtmrevl019x́é中文\U0001f600\U00020000½²Ⅷ#$%<|>\x1c\x1f\x85՘꟏꟒")
    for _ in range(3000):
        s = "".join(rng.choice(some) for _ in range(rng.randint(0, 30)))
        s = s[:5] + "<|endoftext|>" + s[5:] if rng.random() < 0.3 else s
        assert counter.count(s) == len(library.encode(s, add_special_tokens=False).ids), s


def test_code_points_and_parts_of_long_texts(proof, library, monkeypatch):
    monkeypatch.setattr(token_count, "PART", 1000)
    text = "".join(f"{chr(i)}x{chr(i)}{chr(i)} 1{chr(i)}" for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3000 or i % 17 == 0))
    assert token_count.Counter(proof).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_shortcut_saves_merges(proof):
    counter = token_count.Counter(proof)
    assert counter.count("The river was wide, and the house stood on the other side.") == 14 and counter.merged == 0
    assert counter.count(" qzxvqzxv") > 1 and counter.merged == 1


def test_cache_is_bounded(proof, library, monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 5)
    counter, text = token_count.Counter(proof), " ".join(f"zq{i}xv" for i in range(40))
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(counter) <= len(proof.whole) + 60


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_count.prove(token_count.tokenizer_path("word_bpe_49k.json"))


def test_token_counts_odd_rows(odd, empty, library):  # noqa: F811
    got = token_count.count_tokens(odd)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert token_count.count_tokens(empty).count() == 0


# --- 12 phrases ---


def mined(docs, least=30, most=2000, covered=80):
    """The contract, word by word."""
    f, n = {}, {}
    for lang, text in docs:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    g = (lang, *words[i : i + m])
                    f[g] = f.get(g, 0) + 1
    found = {g: a for g, a in f.items() if a >= least and len(g) > 2}
    out = {}
    for g, a in found.items():
        w = g[1:]
        longer = (x for x in found if x[0] == g[0] and len(x) > len(g) and any(x[1 + i : 1 + i + len(w)] == w for i in range(len(x) - len(g) + 1)))
        if any(100 * found[x] >= covered * a for x in longer):
            continue
        cuts = [(SCALE * a // (f[(g[0], *w[:k])] + f[(g[0], *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(g[0], []).append((-score, -a, " ".join(w).encode(), f[(g[0], *w[:k])], f[(g[0], *w[k:])]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows_ in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:most], 1))


SCALE = 2_000_000


def some_docs(seed, n=60):
    rng = random.Random(seed)
    few = ["a", "b", "C", "\x01", "a\x01", "é", "ZU", "\u00a0", "\x0b", "..", "!", "\n", "\t"]
    return [(rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choice(few[: rng.randint(2, 13)]) for _ in range(rng.randint(0, 60)))) for _ in range(n)] + [("en", None), (None, "")]


@pytest.mark.parametrize("seed,shard,slice_", [(1, 1 << 20, 1 << 22), (2, 50, 5), (3, 2, 20)])
def test_phrases_by_hand(spark, monkeypatch, seed, shard, slice_):
    """Shards as small as a word give what whole ones give."""
    monkeypatch.setattr(phrases, "SLICE", slice_)
    docs = some_docs(seed)
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("n", F.lit("clash")).repartition(3)
    got = phrases.top_phrases(df, 6, 40, 80, shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = mined(docs, 6, 40)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_radix_runs():
    import numpy as np

    rng = np.random.default_rng(1)
    for high in (1, 2, 300, 1 << 20, 1 << 63):
        x = rng.integers(0, high, 5000, dtype=np.uint64)
        codes, n = phrases.runs(x)
        want = np.unique(x, return_counts=True)
        assert (codes == want[0]).all() and (n == want[1]).all()
    assert len(phrases.runs(np.empty(0, np.uint64))[0]) == 0


def test_runs_across_batches(spark):
    """A key with rows from many shards is added up over the batches of its task."""
    made = spark.range(30_000).selectExpr("unhex(concat('0000000', CAST(id % 3 AS STRING), '000000000000000000000000')) AS key", "id AS shard", "id AS code", "1L AS n")
    got = phrases._counted(made, 10_000).groupBy("key", "f").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("one")).collect()
    assert len(got) == 3 and all((r.f, r.n, r.one) == (10_000, 10_000, 1) for r in got)
    assert phrases._counted(made, 10_001).count() == 0


def test_scores_beyond_64_bits(spark):
    key = "unhex('{}')".format
    word = spark.sql(f"SELECT {key('00000001' + '0' * 24)} AS key, 4000000000000000 AS f, 'en' AS lang")
    pair = spark.sql(f"SELECT {key('0000000100000001' + '0' * 16)} AS key, 2 AS words, 3999999999999999 AS f")
    assert phrases.scored(word, pair).first().score == 2_000_000 * 3999999999999999 // 8000000000000000


def test_longer_phrases_below_the_best_pairs_are_cut_once(spark):
    """All but those that can't be among the first `most` are scored as without it."""
    df = spark.createDataFrame(some_docs(4, 200), "lang string, text string")
    with phrases.Steps() as steps:
        words, found, _ = phrases.frequent(df, steps, 6)
        whole = {bytes(r.key): tuple(r) for r in phrases.scored(words, found).collect()}
        some = {bytes(r.key): tuple(r) for r in phrases.scored(words, found, most=3).collect()}
    assert some.items() <= whole.items() and len(some) < len(whole)
    for lang in {r[6] for r in whole.values()}:
        scores = sorted((r[5] for r in whole.values() if r[6] == lang), reverse=True)
        least = scores[min(3, len(scores)) - 1]
        assert all(k in some for k, r in whole.items() if r[6] == lang and r[5] >= least)


def test_phrases_are_scored_without_a_row_for_each(spark, monkeypatch):
    """Tables of the steps after the dictionary have rows of arrays, and at the end the best of each task only; they hold what rows and joins give."""
    from sphaera.llm import common

    sizes, put = {}, common.stored

    def told(df, name):
        out = put(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(common, "stored", told)
    monkeypatch.setattr(phrases, "stored", told)
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(5)
    df = spark.createDataFrame([("en", " ".join(rng.choice(words) for _ in range(300))) for _ in range(200)], "lang string, text string").coalesce(2)
    got = sorted((r.phrase, r.a, r.l, r.r, r.score) for r in phrases.top_phrases(df, 6, 5).collect())
    assert {k: n for k, n in sizes.items() if k not in ("shards", "words", "ranges", "dictionary") and n > 200} == {}
    monkeypatch.undo()
    with phrases.Steps() as steps:
        words, found, _ = phrases.frequent(df, steps, 6)
        assert found.count() > 1600
        rows_ = phrases.scored(words, found).orderBy(F.desc("score"), F.desc("a")).limit(6).collect()
        word = {r.id: r.word.decode() for r in words.collect()}
    spelt = [(" ".join(word[int.from_bytes(r.key[i : i + 4], "big")] for i in range(0, 4 * r.words, 4)), r.a, r.l, r.r, r.score) for r in rows_]
    assert spelt[4][4] > spelt[5][4] and got == sorted(spelt[:5])


def test_pairs_are_made_where_shards_lie(spark):
    """A shard is one row: its pairs need no shuffle of it."""
    coded = spark.sql("SELECT 0L AS shard, 0L AS lead, CAST('' AS BINARY) AS numbers, CAST('' AS BINARY) AS ids")
    plan = phrases._made(coded, None, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Arrow" in plan


def test_shuffle_files_of_steps_go_when_they_end(spark):
    """The next step doesn't find those of the one before on the disk, and a session's setting stays as it was."""
    disk, key = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def held():
        found = disk.getAllBlocks()
        return {x for x in (found.apply(i).name() for i in range(found.size())) if x.startswith("shuffle_")}

    setting = spark.conf.get(key)
    df, before = spark.createDataFrame(some_docs(6), "lang string, text string"), held()
    assert len(phrases.top_phrases(df, 6, 40).collect()) > 20 and spark.conf.get(key) == setting
    for _ in range(20):  # they are deleted in the background
        if held() - before:
            time.sleep(0.25)
    assert held() <= before


def test_scores_in_two_steps_are_exact():
    import numpy as np

    a = np.array([30, 31, 4_000_000_000_000_000, 3_999_999_999_999_999])
    both = np.array([60, 1_000_003, 8_000_000_000_000_001, 7_999_999_999_999_999])
    assert phrases._score(a, both).tolist() == [SCALE * x // y for x, y in zip(a.tolist(), both.tolist(), strict=True)]


@pytest.mark.parametrize("lot,long", [(1, True), (7, False), (1 << 19, True)])
def test_packed_keys_are_added_up_in_lots(monkeypatch, lot, long):
    """A shard's keys go as arrays, a row for each bucket; lots of any size give the same sums."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(phrases, "LOT", lot)
    rng, made, want = np.random.default_rng(lot), [], {}
    for shard in range(5):
        key = np.unique(rng.integers(0, 60, (300, 2)), axis=0).astype(np.uint64)
        n = rng.integers(0, 4, len(key))
        made.append(phrases._pack(shard, key[:, 0], key[:, 1] if long else None, np.arange(len(key), dtype=np.uint64), n))
        assert made[-1].num_rows <= len(key)
        for k, x, i in zip(map(tuple, key.tolist()), n.tolist(), range(len(key)), strict=True):
            want.setdefault(k if long else (k[0], 0), []).append((shard, i, x))
    rows_ = pa.Table.from_batches(made).sort_by("bucket")
    want = {k: (sum(x for _, _, x in v), sorted(v[:2] for v in v)) for k, v in want.items()}
    got, firsts = {}, {}
    for shard, code, high, low, f, first in phrases._sums(iter(rows_.to_batches(max_chunksize=3)), 4):
        assert (np.diff(shard) >= 0).all()
        for s, c, k, x, one in zip(shard.tolist(), code.tolist(), zip(high.tolist(), low.tolist(), strict=True), f.tolist(), first.tolist(), strict=True):
            got.setdefault(k, (x, []))[1].append((s, c))
            firsts[k] = firsts.get(k, 0) + one
    assert {k: (x, sorted(v)) for k, (x, v) in got.items()} == {k: v for k, v in want.items() if v[0] >= 4} and set(firsts.values()) == {1}


def test_phrases_odd_rows(odd, empty):  # noqa: F811
    got = sorted(map(tuple, phrases.top_phrases(odd, 2).collect()))
    want = mined([(r.lang, r.text) for r in odd.select("lang", F.when(F.length("text") < 1000, F.col("text")).alias("text")).collect()], 2)
    few = [(x[0], x[2], *x[3:6]) for x in want]
    assert {x for x in few} <= {(x[0], x[2], *x[3:6]) for x in got} or len(got) == 2000
    assert phrases.top_phrases(empty).count() == 0


# --- 13 fill in the middle ---


def by_hand(doc_id, text, rule=fill_middle.Rule()):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text) if rule.units == "line" else re.findall(r"\A\s+\S+\s*|\S+\s*|\A\s+\Z", text)
    h = hashlib.sha256(f"{rule.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(m in text for m in (rule.prefix, rule.suffix, rule.middle)) or h3 % 100 >= rule.rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < rule.spm:
        return doc_id, n, "spm", len(p), len(m), rule.suffix + s + rule.prefix + p + rule.middle + m
    return doc_id, n, "psm", len(p), len(m), rule.prefix + p + rule.suffix + s + rule.middle + m


TEXTS = ["", None, "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "x <P", "x <P>", "<S", "<<S><", "<\nP>", "é\n中文\n\U0001f600", "<S>\n<M>", "line " * 500 + "\n" + "<" * 300, "".join(f"{i} äö\n" for i in range(900)), "y" * 5000, ("z" * 255 + "\n") * 7]


@pytest.mark.parametrize("giant,block", [(1 << 22, 1 << 20), (0, 19), (40, 64), (100, 1000)])
def test_outputs_by_hand(spark, giant, block):
    texts = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "one\ntwo\nthree\n"), (5, "again\nand again\n"), (5, "again\nand again\n")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    got = fill_middle.transform(docs, giant=giant, block=block)
    back = got.select(fill_middle.restored(F.col("output"), F.col("form")).alias("t"), "doc_id").collect()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((by_hand(*t) for t in texts), key=repr)
    assert sorted(((r.doc_id, r.t) for r in back), key=repr) == sorted(((i, t or "") for i, t in texts), key=repr)


@pytest.mark.parametrize("giant", [1 << 22, 0])
def test_other_rules(spark, giant):
    rule = fill_middle.Rule("word", "[pre]", "[suf]", "[mid]", 11, 60, 20)
    texts = [(i, t) for i, t in enumerate(["  lead a b c", "one", " ", "a b [mid] c", "tab\tand\nline  end ", *(f"w{i} " * i for i in range(1, 40))])]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    got = fill_middle.transform(docs, rule, giant, 16)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((by_hand(*t, rule) for t in texts), key=repr)
    assert {r.form for r in got.collect()} == {"plain", "spm", "psm"}


def test_chunks_compose_from_any_state():
    """Functions of chunks, composed in any grouping, are those of the whole."""
    import numpy as np

    rng = random.Random(5)
    for a in (fill_middle.lines(), fill_middle.words(), fill_middle.finder(("<P>", "<S>", "<M>"))):
        for _ in range(30):
            text = np.frombuffer("".join(rng.choice("a\n <P>SM") for _ in range(rng.randint(1, 90))).encode(), np.uint8)
            want = []
            for s in range(len(a.step)):
                n = 0
                for k in a.kinds[text]:
                    n += int(a.begins[s, k])
                    s = int(a.step[s, k])
                want.append((s, n))
            for size in (1, 2, 7, 64):
                chunks = fill_middle._cut(text, size)
                state, begun = fill_middle.compose(*fill_middle.functions(*chunks, a), np.zeros(len(chunks[1]), np.int64))
                assert [(int(x), int(y)) for x, y in zip(state[:, -1], begun[:, -1])] == want


def test_overlapping_sentinels_are_refused(odd):  # noqa: F811
    for marks in (("<P", "P>", "x"), ("aba", "x", "y"), ("ab", "b", "x"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fill_middle.transform(odd, fill_middle.Rule("line", *marks))


def test_fill_middle_odd_rows(odd, empty):  # noqa: F811
    got = sorted(map(tuple, fill_middle.transform(odd).collect()), key=repr)
    assert got == sorted((by_hand(r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert fill_middle.transform(empty).count() == 0 and fill_middle.transform(empty).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
