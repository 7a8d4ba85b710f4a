"""Secret scans: candidates by patterns, false positives removed by a random forest.

Candidates are runs of LEAST or more letters, digits and "+/=_-"; what follows an assignment or a credential word, from ASSIGNED
characters on; passwords within URLs, of any length; and runs of MIXED or more characters with letters and digits. Of those that overlap
the longest counts, a password in a URL above all, then one that is named by what stands before it. A value ends at white space, in quotes too:
of a quoted phrase of several words the first is the candidate. Features are the length, the makeup and transitions of the characters, how much of them a dictionary covers, the path
and the words around. The dictionary is a table of counts of runs of four letters over all documents, hashed to TABLE slots (1 MB),
so that its size doesn't grow with the corpus. The forest is trained from labelled findings with Spark's own trees, and applied as a map.

Nulls and edges: a null or empty text has no candidates; doc_id may be null or repeated, each row is scanned by itself; a null
path is an empty one; starts and lengths count code points; with findings of one label only, every score is that label; other
columns are not read; an empty table gives no findings.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, dense, read, sparse, tree_sum, utf8

LEAST, ASSIGNED, MIXED = 20, 4, 8
TABLE, PARTS, COMMON = 1 << 18, 8, 2e-7
#: Words near a candidate that speak for a credential, and against one.
CREDENTIAL = ("token", "secret", "passwd", "password", "pwd", "passphrase", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "private_key")
HARMLESS = ("sha1", "sha256", "sha512", "md5", "checksum", "digest", "commit", "integrity", "uuid", "revision", "etag", "example", "placeholder", "version", "hash")
_MARKS = r"+/=_.!@$%^&*#~?-"
_VALUE = rf"[^\s\"'`,;<>(){{}}\[\]]{{{ASSIGNED},}}"
#: Patterns whose group is the candidate: what is assigned, what follows a credential word, a password in a URL, a run, a mixed run.
_ASSIGNMENT = re.compile(rf"(?:[=:](?!//)|=>)[ \t]{{0,4}}[\"'`]?({_VALUE})")
_NAMED = re.compile(rf"(?i:{'|'.join(CREDENTIAL)})[\"']?[ \t]+(?:is[ \t]+)?[\"'`]?({_VALUE})")
_IN_URL = re.compile(r"://[^\s/:@]{1,200}:([^\s/@]{1,200})@")
_RUN = re.compile(rf"([A-Za-z0-9+/=_-]{{{LEAST},}})", re.ASCII)
_MIXED = re.compile(rf"(?<![A-Za-z0-9{_MARKS}])((?=[A-Za-z{_MARKS}]*+[0-9])(?=[0-9{_MARKS}]*+[A-Za-z])[A-Za-z0-9{_MARKS}]{{{MIXED},}})")
_TOKEN = re.compile(rf"\S{{{MIXED},}}")


def spans(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the candidates of a text, in order and apart from each other."""
    named, runs = [_ASSIGNMENT.finditer(text)], [_RUN.finditer(text)]
    in_url = [_IN_URL.finditer(text)] if "://" in text else []
    low = text.lower()
    if any(c in low for c in CREDENTIAL):
        named.append(_NAMED.finditer(text))
    runs += [_MIXED.finditer(text, *t.span()) for t in _TOKEN.finditer(text) if not t[0].isalpha()]
    taken: list[tuple[int, int]] = []
    for patterns in (in_url, named, runs):
        found = set()
        for m in chain.from_iterable(patterns):
            a, b = m.span(1)
            while b > a and text[b - 1] in ".,;:!?":  # marks of the sentence
                b -= 1
            if b > a:
                found.add((a, b))
        # The longest of those that overlap; a password in a URL before anything else, a named one before any run.
        for a, b in sorted(found, key=lambda s: (s[0] - s[1], s)):
            at = bisect(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
    return taken


FEATURES = (
    "length", "digits", "upper", "lower", "marks", "transitions", "entropy", "distinct", "hex", "vowels", "longest_run",
    "dictionary", "slashes", "lock_path", "test_path", "credential_before", "harmless_near", "assigned", "quoted", "sentence",
    "at_signs", "dots", "in_url",
)
TREES, DEPTH = 40, 8


def dictionary(docs: DataFrame) -> np.ndarray:
    """Which slots of four-letter runs are common, counted over all docs: a table from each task, summed in a tree."""
    part = TABLE // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(TABLE, np.int64)
        for b in batches:
            held, size = [], 0
            for t in chain(utf8(b.column(0)), [None]):
                if t is not None:
                    held.append(t)
                    size += len(t)
                if held and (t is None or size > 4_000_000):
                    total += np.bincount(_slots(b" ".join(held)), minlength=TABLE)
                    held, size = [], 0
        payload = [sparse(total[k * part : (k + 1) * part]) for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(np.full(PARTS, TaskContext.get().partitionId(), np.int32)), pa.array(payload, pa.binary())], names=["part", "task", "payload"])

    def add(t: pa.Table) -> pa.Table:
        sums = np.zeros(part, np.int64)
        for x in t.column("payload").to_pylist():
            at, n = dense(x)
            sums[at] += n
        return pa.table({"part": t.column("part")[:1], "payload": pa.array([sparse(sums)], pa.binary())})

    out = np.zeros(TABLE, np.int64)
    with Steps() as steps:
        parts = steps.stored(docs.select("text").mapInArrow(run, "part int, task int, payload binary"), "counts")
        for k, x in zip(*(c.to_pylist() for c in tree_sum(parts, add).toArrow().columns), strict=True):
            at, n = dense(x)
            out[k * part + at] = n
    return out > COMMON * max(1, out.sum())


def _slots(text: bytes) -> np.ndarray:
    """Slots of the runs of four ASCII letters of a text, lower-cased."""
    x = np.frombuffer(text.lower(), np.uint8).astype(np.uint32) - 97
    if len(x) < 4:
        return np.empty(0, np.int64)
    on = x < 26
    code = ((x[:-3] * 26 + x[1:-2]) * 26 + x[2:-1]) * 26 + x[3:]
    return (code[on[:-3] & on[1:-2] & on[2:-1] & on[3:]] % TABLE).astype(np.int64)


def features(text: str, start: int, end: int, path: str, common: np.ndarray) -> list[float]:
    """The features of the candidate text[start:end], in the order of FEATURES."""
    v, n = text[start:end], end - start
    before, after = text[max(0, start - 60) : start], text[end : end + 30]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in v]
    counts = np.unique(np.frombuffer(v.encode(), np.uint8), return_counts=True)[1] / n
    run = longest = 1
    for a, b in zip(v, v[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    slots, low, near = _slots(v.encode()), path.lower(), (before + " " + after).lower()
    tail = before.rstrip("\"' ")
    words = re.findall(r"[a-z_0-9]+", before.lower())[-3:]
    return [
        float(n),
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("l") / n,
        kinds.count("m") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(-(counts * np.log2(counts)).sum()),
        len(counts) / min(n, 64),
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v) is not None),
        sum(c in "aeiouAEIOU" for c in v) / n,
        longest / n,
        float(common[slots].sum()) / max(1, n - 3),
        v.count("/") / n,
        float(low.endswith((".lock", "-lock.json", ".sum", ".svg", ".min.js"))),
        float("test" in low or "example" in low or "fixture" in low),
        float(any(c in w for w in words for c in CREDENTIAL)),
        float(any(c in near for c in HARMLESS)),
        float(tail.endswith(("=", ":", ":=", "=>"))),
        float(before.endswith(("'", '"', "`")) and after.startswith(("'", '"', "`"))),
        float(before.endswith(" ") and after[:1] in (" ", ",", ".", "")),
        float(v.count("@")),
        v.count(".") / n,
        float(after.startswith("@") and "://" in before),
    ]


def candidates(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """docs (doc_id, text, path) -> doc_id, start, length, features of every candidate."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    fields = [docs.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType(), False))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, length, x = [], [], [], []
            for i, (t, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for at, end in spans(t or ""):
                    row.append(i)
                    start.append(at)
                    length.append(end - at)
                    x.append(features(t, at, end, p or "", shared.value))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=[f.name for f in fields]
            )

    return docs.select("doc_id", "text", "path").mapInArrow(run, T.StructType(fields))


def made_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, int, int, str, int]]:
    """n labelled findings (text, start, end, path, label) of common kinds, for where no reviewed ones are at hand."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    some = lambda chars, k: "".join(pick(chars) for _ in range(k))
    num = lambda a, b: int(rng.integers(a, b))
    hexes, low, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    b62 = low.upper() + low + digits
    syllables = ("the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ing", "ment", "tion", "lich", "keit", "aux", "elle", "mente", "cion", "ado", "que")
    word = lambda: "".join(pick(syllables) for _ in range(num(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    host = lambda: f"{word()}.{pick(('example.com', 'test.org', 'corp.net', 'mail.example.net'))}"
    short = lambda: pick((some(b62, num(8, 20)), some(b62 + "!@$%^&*#?", num(8, 20)), word().capitalize() + some(digits, num(2, 5)) + pick("!@#$%&*"), some(b62, 6) + pick(".!@$:") + some(b62, 6)))
    long_ = lambda k: pick((some(hexes, k), some(hexes.upper(), k), some(b62 + "+/", k), pick(("key-", "pk_", "xk-")) + some(b62, k)))
    digest = lambda: some(hexes, pick((32, 40, 64)))
    harmless = (
        lambda: ("", "".join(pick(syllables) for _ in range(12))),
        lambda: ("", "".join(pick(syllables) for _ in range(14)).upper()),
        lambda: ("", "/".join(word() + word() for _ in range(5)) + "/" + word()),
        lambda: (pick(("commit ", "sha256: ", "md5 = ", 'checksum="', "digest: ", "integrity sha256-", "revision ", "etag: ", "hash = ")), digest()),
        lambda: (pick(("", "token = ", 'password = "', "secret: ", "api_key=")), pick((num(20, 60) * "x", num(20, 40) * "0", "=" * 30, "-" * 30, "_" * 30, "EXAMPLE" * 4, "your_password_here", "changeme", "xxxxxxxx", "********", "${PASSWORD}", "os.environ", "None", "null", "true"))),
        lambda: ("", pick(("_", "-")).join(word() for _ in range(9)) + some(low, LEAST)),
        lambda: ("", f"{word()}.{num(0, 99)}@{pick(('mail', 'post', ''))}{num(0, 9)}.{host()}{pick(('', '', '###', '$$$', '%%%', '&&&', '***', '|||'))}"),
        lambda: (pick(("", "date: ", "at ")), f"{num(1990, 2030)}-{num(10, 13)}-{num(10, 29)}T{num(10, 24)}:{num(10, 60)}:{num(10, 60)}Z"),
        lambda: (pick(("", "version = ", "v")), f"{num(0, 30)}.{num(0, 30)}.{num(0, 30)}-{pick(('rc', 'beta', 'build'))}{num(1, 99)}"),
        lambda: (pick(("https:", "see: ", "")), f"//{host()}/{word()}/{num(1, 9999)}.html?page={num(1, 99)}"),
        lambda: (f"{word()}: ", f"{word()}{word()}"),
        lambda: (f"{word()} = ", str(num(1000, 10**9))),
        lambda: (pick(("the token ", "a secret ", "password ", "auth ", "bearer ")), word() + word()),
        lambda: ("", some(digits, num(6, 14)) + pick(("$$$", "%%%", "###", "&&&")) + word()),
        lambda: ("", word() + pick(("%%%", "&&&", "$$$", "***")) + word() + some(digits, 3)),
        lambda: ("", f"{word()}{num(1, 99)}_{word()}_{num(1, 99)}"),
    )
    out = []
    while len(out) < n:
        path = pick(("", "", "src/app.py", "config/settings.yml", "README.md", "notes.txt"))
        if rng.random() < 0.5:
            name = pick(CREDENTIAL)
            name = name.upper() if rng.random() < 0.3 else name
            head = prose(num(0, 8)) + " " + pick((f'{name} = "', f"{name}='", f"{name}: ", f"{name}=", f'"{name}": "', f'{name} := "', f"{name} is ", f"my {name} "))
            tail, value, label = ('"' if head.endswith('"') else "'" if head.endswith("'") else "") + " " + prose(3), short() if rng.random() < 0.5 else long_(num(LEAST, 65)), 1
            if rng.random() < 0.1:
                head, value, tail = f"{prose(2)} {pick(('https', 'postgres', 'ftp'))}://{word()}:", some(b62 + "!$%", num(6, 16)), f"@{host()}/{word()}"
        else:
            (before, value), label = pick(harmless)(), 0
            head, tail = prose(5) + " " + before, ('"' if before.endswith('"') else "") + pick((" ", ", ", ". ")) + prose(3)
            path = pick((path, path, "yarn.lock", "package-lock.json", "tests/test_app.py", "go.sum"))
        text = head + value + tail
        at = [s for s in spans(text) if s[0] < len(head) + len(value) and s[1] > len(head)]
        if at:
            out.append((text, *max(at, key=lambda s: s[1] - s[0]), path, label))
    return out


def train(spark: SparkSession, findings: Sequence[tuple[str, int, int, str, int]], common: np.ndarray):
    """A forest from labelled findings; what it is fitted on is the list that the caller holds."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = [(features(t, a, b, p, common), float(label)) for t, a, b, p, label in findings]
    # One partition: the trees' samples of rows depend on how these are dealt out.
    df = spark.createDataFrame(rows, "features array<double>, label double").coalesce(1).select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="sqrt").fit(df)


def scan(docs: DataFrame, findings: Sequence[tuple[str, int, int, str, int]], threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text and, if there is one, path) -> doc_id, start, length, score, is_secret of every candidate."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    path = F.col("path").cast("string") if "path" in docs.columns else F.lit("")
    common = dictionary(docs)
    found = candidates(docs.select("doc_id", "text", path.alias("path")), common)
    labels = {f[4] for f in findings}
    if labels != {0, 1}:
        score = F.lit(float(max(labels, default=0)))
    else:
        model = train(docs.sparkSession, findings, common)
        found = model.transform(found.withColumn("features", array_to_vector("features")))
        score = vector_to_array("probability")[1]
    return found.select("doc_id", "start", "length", score.alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"), made_findings())


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES: dict[str, str] = {}
