"""URL filters: host and path rules, and for the rest a ratio of two character language models.

A variable-order Markov model is counted over the URLs that the rules accept, another over those that they reject. Symbols are the
URL's characters (A-Z lower-cased), contexts are up to `order` symbols long, and a gram of more than two symbols counts from LEAST
occurrences on, so that contexts are as long as what has been seen allows: the models grow with the URLs. Each order is smoothed with
the next lower one by Witten and Bell's weights, down to a uniform distribution over the symbols seen and one unseen. A URL's score is the mean over its symbols of
the difference of the two log-probabilities, and the score at which accepted and rejected URLs are told apart best is read off a
histogram of URLs the models haven't seen.

The models are one table of grams. In the sum over a URL each gram that occurs in it counts by itself: with d (by how much the gram changes
the log-ratio of its own suffix, less what b says of its context) and, where a symbol follows, b (the log-ratio of the backing-off
weights of the gram as a context). A symbol's log-ratio by its longest known gram, with the backing off from all longer contexts, is the
sum of these over the grams that end with it. So URLs are scored by a join of their grams with the table and a partial sum.

All of it is DataFrame expressions. The table is broadcast up to BROADCAST_GRAMS rows (of a few dozen bytes); beyond, the most
frequent HOT grams are broadcast, and the others are joined by a shuffle. URLs are scored once for each distinct one.

Nulls and edges: a null URL, or one without "://", has an empty host and path, no rule, and is scored like any other text
(a null as an empty one); a URL without symbols scores 0; with no accepted or no rejected URLs to learn from every score is
0 and the verdict is allow; repeated rows are judged alike; columns of pages besides those asked for are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Steps, ascii_lower, join_unique, read, stored

#: (host, path, verdict); a rule fits its host and the hosts below it, where the path begins with the rule's.
RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Symbols of the longest context, and occurrences from which on a gram of more than two symbols is kept.
ORDER, LEAST = 5, 2
#: What stands before a URL's first symbol, as a context.
START = "\x01"
BROADCAST_GRAMS, HOT = 400_000, 5_000
#: Scores fall into so many bins over [-SPAN, SPAN] for calibration.
BINS, SPAN = 400, 4.0
#: Logarithms are summed in whole millionths, in any order alike.
UNIT = 1_000_000


def host(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null. rules: a literal list of the job's configuration."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        below = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits = F.when(below, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def symbols(url: Column) -> Column:
    """The URL as the models see it."""
    return ascii_lower(F.coalesce(url, F.lit("")))


def _grams(text: Column, order: int) -> Column:
    """array<struct<g, last, size>>: every run of up to order + 1 symbols, whether it ends the text, and the START alone; by where they end."""
    chars = F.split(F.concat(F.lit(START), text), "")
    gram = lambda c, i, n: F.struct(F.array_join(F.slice(c, i - n + 1, n), "").alias("g"), (i == F.size(c)).alias("last"), i.alias("at"))
    # Bound to a variable, for else the text would be split again at each place.
    bound = F.transform(F.array(chars), lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.transform(F.sequence(F.lit(1), F.least(i, F.lit(order + 1))), lambda n: gram(c, i, n)))))
    return F.when(F.length(text) > 0, F.get(bound, F.lit(0)))


def train(urls: DataFrame, order: int = ORDER) -> tuple[DataFrame, float]:
    """urls (url, accepted boolean) -> the table (g, d, b, n) in 1 / UNIT, and what each symbol adds in any case (the first backing off)."""
    found = urls.select("accepted", F.explode(_grams(symbols(F.col("url")), order)).alias("x")).where("x.at > 1").select("accepted", "x.g")
    counts = found.groupBy("g").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    with Steps() as steps:
        kept = steps.stored(counts.where((F.length("g") <= 2) | (F.col("a") + F.col("r") >= LEAST)), "grams")
        front = lambda g: F.substring(g, F.lit(1), F.length(g) - 1)
        contexts = kept.groupBy(front(F.col("g")).alias("c")).agg(F.sum("a").alias("na"), F.count_if(F.col("a") > 0).alias("ta"), F.sum("r").alias("nr"), F.count_if(F.col("r") > 0).alias("tr"))
        back = lambda n, t: F.when(F.col(n) > 0, F.ln(F.col(t) / (F.col(n) + F.col(t)))).otherwise(0.0)
        contexts = steps.stored(contexts.withColumn("back", back("na", "ta") - back("nr", "tr")), "contexts")
        held = kept.join(contexts, front(F.col("g")) == F.col("c")).drop("c")
        stats = steps.stored(held, "stats")
        # A gram's probabilities, from those of its suffixes, the shortest first.
        suffixes = F.transform(F.sequence(F.lit(1), F.length("g")), lambda n: F.substring(F.col("g"), F.length("g") - n + 1, n))
        chain = stats.select(F.col("g").alias("of"), F.explode(suffixes).alias("g")).join(stats, "g")
        steps_of = F.sort_array(F.collect_list(F.struct(F.length("g").alias("k"), "a", "r", "na", "ta", "nr", "tr", "back")))
        known = kept.where("length(g) = 1").count() + 1
        even = F.lit(1.0 / known)
        start = F.struct(even.alias("pa"), even.alias("pr"), even.alias("qa"), even.alias("qr"))
        smooth = lambda n, total, kinds, p: F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p)
        step = lambda s, x: F.struct(smooth(x["a"], x["na"], x["ta"], s["pa"]).alias("pa"), smooth(x["r"], x["nr"], x["tr"], s["pr"]).alias("pr"), s["pa"].alias("qa"), s["pr"].alias("qr"))
        folded = chain.groupBy("of").agg(steps_of.alias("s")).select("of", F.aggregate("s", start, step).alias("p"), F.element_at("s", -1).alias("own"))
        change = F.ln(F.col("p.pa")) - F.ln(F.col("p.pr")) - F.ln(F.col("p.qa")) + F.ln(F.col("p.qr")) - F.col("own.back")
        whole = lambda x: F.round(x * UNIT).cast("long")
        grams = folded.select(F.col("of").alias("g"), whole(change).alias("d"), (F.col("own.a") + F.col("own.r")).alias("n"))
        ends = contexts.select(F.col("c").alias("g"), whole(F.col("back")).alias("b"), (F.col("na") + F.col("nr")).alias("m"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        table = grams.join(ends.where("g != ''"), "g", "full").select("g", zero("d"), zero("b"), F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("n"))
        out = stored(table, "model")
        first = ends.where("g = ''").first()
    return out, (first["b"] / UNIT if first else 0.0)


def score(urls: DataFrame, model: tuple[DataFrame, float], order: int = ORDER) -> DataFrame:
    """urls (url, distinct and not null) -> url, score: the mean log-likelihood difference per symbol."""
    table, always = model
    seen = urls.select("url", F.explode(_grams(symbols(F.col("url")), order)).alias("x")).select("url", "x.g", "x.last")
    cells = table.select("g", "d", "b")
    if table.count() <= BROADCAST_GRAMS:
        met = seen.join(F.broadcast(cells), "g")
    else:
        hot = stored(table.orderBy(F.desc("n"), "g").limit(HOT).select("g", "d", "b"), "hot")
        rest = seen.join(F.broadcast(hot.select("g")), "g", "left_anti").join(cells, "g")
        met = seen.join(F.broadcast(hot), "g").unionByName(rest)
    sums = met.groupBy("url").agg(F.sum(F.col("d") + F.when(F.col("last"), 0).otherwise(F.col("b"))).alias("s"))
    n = F.length("url")
    return urls.join(sums, "url", "left").select("url", F.when(n > 0, F.coalesce("s", F.lit(0)) / n / UNIT + F.lit(always)).otherwise(F.lit(0.0)).alias("score"))


def calibrate(scored: DataFrame) -> DataFrame:
    """scored (accepted, score) -> one row (threshold): the score with the best balanced accuracy, the middle one of equals. Over BINS rows."""
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS))).cast("int")
    hist = scored.groupBy(place.alias("b")).agg(F.sum(F.col("accepted").cast("int")).alias("yes"), F.sum((~F.col("accepted")).cast("int")).alias("no"))
    bins = scored.sparkSession.range(BINS).select(F.col("id").cast("int").alias("b")).join(hist, "b", "left").fillna(0)
    below, everything = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    part = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0)) / F.greatest(F.sum(c).over(everything), F.lit(1))
    gains = bins.select("b", (part("no") - part("yes")).alias("gain"), F.sum("yes").over(everything).alias("y"), F.sum("no").over(everything).alias("n"))
    best = gains.withColumn("best", F.max("gain").over(everything)).where("gain = best").agg(F.avg("b").alias("b"), F.first("y").alias("y"), F.first("n").alias("n"))
    return best.select(F.when((F.col("y") > 0) & (F.col("n") > 0), F.col("b") / BINS * 2 * SPAN - SPAN).otherwise(F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, keep: Sequence[str] = ("page_id",), order: int = ORDER) -> DataFrame:
    """The columns in keep, host, path, rule, verdict and score of every row of pages."""
    own = [f"__k{i}" for i in range(len(keep))]
    rows = pages.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)), F.coalesce("url", F.lit("")).alias("url"))
    fits = lambda df: df.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("__fit", rule(F.col("host"), F.col("path"), rules))
    known = fits(rows.select("url")).where("__fit IS NOT NULL").select("url", (F.col("__fit.verdict") == "allow").alias("accepted"))
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    learned = known.where(fold != 0).agg(F.count_if("accepted") * F.count_if(~F.col("accepted"))).first()[0]
    urls = rows.select("url").distinct()
    scores = stored(score(urls, train(known.where(fold != 0), order), order) if learned else urls.withColumn("score", F.lit(0.0)), "scores")
    cut = calibrate(join_unique(known.where(fold == 0), scores, "url").select("accepted", "score")).scalar()
    out = fits(join_unique(rows, scores, "url"))
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), "host", "path", F.col("__fit.rule").alias("rule"), verdict.alias("verdict"), "score")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES = {"op8_url_filters": op8_url_filters}
ORACLES: dict[str, str] = {}
