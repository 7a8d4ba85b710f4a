"""The ledger of scenes: who sees what, and when news reaches those who weren't there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Seats of a ledger at most, whose list is broadcast.
SEATS = 10_000


def visible(entries: DataFrame, viewer: str) -> DataFrame:
    """entries (seat, layer, ...) without the inner life of others."""
    return entries.where((F.col("layer") != "inner") | (F.col("seat") == viewer))


def offstage(events: DataFrame, cast: DataFrame, seats: DataFrame) -> DataFrame:
    """events (event, scene, day, place), cast (scene, seat), seats (seat, seat_place) -> event, seat, ... for each seat with a place that
    wasn't in the scene: the fan-out of public events. seats is the list of players, a bounded one."""
    players = seats.where("seat_place IS NOT NULL")
    if players.limit(SEATS + 1).count() > SEATS:
        raise ValueError(f"more than {SEATS} seats")
    all_ = events.crossJoin(F.broadcast(players))
    return all_.join(cast, ["scene", "seat"], "left_anti")


def due(pending: DataFrame, clock: DataFrame) -> DataFrame:
    """pending (seat, arrives_day, ...), clock (seat, now) -> the rows that have arrived."""
    return pending.join(clock, "seat").where("arrives_day <= now")


def news_scene(news: DataFrame, scenes: DataFrame) -> DataFrame:
    """news (item, seat, arrives_day), scenes (scene, seat, ord, day) -> item, seat, scene: the first scene of the seat (by ord) not before the news.

    A scene matters to some news only if all earlier ones were on earlier days, so scenes are first reduced to those that set a new latest day;
    then each piece of news takes the next of them in one sort by day, from the last day on: a running frame, no pairs."""
    w = Window.partitionBy("seat").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    first = scenes.withColumn("__top", F.max("day").over(w)).where("__top IS NULL OR day > __top").select("seat", F.col("day").alias("__day"), F.struct("ord", "scene").alias("__s"))
    u = news.select("item", "seat", F.col("arrives_day").alias("__day"), F.lit(0).alias("__late"), F.lit(None).cast(first.schema["__s"].dataType).alias("__s"))
    u = u.unionByName(first.select(F.lit(None).cast(news.schema["item"].dataType).alias("item"), "seat", F.col("__day").cast(news.schema["arrives_day"].dataType).alias("__day"), F.lit(1).alias("__late"), "__s"))
    ahead = Window.partitionBy("seat").orderBy(F.desc("__day"), F.desc("__late")).rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("__n", F.last("__s", ignorenulls=True).over(ahead)).where("__late = 0 AND __n IS NOT NULL").select("item", "seat", F.col("__n.scene").alias("scene"))


def chapters(entries: DataFrame, cast: DataFrame, viewer: str) -> DataFrame:
    """scene, n, words, lines: what the viewer perceived in each scene attended, in order."""
    mine = entries.join(cast.where(F.col("seat") == viewer).select("scene"), "scene", "left_semi")
    seen = visible(mine, viewer)
    return seen.groupBy("scene").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))


def usage(calls: DataFrame) -> DataFrame:
    """calls (seat, prompt_tokens, completion_tokens) -> totals per seat."""
    return calls.groupBy("seat").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def too_fast(pairs: DataFrame, slack: float = 0.85) -> DataFrame:
    """pairs (prev_day, day, route_days, ...) -> hops that no route allows: there is none, or it takes longer even with slack."""
    return pairs.where(F.col("route_days").isNull() | (F.col("day") - F.col("prev_day") < slack * F.col("route_days")))


def knows_too_early(learns: DataFrame, events: DataFrame, days: DataFrame, slack: float = 0.8) -> DataFrame:
    """learns (seat, event, learn_day), events (event, day), days (event, seat, days; how long news travels to where the seat is then, no row or null if
    it can't) -> seat, event, event_day, learn_day, earliest_day of those who know before news can have come."""
    at = learns.join(events.select("event", F.col("day").alias("event_day")), "event").join(days, ["event", "seat"]).where("days IS NOT NULL")
    out = at.withColumn("earliest_day", F.col("event_day") + F.col("days") * slack)
    return out.where("learn_day < earliest_day").select("seat", "event", "event_day", "learn_day", "earliest_day")


def judged_moves(moves: DataFrame, slack: float = 0.85) -> DataFrame:
    """moves (move, claimed_days, route_days, ship_days) -> move, verdict, reason, needed_days: accepted if no faster than the way allows (by ship, where there is no other)."""
    need = F.coalesce("route_days", "ship_days")
    reason = F.when(need.isNull(), "unreachable").when(F.col("claimed_days") < need * slack, "too_fast")
    return moves.select("move", F.when(reason.isNull(), "ok").otherwise("reject").alias("verdict"), reason.alias("reason"), F.round(need, 1).alias("needed_days"))


def violations(hops: DataFrame, slack: float = 0.85) -> DataFrame:
    """hops (day, prev_day, route_days, ship_days, ...) with `type`: unreachable, or too_fast even with slack; the others are left out."""
    need = F.coalesce("route_days", "ship_days")
    kind = F.when(need.isNull(), "unreachable").when(F.col("day") - F.col("prev_day") < need * slack, "too_fast")
    return hops.withColumn("type", kind).where("type IS NOT NULL")


def roster(people: DataFrame, most: int = 80) -> DataFrame:
    """people (seat, name, text) -> seat, name, brief: the first of their text's characters."""
    return people.select("seat", "name", F.substring("text", 1, most).alias("brief"))


def tail(log: DataFrame, key: str, order: str, most: int = 24) -> DataFrame:
    """The last rows of each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return log.withColumn("__k", last).where(F.col("__k") <= most).drop("__k")


def chapter_problems(chapters: DataFrame, leaks: DataFrame, least: int) -> DataFrame:
    """chapters (chapter, text), leaks (chapter; with an inner line of someone else in it) -> chapter, problem: what is wrong with a chapter, a row each.

    Its length counts Chinese characters, of which 0.7 * least are asked for."""
    n = F.regexp_count("text", F.lit("[\u4e00-\u9fff]"))
    short = chapters.where(n < 0.7 * least).select("chapter", F.lit("too short").alias("problem"))
    return short.union(chapters.join(leaks.select("chapter").distinct(), "chapter", "left_semi").select("chapter", F.lit("inner life of another")))
