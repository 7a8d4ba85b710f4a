"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: a message is opened, streamed deltas append to it, an edit replaces its text, and a
regeneration empties it to be streamed anew and drops what had come after it. Events are folded into final messages in
two steps: first each message by itself (so that a long conversation is spread by its messages), then each conversation by
its messages, which are then rendered. Only DataFrame expressions are used.

The rendering of a message is <turn>role, a line feed, the text and </turn>. Inside roles and texts a backslash becomes
\\b and a "<" becomes \\l, so that no text can open or close a turn, and in roles a line feed becomes \\n, so that the first one ends
the role; unescape() gives back any text or role exactly. A conversation's output is its list of rendered turns, each with the
place of the text that bears loss (assistants' texts); its string is their concatenation.

Nulls and edges: a null text or delta is empty, a null role an empty role; conv_id may be null (one conversation of that
id); rows of equal turn are turns of their own, ordered by role and text, null first, and repeated rows are repeated turns;
an edit or delta of a message that was never opened opens it as an assistant's; an empty log gives no conversations;
further columns are not read. A conversation is one row of output, so its text must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

OPEN, CLOSE = "<turn>", "</turn>"
#: Event types: message opens (text optional), delta appends, edit replaces, regenerate empties and drops later messages.
TYPES = ("message", "delta", "edit", "regenerate")
#: Code points of a streamed delta.
CHUNK = 1000


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Of texts and roles; no escaped text holds \\n, as its backslashes are followed by b or l."""
    return F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def as_events(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Finished turns as a log: each row opens a message of its own at its turn; an assistant's is opened empty and its text streamed in
    deltas of `chunk` code points. Rows of equal turn are numbered, so that each delta finds its message."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(same).alias("n"))
    whole = F.struct(F.lit(0).alias("part"), F.lit("message").alias("type"), F.col("text").alias("text"))
    opened = F.array(F.struct(F.lit(0).alias("part"), F.lit("message").alias("type"), F.lit("").alias("text")))
    parts = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    deltas = F.transform(parts, lambda x, i: F.struct((i + 1).alias("part"), F.lit("delta").alias("type"), x.alias("text")))
    events = F.when((F.col("role") == "assistant") & (F.length("text") > 0), F.concat(opened, deltas)).otherwise(F.array(whole))
    e = rows.select("conv_id", "turn", "n", "role", F.inline(events))
    message = F.struct("turn", "n")
    return e.select("conv_id", F.struct("turn", "n", "part").alias("seq"), "type", message.alias("message"), F.when(F.col("type") == "message", F.col("role")).alias("role"), "text")


def fold(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, type, message, role, text) -> final messages (conv_id, message, role, text).

    message names the message that an event is about and orders the messages of a conversation."""
    e = events.select("conv_id", "seq", "type", "message", "role", F.coalesce("text", F.lit("")).alias("text"))
    opens = F.col("type") == "message"
    # Two rows that open the same message are two messages: each gets a number, to which the message's other events before the next one belong.
    of_message = Window.partitionBy("conv_id", "message").orderBy(F.col("seq"), F.when(opens, 0).otherwise(1), F.col("role"), F.col("text"))
    e = e.withColumn("copy", F.greatest(F.lit(1), F.sum(opens.cast("int")).over(of_message.rowsBetween(Window.unboundedPreceding, 0))))
    ordered = F.sort_array(F.collect_list(F.struct("seq", F.when(opens, 0).otherwise(1).alias("late"), "type", "role", "text")))
    m = e.groupBy("conv_id", "message", "copy").agg(ordered.alias("log"))
    # What stands since the last event that isn't a delta; joined once, so that long texts aren't copied again for each delta.
    since = F.greatest(F.lit(1), F.array_max(F.transform("log", lambda x, i: F.when(x["type"] != "delta", i + 1))))
    text = F.array_join(F.transform(F.slice("log", since, F.size("log")), lambda x: F.when(x["type"] == "regenerate", "").otherwise(x["text"])), "")
    opened = F.filter("log", lambda x: x["type"] == "message")
    return m.select(
        "conv_id",
        "message",
        "copy",
        F.when(F.size(opened) > 0, F.coalesce(F.get(opened, F.lit(0))["role"], F.lit(""))).otherwise("assistant").alias("role"),
        text.alias("text"),
        F.get(F.col("log"), F.lit(0))["seq"].alias("first"),
        F.array_max(F.transform(F.filter("log", lambda x: x["type"] == "regenerate"), lambda x: x["seq"])).alias("again"),
    )


def messages(events: DataFrame) -> DataFrame:
    """fold() without the messages that a regeneration of an earlier one has dropped."""
    before = Window.partitionBy("conv_id").orderBy("message", "copy").rowsBetween(Window.unboundedPreceding, -1)
    m = fold(events).withColumn("cut", F.max("again").over(before))
    return m.where("cut IS NULL OR first >= cut").drop("again", "first", "cut")


def render(messages: DataFrame) -> DataFrame:
    """messages (conv_id, message, copy, role, text) -> conv_id, turns array<struct<rendered, loss_start, loss_chars>>.

    loss_start counts code points of `rendered` from 0; a turn without loss has loss_chars null."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct(
        "message",
        "copy",
        F.concat(head, body, F.lit(CLOSE)).alias("rendered"),
        F.when(F.col("role") == "assistant", F.length(head)).alias("loss_start"),
        F.when(F.col("role") == "assistant", F.length(body)).alias("loss_chars"),
    )
    turns = F.sort_array(F.collect_list(turn))
    return messages.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["rendered"].alias("rendered"), t["loss_start"].alias("loss_start"), t["loss_chars"].alias("loss_chars"))).alias("turns"))


def formatted(turns: Column) -> Column:
    """A conversation's string."""
    return F.array_join(F.transform(turns, lambda t: t["rendered"]), "")


def parse(text: Column) -> Column:
    """Back from a conversation's string: array<struct<role, text>>."""
    parts = F.filter(F.split(text, OPEN), lambda p: p != "")
    plain = lambda p: F.substring(p, F.lit(1), F.length(p) - len(CLOSE))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(plain(p), F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["loss_chars"].isNotNull()), lambda t: unescape(F.substring(t["rendered"], t["loss_start"] + 1, t["loss_chars"]))), "")


def format_log(events: DataFrame) -> DataFrame:
    """The whole way: events -> conv_id, turns."""
    return render(messages(events))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    own = own.select("conv_id", "t.turn", "t.role", F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_log(as_events(rows)).withColumn("formatted", formatted(F.col("turns"))).withColumn("back", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("turns")))
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"replace(replace({0}, '\', '\b'), '<', '\l')"
_ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('<turn></turn>') + 1 + length(replace({_ESC.format("role")}, chr(10), '\n')) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

QUERIES = {"op9_chat_formatting": op9_chat_formatting}
ORACLES = {"op9_chat_formatting": _ORACLE}
