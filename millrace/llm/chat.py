"""Event-sourced chat formatting, in DataFrame operations only.

A log has events of conversations: ``begin`` starts a message, ``delta`` adds text to it, ``edit``
replaces its text, and ``regenerate`` empties it and drops every message that was begun after it until
then. Folded in the order of their sequence numbers they give the final messages, which a template
renders into one text per conversation.

The template writes ``### Role: <turn>text</turn>`` on a line of its own. In roles and texts the
characters of its marks are escaped: a backslash as ``\\b``, ``<`` as ``\\l``, ``#`` as ``\\h``, ``:`` in roles
as ``\\c``. So no text can hold a mark, and reading reverses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = ": <turn>", "</turn>\n"
HEAD = "### "
EVENT = "conv_id long, seq long, message string, kind string, role string, text string"
#: Characters of the marks and what stands for them. The backslash comes first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
TRAINED = "assistant"


def escape(text: Column) -> Column:
    for plain, stands in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(stands))
    return text


def unescape(text: Column) -> Column:
    for plain, stands in reversed(ESCAPES):
        text = F.replace(text, F.lit(stands), F.lit(plain))
    return text


def turn_events(turns: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text): each row is a message of its own.

    NULL roles and texts count as empty. Rows of one turn number follow each other by role and text;
    equal rows are messages each for itself.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select(
        "conv_id", place.alias("seq"), place.cast("string").alias("message"), F.lit("begin").alias("kind"), "role", "text"
    )


def messages(events: DataFrame) -> DataFrame:
    """Fold a log into its final messages: ``conv_id``, ``position``, ``role``, ``text``.

    ``events`` has conv_id, seq, message, kind, role, text. Events of one sequence number apply in the
    order begin, regenerate, edit, delta, then by text. A message takes the first role that it is
    given. Unknown kinds and events without a message are passed over; NULL texts count as empty.
    """
    rank = F.array_position(F.array(*map(F.lit, ("begin", "regenerate", "edit", "delta"))), F.col("kind"))
    used = events.where(F.col("message").isNotNull()).withColumn("__rank", rank).where(F.col("__rank") > 0)
    order = F.struct("seq", F.col("__rank").alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    reset = F.col("kind").isin("edit", "regenerate")
    folded = used.groupBy("conv_id", "message").agg(
        F.min("seq").alias("position"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "__rank", "role"))).alias("first"),
        F.max(F.when(reset, F.struct("seq", F.col("__rank").alias("rank")))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.array_sort(F.collect_list(order)).alias("parts"),
    )
    # What an edit or a regeneration left behind does not count; an edit brings its own text.
    after = F.filter(
        "parts",
        lambda p: F.col("reset").isNull() | (F.struct(p["seq"], p["rank"]) >= F.struct("reset.seq", "reset.rank")),
    )
    # Of equal edits at one place the last by text stands.
    final = F.when(
        F.col("reset.rank") == 3,
        F.concat(
            F.element_at(F.filter(after, lambda p: p["rank"] == 3), -1)["text"],
            F.array_join(F.transform(F.filter(after, lambda p: p["rank"] == 4), lambda p: p["text"]), ""),
        ),
    ).otherwise(F.array_join(F.transform(F.filter(after, lambda p: p["rank"] != 2), lambda p: p["text"]), ""))
    before = Window.partitionBy("conv_id").orderBy("position", "message").rowsBetween(Window.unboundedPreceding, -1)
    dropped = F.coalesce(F.max("regenerated").over(before) > F.col("position"), F.lit(False))
    return (
        folded.select("conv_id", "position", "message", "regenerated", F.coalesce("first.role", F.lit("")).alias("role"), final.alias("text"))
        .withColumn("__dropped", dropped)
        .where(~F.col("__dropped"))
        .select("conv_id", "position", "role", "text")
    )


def render(final: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss``, the trained ranges of it.

    A range (begin, end) is in code points and covers the escaped text of one assistant message,
    without its marks. Empty texts have a range too, of no length.
    """
    turns = F.array_sort(F.collect_list(F.struct("position", "role", "text")))
    by_conv = final.groupBy("conv_id").agg(turns.alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(HEAD), escape(t["role"]), F.lit(OPEN)).alias("head"), escape(t["text"]).alias("body"),
            (t["role"] == TRAINED).alias("trained"),
        ),
    )
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("loss"))

    def step(done: Column, p: Column) -> Column:
        begin = done["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        one = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        loss = F.when(p["trained"], F.concat(done["loss"], one)).otherwise(done["loss"])
        return F.struct((end + len(CLOSE)).alias("at"), loss.alias("loss"))

    return by_conv.select("conv_id", parts.alias("parts")).select(
        "conv_id", whole.alias("formatted"), F.aggregate("parts", start, step, lambda done: done["loss"]).alias("loss")
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation, unescaped."""
    lines = F.split(formatted, CLOSE, -1)
    turns = F.filter(lines, lambda line: line != "")
    return F.transform(
        turns,
        lambda line: F.struct(
            unescape(F.substring_index(F.substr(line, F.lit(len(HEAD) + 1)), OPEN, 1)).alias("role"),
            unescape(F.substring_index(line, OPEN, -1)).alias("text"),
        ),
    )


def trained_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = F.transform(loss, lambda r: F.substr(formatted, r["begin"] + 1, r["end"] - r["begin"]))
    return F.array_join(F.transform(cut, unescape), "")
