"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that participant as
the assistant and all others as named users; system turns stay system turns and are no
participants.  A rendered turn is

    <|role|> name: text<|end|>

with "name: " for users only, and turns are joined by a line break.  The loss mask covers the
assistant's texts and their end marks: spans of characters of the rendered text, and a string
of 0 and 1 for the turns.

A conversation may be of any length, so it is cut into parts of ``part_turns`` turn numbers
(and, where turn numbers repeat, of at most about twice ``part_rows`` rows, numbered by ``sub``);
a row of the result is a part as one participant sees it, and parts are numbered in order.
The rendered parts of a perspective, joined by line breaks, are its dialogue.  The rows of
one turn number, if over ``part_rows``, are dealt evenly to parts of their own by their place in
the input, so that neither long turns nor thousands of equal rows fill a part.

Defined cases: a null role is the participant "unknown", a null text is empty, a null turn
comes first, rows without a conversation id form one conversation; turns with equal numbers
come in the order of role and text (within a part, if over ``part_rows`` are equal), repeated rows are repeated turns; a conversation of system
turns only has no perspective; marks within a text are escaped by a backslash; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, staged


def perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: tuple[str, ...] = ("system",),
    part_turns: int = 256,
    part_rows: int = 1024,
) -> DataFrame:
    """(conversation, perspective, part, sub, n_turns, n_masked, rendered, mask, spans)."""
    text = F.replace(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("\\<|")), F.lit("|>"), F.lit("\\|>"))
    rows = turns.select(
        F.col(conv_col).alias("_conv"),
        F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("n")).alias("_key"),
        F.col(turn_col).alias("_turn"),
        F.floor(F.coalesce(F.col(turn_col), F.lit(-1)) / part_turns).cast("long").alias("part"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("_who"),
        text.alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = staged(rows, "chat-turns")
    total = rows.count()
    # Where turn numbers repeat beyond measure, a part's turns are dealt in order to subparts, and a turn too large for one gets its own.
    turn = F.coalesce(F.col("_turn").cast("long"), F.lit(-(1 << 63)))
    subs = F.ceil(F.col("n") / part_rows).cast("int")
    room = F.when(subs > 1, (subs + 1) * part_rows).otherwise(F.col("n"))
    in_part = Window.partitionBy("_key", "part")
    before = F.sum(room).over(in_part.orderBy("_at")) - room
    cut = (
        rows.groupBy("_key", "part", turn.alias("_at")).agg(F.count("*").alias("n"))
        .select("_key", "part", "_at", subs.alias("subs"), F.floor(before / part_rows).cast("int").alias("first"), F.sum("n").over(in_part).alias("n"))
        .where(F.col("n") > part_rows).groupBy("_key", "part")
        .agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_at", F.struct("first", "subs")))).alias("_cut"))
    )
    dealt = join_counted(rows, cut, ["_key", "part"], "n", total, "left")
    place = F.col("_cut")[turn]
    own = F.when(place["subs"] > 1, 1 + F.pmod(F.xxhash64("_row"), place["subs"])).otherwise(F.lit(0))
    dealt = dealt.withColumn("sub", F.coalesce(place["first"] + own, F.lit(0)).cast("int"))
    parts = dealt.groupBy("_key", "part", "sub").agg(
        F.first("_conv").alias("_conv"),
        F.sort_array(F.collect_list(F.struct("_turn", "_who", "_text"))).alias("_turns"),
    )
    parts = staged(parts, "chat-parts")
    people = rows.where(~F.col("_who").isin(*system)).select("_key", "_who").distinct()
    per_conv = parts.groupBy("_key").agg(F.count("*").alias("n"))
    # The few conversations of many parts are joined by broadcast, for one join key must not fill a task.
    who = people.join(per_conv, "_key")
    n_parts = parts.count()
    grouped = who.groupBy("_key").agg(F.sort_array(F.collect_list("_who")).alias("_people"), F.first("n").alias("n"))
    seen = join_counted(parts, grouped, ["_key"], "n", n_parts).withColumn("perspective", F.explode("_people"))
    me = F.col("perspective")

    def head(t):
        role = F.when(t["_who"].isin(*system), F.lit("system")).when(t["_who"] == me, F.lit("assistant")).otherwise(F.concat(F.lit("user|> "), t["_who"], F.lit(": ")))
        return F.concat(F.lit("<|"), role, F.when(t["_who"].isin(*system) | (t["_who"] == me), F.lit("|> ")).otherwise(F.lit("")))

    mine = lambda t: (t["_who"] == me) & ~t["_who"].isin(*system)
    made = F.transform("_turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["_text"], F.lit("<|end|>")).alias("body"), mine(t).alias("mine")))
    out = seen.withColumn("_made", made)
    # Character spans: one pass that carries the place reached.
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc, t):
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        return F.struct(
            (end + 1).cast("long").alias("at"),
            F.when(t["mine"], F.concat(acc["spans"], F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        )

    return out.select(
        F.col("_conv").alias(conv_col), "perspective", "part", "sub",
        F.size("_made").cast("long").alias("n_turns"),
        F.size(F.filter("_made", lambda t: t["mine"])).cast("long").alias("n_masked"),
        F.concat_ws("\n", F.transform("_made", lambda t: F.concat(t["head"], t["body"]))).alias("rendered"),
        F.concat_ws("", F.transform("_made", lambda t: F.when(t["mine"], F.lit("1")).otherwise(F.lit("0")))).alias("mask"),
        F.aggregate("_made", zero, step, lambda acc: acc["spans"]).alias("spans"),
    )
