"""Multi-party dialogues from the perspective of each participant, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of a turn: who speaks, and the end. One without a role is a user without a name.
OWN, OTHER, CLOSE, STOP, NAMELESS = "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n", "<|user|>\n"


def escaped(text: Column) -> Column:
    """``text`` without anything that reads as a mark: a backslash goes into each ``<|`` and ``|>``."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def _head(role: Column) -> Column:
    return F.when(role.isNull(), F.lit(NAMELESS)).otherwise(F.concat(F.lit(OTHER), role, F.lit(CLOSE)))


def _segment(speaker: Column, role: Column, text: Column) -> Column:
    return F.concat(F.when(role.eqNullSafe(speaker), F.lit(OWN)).otherwise(_head(role)), text, F.lit(STOP))


def rotate(turns: DataFrame) -> DataFrame:
    """``(conv_id, speaker, n_turns, text, mask)``: each dialogue once for each of its participants.

    turns: conv_id, turn, role, text. In a participant's rendering its own turns are the assistant's
    and those of others are users' under their names; mask holds the (start, end) of its own texts,
    in characters from 0, the end exclusive. Turns go by number (null first), then role, then text, so repeated rows
    are repeated turns. Turns without a role are one more participant, without a name, and their speaker is null. A null text is
    empty; what reads as a mark in texts and names is escaped (see :func:`escaped`). Turns without a conv_id belong to no dialogue
    and are left out; other columns are not looked at. A row holds a whole dialogue, so the largest dialogue must fit a row. Offsets are
    running sums over the turns, once for all participants.
    """
    t = turns.where("conv_id is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), escaped(F.col("role").cast("string")).alias("role"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    named = F.length(_head(F.col("role")))
    # As if all turns were others' ...
    as_users = F.coalesce(F.sum(F.length("text") + len(STOP) + named).over(before), F.lit(0))
    # ... but those of the same role, which have the assistant's mark instead.
    own_before = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text")) - 1
    start = as_users + own_before * (F.lit(len(OWN)) - named) + len(OWN)
    placed = t.select("conv_id", F.row_number().over(order).alias("no"), "role", "text", start.alias("start"))
    whole = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("no", "role", "text", "start"))).alias("turns"), F.array_distinct(F.collect_list(F.struct("role"))).alias("speakers")
    )
    each = whole.select("conv_id", "turns", F.explode("speakers").alias("who")).select("conv_id", "turns", F.col("who.role").alias("speaker"))
    mask = F.transform(
        F.filter("turns", lambda x: x["role"].eqNullSafe(F.col("speaker"))),
        lambda x: F.struct(x["start"].cast("long").alias("start"), (x["start"] + F.length(x["text"])).cast("long").alias("end")),
    )
    text = F.array_join(F.transform("turns", lambda x: _segment(F.col("speaker"), x["role"], x["text"])), "")
    return each.select("conv_id", "speaker", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))
