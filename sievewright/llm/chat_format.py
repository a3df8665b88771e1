"""Chat formatting: collapse logged snapshots of growing conversations, then render the ones that remain.

Chat logs often hold a conversation once for each turn it grew by. Rolling hashes over the turns name every prefix of every
conversation; one whose whole hash names a proper prefix of another is a snapshot of it, and an anti-join drops it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

#: A turn in the rendered text. Fixed values of the ChatML layout.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def _hash(seed: int) -> Column:
    """63 bits of a turn's place, role and text as a decimal, so that sums don't overflow; lengths tell null from empty."""
    parts = [F.lit(seed), F.col("k"), F.coalesce(F.length("role"), F.lit(-1)), "role", F.coalesce(F.length("text"), F.lit(-1)), "text"]
    return F.shiftrightunsigned(F.xxhash64(*parts), 1).cast("decimal(38,0)")


def with_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, role, text, n_turns, p1, p2) for each turn: its place from 1 by turn number (null first), then role and text, and
    the rolling hash of all turns up to it, two running sums of independent hashes. The last turn's names the conversation.

    A running window needs no more memory for a conversation of any length.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    placed = rows.withColumns({"k": F.row_number().over(order), "n_turns": F.count("*").over(conv)})
    upto = conv.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns({f"p{i}": F.sum(_hash(seed)).over(upto) for i, seed in ((1, 71), (2, 1009))}).drop("turn")


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations: (conv_id, turns, n_turns, n_snapshots).

    A conversation goes if its turns (roles and texts, in order) begin a longer one, or if it equals one of a smaller
    conv_id (null last). n_snapshots counts the equal conversations that a row stands for, itself included. Turns with a null
    conv_id are one conversation. Repeated turns are turns like others. An empty table gives an empty result.
    """
    rows = cut(with_prefixes(turns))
    whole = rows.where("k = n_turns").groupBy("p1", "p2").agg(F.min("conv_id").alias("_c"), F.count("*").alias("n_snapshots"))
    # However common a first turn is, its prefix is one row a task before the shuffle.
    begun = rows.where("k < n_turns").select("p1", "p2").distinct()
    chosen = cut(whole.join(begun, ["p1", "p2"], "left_anti").select("_c", "n_snapshots"))
    kept = rows.select("conv_id", "n_turns", F.struct("k", "role", "text").alias("t")).join(chosen, F.col("conv_id").eqNullSafe(F.col("_c")))
    return kept.groupBy("conv_id", "n_turns", "n_snapshots").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def render(convs: DataFrame) -> DataFrame:
    """convs with `rendered`: each turn as <|im_start|>role, a line feed, the text, <|im_end|> and a line feed; null as empty."""
    one = lambda t: F.concat(F.lit(TURN_START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(f"{TURN_END}\n"))
    return convs.withColumn("rendered", F.array_join(F.transform("turns", one), ""))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_snapshots, rendered) for each maximal conversation of turns (conv_id, turn, role, text)."""
    return render(collapse(turns)).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_snapshots", "rendered")
