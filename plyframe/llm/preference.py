"""Preference formatting of paired conversations.  DataFrame functions only.

For every pair of a chosen and a rejected conversation the longest common prefix of turns (same role and text, turn by
turn) is rendered once as the prompt; the turns after it are the two completions.  `chosen_mask` and `rejected_mask` list
the spans of characters of a completion that are trained on: what the trained roles say, with the closing marker.

Turns are ordered by turn number, then role and text; the turn numbers themselves are not compared.

Defined cases: a null text or role is rendered as empty; rows that repeat a turn wholly are one turn; rows without
conv_id or turn take no part; a pair of which a side has no turns has an empty completion there; equal conversations have
two empty completions; other columns are ignored.  One output row holds the text of one pair, so the rows of a pair meet
in one task: that is the size of its result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(CLOSE))


def mask(turns: Column, trained: Sequence[str]) -> Column:
    """array<struct<begin: int, end: int>> of the trained characters of the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin: int, end: int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = acc["at"] + F.lit(len(OPEN) + len(AFTER_ROLE)) + F.length(turn["role"])
        end = head + F.length(turn["text"]) + F.lit(len(CLOSE))
        own = F.array(F.struct(head.cast("int").alias("begin"), end.cast("int").alias("end")))
        spans = F.when(turn["role"].isin(*trained), F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct(end.cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(
    turns: DataFrame, pairs: DataFrame, trained: Sequence[str] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(pair_id, n_prompt, prompt, chosen, rejected, chosen_mask, rejected_mask) of `pairs` (pair_id, chosen_id, rejected_id).

    n_prompt counts the turns of the common prefix.  A conversation may stand in any number of pairs.
    """
    said = turns.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    sides = pairs.select(
        "pair_id", F.explode(F.array(F.struct(F.lit(True).alias("won"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(False).alias("won"), F.col("rejected_id").alias("conv_id")))).alias("s")
    ).select("pair_id", "s.won", "s.conv_id")
    joined = sides.join(said, "conv_id", "left")
    row = F.struct("turn", "role", "text")
    of = lambda won: F.array_sort(F.collect_set(F.when((F.col("won") == won) & F.col("turn").isNotNull(), row)))
    both = joined.groupBy("pair_id").agg(of(True).alias("c"), of(False).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    at = F.array_position(same, False)
    both = both.withColumn("n_prompt", F.when(at > 0, at - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prompt") + 1, F.greatest(F.size(c) - F.col("n_prompt"), F.lit(0)))
    text = lambda x: F.array_join(F.transform(x, render), "")
    return both.select(
        "pair_id", "n_prompt", text(F.slice("c", 1, F.col("n_prompt"))).alias("prompt"), text(rest("c")).alias("chosen"), text(rest("r")).alias("rejected"),
        mask(rest("c"), trained).alias("chosen_mask"), mask(rest("r"), trained).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Pairs of the conversations 2k (chosen) and 2k + 1 (rejected) for every k of which either exists."""
    pair = F.shiftright(F.col(conv_col).cast("long"), 1)
    return turns.where(F.col(conv_col).isNotNull()).select(pair.alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
