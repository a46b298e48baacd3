"""Preference formatting of chat conversations, with DataFrame functions only.

Chosen and rejected conversations of a pair share a longest common prefix of turns. It is rendered
once as the prompt; the turns after it are rendered for either side as a completion with a mask:
assistant turns are to be learned, all others are not. A mask is the list of the turns' lengths in
code points, each with 1 (learn) or 0, so it covers its completion exactly.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null role or text renders
as an empty one and equals null only; repeated turns all stay; a pair that has one side only gets
an empty prompt and an empty completion for the other side; a pair whose sides are equal has
empty completions; ``usable`` says that the completions differ and both hold something to learn;
a turn with a null pair id belongs to no conversation and stands alone, as a pair that has one side and
one turn, so that however many there are they never meet in one row; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE, LEARN = "<|im_start|>", "\n", "<|im_end|>\n", "assistant"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(AFTER_ROLE), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def _mask(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(F.length(render(t)).cast("long").alias("length"), F.when(t["role"] == LEARN, 1).otherwise(0).alias("learn")))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Inputs hold (pair_id, turn, role, text). A row per pair: pair_id, prompt_turns, prompt,
    chosen, chosen_mask, rejected, rejected_mask, usable."""
    side = lambda df, k: df.select("pair_id", F.lit(k).alias("side"), "turn", "role", "text")
    both = side(chosen, 0).unionByName(side(rejected, 1))
    entry = F.struct("side", "turn", "role", "text")
    grouped = both.where("pair_id is not null").groupBy("pair_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    grouped = grouped.unionByName(both.where("pair_id is null").select("pair_id", F.array(entry).alias("all")))
    of = lambda k: F.transform(F.filter("all", lambda t: t["side"] == k), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    sides = grouped.select("pair_id", of(0).alias("c"), of(1).alias("r"))
    differs = F.array_position(F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y)), False)
    cut = sides.withColumn("n", F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.size(x))
    parts = cut.select("pair_id", F.col("n").cast("long").alias("prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    learns = lambda x: F.exists(x, lambda t: F.coalesce(t["role"] == LEARN, F.lit(False)))
    return parts.select(
        "pair_id",
        "prompt_turns",
        _joined(F.col("p")).alias("prompt"),
        _joined(F.col("c")).alias("chosen"),
        _mask(F.col("c")).alias("chosen_mask"),
        _joined(F.col("r")).alias("rejected"),
        _mask(F.col("r")).alias("rejected_mask"),
        (learns("c") & learns("r")).alias("usable"),
    )


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Rejected conversations: each conversation with the last assistant turn's text replaced by the
    last reply of the conversation whose id follows (dropped where there is none)."""
    own = turns.select("conv_id", "turn", "role", "text")
    last = own.where(F.col("role") == LEARN).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.struct(F.col("last.text").alias("text")).alias("other"))
    known = own.join(last.select("conv_id", F.col("last.turn").alias("at")), "conv_id", "left").join(other, "conv_id", "left")
    is_last = F.coalesce((F.col("role") == LEARN) & (F.col("turn") == F.col("at")), F.lit(False))
    return known.where(~is_last | F.col("other").isNotNull()).select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(is_last, F.col("other.text")).otherwise(F.col("text")).alias("text"))
