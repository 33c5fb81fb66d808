"""Preference formatting: chosen and rejected conversations share one prompt, their longest common prefix of turns.

The prompt is rendered once.  What follows it in either conversation is a completion, with the spans of characters that
the loss counts: the texts and end marks of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """[start, end) of each part of the rendered turns that the loss counts."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn))
        end = start + F.length(_body(turn))
        more = F.when(turn["role"] == role, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(none)
        return F.struct(end.alias("at"), F.concat(state["spans"], more).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda s: s["spans"])


def preferences(turns: DataFrame) -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, prompt, prompt_turns, {chosen,rejected}_completion, {chosen,rejected}_loss.

    ``turns``: pair_id, side (``chosen`` or ``rejected``), conv_id, turn, role, text.  Turns are ordered by turn, role and
    text, nulls first; a null role or text is empty; a turn that is repeated in all columns counts once.  Where one side
    is missing, the other is all completion and the missing one is null.  Rows without a pair_id are left out.  Long
    texts stay whole; extra columns are ignored; an empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("pair_id is not null").select("pair_id", "side", "conv_id", turn.alias("t"))
    def side(s: str) -> Column:
        """The sorted turns of a side; equal ones stand together, and one of each stays."""
        kept = lambda turns: F.filter(turns, lambda t, i: (i == 0) | ~t.eqNullSafe(F.get(turns, i - 1)))
        return F.get(F.transform(F.array(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("t"))))), kept), F.lit(0)).alias(s[0])

    name = lambda s: F.min(F.when(F.col("side") == s, F.col("conv_id"))).alias(f"{s}_id")
    pairs = rows.groupBy("pair_id").agg(side("chosen"), side("rejected"), name("chosen"), name("rejected"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    pairs = pairs.withColumn("prompt_turns", F.when(differs > 0, differs - 1).otherwise(shorter).cast("int"))
    rest = lambda a: F.slice(a, F.col("prompt_turns") + 1, F.size(a))
    there = lambda a, x: F.when(F.size(a) > 0, x)
    return pairs.select(
        "pair_id", "chosen_id", "rejected_id", render(F.slice("c", F.lit(1), F.col("prompt_turns"))).alias("prompt"), "prompt_turns",
        there("c", render(rest("c"))).alias("chosen_completion"), there("c", loss_spans(rest("c"))).alias("chosen_loss"),
        there("r", render(rest("r"))).alias("rejected_completion"), there("r", loss_spans(rest("r"))).alias("rejected_loss"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Turns for ``preferences`` from ``conversations(conv_id, turn, role, text)``: the conversations 2k and 2k + 1 are the
    chosen and the rejected one of pair k; rows without a conv_id belong to no pair."""
    return conversations.select(
        F.expr("floor(conv_id / 2)").cast("long").alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, F.lit("chosen")).otherwise(F.lit("rejected")).alias("side"), "conv_id", "turn", "role", "text",
    )
