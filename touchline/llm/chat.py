"""Chat formatting for preference data: common prompt once, two masked completions.

DataFrame functions only.  Semantics for odd input: turns without a conversation
id belong to no conversation and are left out; a null text is empty and a null
role is ``user``; turns sort by number (null first), then role, then text, and
repeated rows are turns of their own; a conversation without a turn of the
trained role gives no pair; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def gather_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's ordered turns, structs of role and text."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        conversations.filter(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def reply_pairs(turns: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """(pair_id, chosen, rejected) from whole conversations.

    Chosen is a conversation up to its last reply.  Rejected is the same with
    that reply replaced by the reply before it (a repeated answer), or by an
    empty one where it is the first.
    """
    last = F.array_size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), role).cast("int") + 1
    replies = F.filter("turns", lambda t: t["role"] == role)
    before = F.when(F.array_size(replies) >= 2, F.element_at(replies, -2)["text"]).otherwise("")
    return (
        turns.filter(F.exists("turns", lambda t: t["role"] == role))
        .select("conv_id", F.slice("turns", 1, last).alias("chosen"), before.alias("other"))
        .select(
            F.col("conv_id").alias("pair_id"),
            "chosen",
            F.concat(
                F.slice("chosen", F.lit(1), F.array_size("chosen") - 1),
                F.array(F.struct(F.lit(role).alias("role"), F.col("other").alias("text"))),
            ).alias("rejected"),
        )
    )


def format_preferences(pairs: DataFrame, role: str = TRAINED_ROLE, keep_equal: bool = True) -> DataFrame:
    """Prompt and masked completions of (pair_id, chosen, rejected) turn lists.

    Pairs whose lists are equal prefer nothing; they stay unless ``keep_equal`` is off.

    The prompt is the longest common prefix of turns, rendered once.  It never
    takes all of both lists: where they are equal, the last turn stays in the
    completions.  A completion's mask lists the character spans
    ``start:end`` that are trained, counted from the completion's start: texts
    of the trained role with their end mark.
    """
    if not keep_equal:
        pairs = pairs.filter(~F.col("chosen").eqNullSafe(F.col("rejected")))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a.eqNullSafe(b), F.lit(False)))
    first_off = F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int") - 1
    prefix = F.least(first_off, F.greatest(F.array_size("chosen"), F.array_size("rejected")) - 1)
    out = pairs.withColumn("n_prefix", F.greatest(F.lit(0), prefix))
    tail = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.lit(0), F.array_size(c) - F.col("n_prefix")))
    out = out.select("pair_id", "n_prefix", F.slice("chosen", F.lit(1), F.col("n_prefix")).alias("shared"), tail("chosen").alias("chosen"), tail("rejected").alias("rejected"))
    return out.select(
        "pair_id",
        F.col("n_prefix").cast("long").alias("n_prefix"),
        _render("shared").alias("prompt"),
        _render("chosen").alias("chosen"),
        _mask("chosen", role).alias("chosen_mask"),
        _render("rejected").alias("rejected"),
        _mask("rejected", role).alias("rejected_mask"),
    )


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


_END = "<|end|>\n"


def _render(turns: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(_END))), "")


def _mask(turns: str, role: str) -> Column:
    """Spans as ``start:end`` joined by commas; a running length is carried along the turns."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(t["text"]) + len(_END)
        span = F.array(F.concat(start.cast("string"), F.lit(":"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")
