"""Preference pairs for training: one shared prompt and two masked completions.

A pair holds two conversations. Their longest common prefix of turns (same role and text) is rendered
once as the prompt; what remains of each is a completion, a list of segments of which only the
assistant's words and their end marks are trained on. Everything is built-in functions over arrays of turns, one
row per pair: one aggregation brings the turns together, nothing else is shuffled.

Defined results: null role or text is empty text, a null turn number comes first. Repeated rows of a
turn count once; different rows of one turn follow by role, then text. Rows without an id belong to
no conversation and take no part. A pair that lacks one side has no prompt and an empty completion
there; equal sides have a prompt only. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<turn:bigint,role:string,text:string>>"
END = "<|end|>\n"


def transcripts(turns: DataFrame, key: str, name: str = "turns") -> DataFrame:
    """One row per conversation: ``key`` and its turns in order, as an array."""
    turn = F.struct(
        F.coalesce(turns["turn"].cast("bigint"), F.lit(-1).cast("bigint")).alias("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"),
    )
    rows = turns.where(turns[key].isNotNull()).select(turns[key].alias("_key"), turn.alias("_turn"))
    return rows.groupBy("_key").agg(F.array_sort(F.array_distinct(F.collect_list("_turn"))).alias(name)).withColumnRenamed("_key", key)


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns that both share."""
    n = F.least(F.size(chosen), F.size(rejected))
    differs = F.zip_with(F.slice(chosen, 1, n), F.slice(rejected, 1, n), lambda a, b: (a["role"] != b["role"]) | (a["text"] != b["text"]))
    first = F.array_position(differs, True)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def segments(turns: Column) -> Column:
    """Text pieces in order with ``train``: whether the loss counts there."""
    piece = lambda text, train: F.struct(text.alias("text"), F.lit(train).alias("train"))
    reply = lambda t: F.array(piece(_head(t), False), piece(F.concat(t["text"], F.lit(END)), True))
    other = lambda t: F.array(piece(F.concat(_head(t), t["text"], F.lit(END)), False))
    return F.flatten(F.transform(turns, lambda t: F.when(t["role"] == "assistant", reply(t)).otherwise(other(t))))


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with its two arrays of turns replaced by n_prompt_turns, prompt, and the segments
    ``chosen_completion`` and ``rejected_completion``."""
    none = F.array().cast(TURNS)
    rest = [c for c in pairs.columns if c not in (chosen, rejected)]
    sides = pairs.select(*rest, F.coalesce(pairs[chosen], none).alias("_chosen"), F.coalesce(pairs[rejected], none).alias("_rejected"))
    counted = sides.withColumn("_same", common_turns(F.col("_chosen"), F.col("_rejected")))
    tail = lambda side: F.slice(side, F.col("_same") + 1, F.greatest(F.lit(0), F.size(side) - F.col("_same")))
    return counted.select(
        *rest, F.col("_same").cast("long").alias("n_prompt_turns"), rendered(F.slice("_chosen", 1, F.col("_same"))).alias("prompt"),
        segments(tail(F.col("_chosen"))).alias("chosen_completion"), segments(tail(F.col("_rejected"))).alias("rejected_completion"),
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pairs from two tables of turns (``key``, turn, role, text)."""
    return format_pairs(transcripts(chosen, key, "chosen").join(transcripts(rejected, key, "rejected"), key, "full_outer"))


def stale_reply(turns: Column) -> Column:
    """A rejected counterpart of a conversation: up to its last reply, with the reply before it in that
    place, or with no reply where there was none before. Without replies it is the conversation itself."""
    places = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    last = F.element_at(places, -1)
    stale = F.element_at(turns, F.element_at(places, -2) + 1)
    reply = F.struct(F.element_at(turns, last + 1)["turn"].alias("turn"), F.lit("assistant").alias("role"), stale["text"].alias("text"))
    before = F.slice(turns, 1, last)
    return F.when(F.size(places) == 0, turns).when(F.size(places) == 1, before).otherwise(F.concat(before, F.array(reply)))


def text_of(completion: Column) -> Column:
    return F.array_join(F.transform(completion, lambda s: s["text"]), "")


def mask_of(completion: Column) -> Column:
    """``length:train`` of each segment, in code points."""
    return F.array_join(F.transform(completion, lambda s: F.concat_ws(":", F.length(s["text"]), s["train"].cast("int"))), ",")
