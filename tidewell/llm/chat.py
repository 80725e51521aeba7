"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The turns that both begin with, by role and text, are rendered once as the prompt; what
follows is rendered as a pair of completions, with the character ranges that a loss counts:
what the assistant says there, and the end mark after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.names import fresh

END = "<|end|>\n"
TURN = "struct<role:string,text:string>"


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_col, turns: one array of (role, text) per conversation, by turn, then role and text. Null roles and texts become empty; rows without a turn number come first."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.groupBy(F.col(conv_col).alias(conv_col)).agg(F.array_sort(F.collect_list(one)).alias("t")).select(conv_col, F.transform("t", lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _render(conversation: Column) -> Column:
    return F.array_join(F.transform(conversation, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def _spans(conversation: Column) -> Column:
    """[from, to) character ranges of the assistant's words and end marks in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.char_length(_header(t))
        end = begin + F.char_length(t["text"]) + len(END)
        own = F.array(F.struct(begin.alias("from"), end.alias("to")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(conversation, start, step, lambda acc: acc["spans"])


def preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected", prefix: str = "") -> DataFrame:
    """pairs with prompt_turns (int), prompt, chosen_text, rejected_text, chosen_spans and rejected_spans added.

    chosen_col and rejected_col are arrays of (role, text).  A null array has no turns; a
    null role or text counts as empty.  Equal conversations have all their turns in the
    prompt and empty completions; where one begins with all of the other, the other's
    completion is empty.  Every row stays, repeated ones too.  ``prefix`` goes before the
    new names; columns that have such a name all the same are replaced, all others are kept
    whatever their names.  A conversation is held whole in one row.
    """
    left, right, begin, after_left, after_right = fresh(pairs, "__chosen", "__rejected", "__n", "__chosen_rest", "__rejected_rest")
    a, b = (F.transform(F.coalesce(F.col(f"`{c}`"), F.array().cast(f"array<{TURN}>")), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))) for c in (chosen_col, rejected_col))
    rows = pairs.withColumn(left, a).withColumn(right, b)
    same = F.zip_with(left, right, lambda x, y: F.coalesce(x == y, F.lit(False)))  # the shorter one is padded with nulls
    parted = F.array_position(same, False).cast("int")
    rows = rows.withColumn(begin, F.when(parted > 0, parted - 1).otherwise(F.size(left)))

    def rest(c: str) -> Column:
        return F.slice(F.col(c), F.col(begin) + 1, F.greatest(F.size(c) - F.col(begin), F.lit(0)))

    rows = rows.withColumn(after_left, rest(left)).withColumn(after_right, rest(right))
    new = {"prompt_turns": F.col(begin), "prompt": _render(F.slice(left, F.lit(1), F.col(begin))), "chosen_text": _render(F.col(after_left)), "rejected_text": _render(F.col(after_right)), "chosen_spans": _spans(F.col(after_left)), "rejected_spans": _spans(F.col(after_right))}
    new = {prefix + k: v for k, v in new.items()}
    kept = [c for c in pairs.columns if c.lower() not in {k.lower() for k in new}]
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in new.items()])


def cut_answers(conversations: DataFrame, turns_col: str = "turns") -> DataFrame:
    """conversations with ``rejected`` added: the same turns, the assistant's last one cut to the first half of its characters. Without an assistant's turn, the same. Other columns are kept, but for one named rejected."""
    (last,) = fresh(conversations, "__at")
    at = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(turns_col), F.lit(1))), F.lit(0), lambda acc, i: F.when(F.try_element_at(F.col(turns_col), i)["role"] == "assistant", i).otherwise(acc))
    half = F.transform(turns_col, lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col(last), F.substring(t["text"], F.lit(1), F.floor(F.char_length(t["text"]) / 2).cast("int"))).otherwise(t["text"]).alias("text")))
    return conversations.withColumn(last, at).withColumn("rejected", half).drop(last)
