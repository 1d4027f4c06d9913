"""Chat formatting with column expressions: turns to one string and a loss mask, and back."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values of the template: what opens and closes a message of each role.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
NEXT = "[NEXT]"
OTHER_CLOSE = " [/ROLE]"


def escape(text: Column) -> Column:
    """No control string can stand in the result: a bracket is always followed by a backslash."""
    return F.regexp_replace(text, r"([\\\[\]<])", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"([\\\[\]<])\\", r"\1", text)


def _open(role: Column) -> Column:
    named = F.concat(F.lit("[ROLE="), escape(role), F.lit("] "))
    for name, (mark, _) in MARKS.items():
        named = F.when(role == name, F.lit(mark)).otherwise(named)
    return named


def _close(role: Column) -> Column:
    mark = F.lit(OTHER_CLOSE)
    for name, (_, end) in MARKS.items():
        mark = F.when(role == name, F.lit(end)).otherwise(mark)
    return mark


def format_chats(turns: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted`` and ``mask``, the run lengths of text without and with loss.

    Turns are collected as structs and sorted by turn, then role and text. Adjacent turns of a role
    become one message, its parts divided by a mark. ``mask`` starts with a run without loss and
    alternates. Null text and a null role are empty, a null conv_id is one conversation, repeated
    rows are turns of their own, an empty table gives no rows, further columns are ignored. A
    conversation is one string by contract, so its turns meet in one row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))

    def piece(x: Column, i: Column) -> Column:
        t = F.col("t")
        first = (i == 0) | (F.get(t, i - 1)["role"] != x["role"])
        last = (i == F.size(t) - 1) | (F.get(t, i + 1)["role"] != x["role"])
        return F.struct(
            F.when(first, _open(x["role"])).otherwise(F.lit(NEXT)).alias("before"),
            escape(x["text"]).alias("body"),
            F.when(last, _close(x["role"])).otherwise(F.lit("")).alias("after"),
            x["role"].isin(*loss_roles).alias("loss"),
        )

    pieces = F.transform("t", piece)
    # Bound to a lambda so that the pieces are made once and read three times.
    made = F.transform(
        F.array(pieces),
        lambda p: F.struct(
            F.array_join(F.transform(p, lambda x: F.concat(x["before"], x["body"], x["after"])), "").alias("formatted"),
            F.flatten(
                F.transform(
                    p,
                    lambda x: F.array(
                        F.char_length(x["before"]) + F.when(x["loss"], 0).otherwise(F.char_length(x["body"])),
                        F.when(x["loss"], F.char_length(x["body"])).otherwise(0),
                        F.char_length(x["after"]),
                        F.lit(0),
                    ),
                )
            ).alias("mask"),
        ),
    )
    return chats.select("conv_id", F.get(made, F.lit(0)).alias("m")).select("conv_id", "m.formatted", "m.mask")


_TOKEN = re.compile(
    "|".join(f"(?P<{name}>{re.escape(mark)})" for name, (mark, _) in MARKS.items())
    + r"|\[ROLE=(?P<other>(?:[^\\\[\]<]|[\\\[\]<]\\)*)\] |(?P<next>\[NEXT\])"
)


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        opened = _TOKEN.match(formatted, at)
        if not opened or opened["next"]:
            raise ValueError(f"no message opens at {at}")
        role = unescape(opened["other"]) if opened["other"] is not None else opened.lastgroup
        close = MARKS[role][1] if role in MARKS else OTHER_CLOSE
        at, end = opened.end(), _closing(formatted, opened.end(), close)
        turns += [(role, unescape(part)) for part in formatted[at:end].split(NEXT)]
        at = end + len(close)
    return turns


def _closing(formatted: str, at: int, close: str) -> int:
    # A mark cannot stand inside an escaped text, so the first one found closes the message.
    end = formatted.find(close, at)
    if end < 0:
        raise ValueError(f"the message at {at} does not close")
    return end


def masked_texts(formatted: str, mask: Sequence[int]) -> list[str]:
    out, at = [], 0
    for i, n in enumerate(mask):
        if i % 2 and n:
            out.append(unescape(formatted[at : at + n]))
        at += n
    if at != len(formatted):
        raise ValueError("the mask does not cover the text")
    return out


def read_chats(formatted: DataFrame) -> DataFrame:
    """``turns`` and ``loss_text`` of formatted rows, from the string and its mask alone."""
    kind = T.StructType([
        T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("loss_text", T.StringType()),
    ])

    @F.pandas_udf(kind)
    def back(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        turns = [[{"role": r, "text": t} for r, t in parse_chat(s)] for s in texts]
        return pd.DataFrame({"turns": turns, "loss_text": ["".join(masked_texts(s, m)) for s, m in zip(texts, masks)]})

    return formatted.withColumn("_z_back", back("formatted", "mask")).select(
        *[c for c in formatted.columns if c not in ("turns", "loss_text")], "_z_back.turns", "_z_back.loss_text"
    )
