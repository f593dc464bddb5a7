"""Chat formatting with a grammar round trip.

    conversation = turn* ;  turn = "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

A text is first rendered as it is. The rendered conversation is parsed by splitting at the turn
marks, unescaping, and compared with its source; turns that don't come back, and turns with a mark in
their text, which a model would take for the end of the turn, are escaped: every
``<``, n backslashes, ``|`` becomes ``<``, n + 1 backslashes, ``|``, so no turn mark is left, and
taking one backslash away restores the text. One such pass makes any conversation identical.

Defined results: null text and role are empty; a line break within a role is written as
``<|nl|>``, which cannot occur in an escaped role; a null conversation id is a conversation;
equal turns are ordered by role and text, repeated rows are turns each; texts of any length are kept
whole; an empty table gives no rows; only the four columns named are read, so no other one clashes. A conversation is one row, as its digest is over all of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import group_key, running

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def _role_back(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation: an array of structs of ``role`` and ``text``."""
    bodies = F.slice(F.split(rendered, r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split(rendered, r"<\|im_start\|>", -1)) - 1))
    body = lambda b: F.regexp_replace(b, r"<\|im_end\|>\n\z", "")
    cut = lambda b: F.instr(b, "\n")
    return F.transform(
        bodies,
        lambda b: F.struct(
            _role_back(F.substr(b, F.lit(1), cut(b) - 1)).alias("role"),
            unescape(F.substr(body(b), cut(b) + 1)).alias("text"),
        ),
    )


def _segment(turn: Column, text: Column) -> Column:
    return F.concat(F.lit(START), _role(turn["role"]), F.lit("\n"), text, F.lit(END + "\n"))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_mask`` and the turns of the source.

    ``loss_mask`` has the place (from 0, end exclusive, in code points) of each assistant text.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), group_key(conv_col).alias("conv_key"),
        F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("t"),
    )
    convs = rows.groupBy("conv_key").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("t")).alias("turns"))
    # A turn survives raw if, alone, it parses to itself: marks inside one turn cannot complete one of another.
    alone = lambda t: F.array(F.struct(t["role"], t["text"])) == parse(_segment(t, t["text"]))
    raw = lambda t: ~t["text"].contains(START) & ~t["text"].contains(END) & F.coalesce(alone(t), F.lit(False))
    convs = convs.withColumn("segments", F.transform("turns", lambda t: _segment(t, F.when(raw(t), t["text"]).otherwise(escape(t["text"])))))
    convs = convs.withColumn("formatted", F.array_join("segments", ""))
    convs = convs.withColumn("parsed", parse(F.col("formatted")))
    convs = convs.withColumn("identical", F.col("parsed") == F.transform("turns", lambda t: F.struct(t["role"], t["text"])))
    convs = convs.withColumn("_lens", F.transform("segments", lambda s: F.length(s)))
    convs = convs.withColumn("_ends", F.when(F.size("_lens") > 0, running(F.col("_lens"))).otherwise(F.col("_lens")))
    place = lambda t, i: F.struct(
        (F.get("_ends", i) - F.length(F.get("segments", i)) + F.length(F.concat(F.lit(START), _role(t["role"]), F.lit("\n")))).alias("start"),
        (F.get("_ends", i) - len(END) - 1).alias("end"),
        (t["role"] == "assistant").alias("loss"),
    )
    mask = F.filter(F.transform("turns", place), lambda p: p["loss"])
    return convs.withColumn("loss_mask", F.transform(mask, lambda p: F.struct(p["start"], p["end"]))).select(
        "conv_id", "formatted", "loss_mask", "identical", "turns"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text holds: turns and loss digests, from the text and mask alone."""
    read = formatted.withColumn("parsed", parse(F.col("formatted")))
    under = F.transform("loss_mask", lambda p: unescape(F.substr("formatted", p["start"] + 1, p["end"] - p["start"])))
    read = read.withColumn("_loss", F.array_join(under, ""))
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
