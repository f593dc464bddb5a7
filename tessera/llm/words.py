"""Column expressions that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: Elements are summed in blocks of so many, which keeps the work per row near-linear.
BLOCK = 128


def text_of(col: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """All words of a non-null text, in order."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def group_key(col: str | Column) -> Column:
    """A non-null string that tells null from every value, so that plain equality joins keep null groups."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def over(*cols: str) -> WindowSpec:
    return Window.partitionBy(*cols)


def running(lens: Column) -> Column:
    """For each element of an integer array column, the sum up to and including it."""
    add = lambda a, x: a + x
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK))))
    heads = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
    return F.transform(
        lens,
        lambda _, i: F.get(heads, F.floor(i / BLOCK).cast("int")) + total(F.slice(lens, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)),
    )
