"""Line dedup by site-relative frequency.

For each host, the number of its pages that contain a line is divided by the number of its pages;
lines above a ratio are boilerplate and are dropped. With ``copies=False`` pages of one host with equal
texts count as one page on both sides of the ratio, so that many copies of a page don't turn its
content into boilerplate; this suits input that still holds its copies.

Defined results: lines without a word are never dropped; a line counts once per page; a line at the
ratio stays; null text stays null and has no lines, but is a page; pages of any length are read whole;
null hosts form a host of their own; repeated rows are pages each (or equal pages); an empty table
gives no rows; ``n_lines`` and ``n_dropped`` of the input are replaced, and no other column clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import words as w
from .bounded import small_side

#: A line on more than this share of its host's pages, and on so many pages at least, is boilerplate.
MAX_RATIO = 0.08
MIN_PAGES = 4
#: Lists of boilerplate lines are broadcast up to so many hosts.
BROADCAST_HOSTS = 20_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_word(line: Column) -> Column:
    return line.rlike(w.WORD)


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """``host_key`` and ``drop``, the hashes of its boilerplate lines.

    A host has at most (lines of an average page / ``max_ratio``) such lines, so the list is short.
    """
    text = w.text_of(text_col)
    pages = docs.select(
        w.group_key(host_col).alias("host_key"),
        F.xxhash64(text).alias("page"),
        F.array_distinct(F.transform(F.filter(_lines(text), _has_word), lambda x: F.xxhash64(x))).alias("lines"),
    )
    if not copies:
        pages = pages.groupBy("host_key", "page").agg(F.first("lines").alias("lines"))
    pages = stored(pages.drop("page"))
    totals = pages.groupBy("host_key").agg(F.count(F.lit(1)).alias("pages"))
    counts = pages.select("host_key", F.explode("lines").alias("line")).groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") >= min_pages).join(totals, "host_key").filter(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return often.groupBy("host_key").agg(F.collect_list("line").alias("drop"))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """``docs`` with the shortened text, ``n_lines`` (lines with a word) and ``n_dropped``."""
    drop = small_side(boilerplate(docs, text_col, host_col, max_ratio, min_pages, copies), BROADCAST_HOSTS)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), w.group_key(host_col).alias("host_key"), F.col(text_col).alias("_text"))
    lines = _lines(w.text_of("_text"))
    gone = lambda x: _has_word(x) & F.array_contains("drop", F.xxhash64(x))
    marked = rows.join(drop, "host_key", "left").withColumn("n_lines", F.size(F.filter(lines, _has_word)).cast("long")).withColumn(
        "_kept", F.when(F.col("drop").isNotNull(), F.filter(lines, lambda x: ~gone(x)))
    )
    n_kept = F.size(F.filter("_kept", _has_word)).cast("long")
    marked = marked.withColumn("n_dropped", F.when(F.col("_kept").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - n_kept))
    text = F.when(F.col("n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col("_text"))
    kept = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return marked.select(*kept, "n_lines", "n_dropped")
