"""Mixing sources to target weights.

Every source gets a budget of words. Documents get hash-random keys, are cut into key ranges
within their source, distributed prefix sums of the word counts run over ranges and rows, and
each source is cut at its exact budget; a budget above the source's size repeats it in epochs.

Defined results: null text counts no words; a null source is a source of its own, ranked last;
a null id has the hash of the empty string; repeated rows count each; ties of the key are
broken by id and then size; texts of any length are counted whole; an empty table gives no rows; with
``keep`` the columns ``size``, ``source_size``, ``target``, ``epochs`` and ``taken`` of the input are
replaced, and no other column clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import along
from ..session import stored
from . import words as w

#: Rows that a key range holds on average; a range is sorted by one task.
ROWS_PER_RANGE = 1_000


def budgets(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """One row per source: ``source, source_size, n_docs, target``.

    ``sizes`` has ``source`` and ``size``. Sources by code point, null last, take ``weights`` in
    turn. Together they get ``share`` of all words in proportion to their weights, where no target
    is above ``max_epochs`` times its source; what is cut off goes to the others. The common level
    ``l`` of ``min(cap, l * weight)`` is the largest of the levels that come out when the k sources
    with the lowest ``cap / weight`` are held at their caps.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = along(per, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    per = along(per, [F.col("cap") / F.col("weight"), "rank"], {"caps": ("sum", "cap"), "weights": ("sum", "weight")}, number="place")
    per = stored(per)
    whole = per.agg((F.lit(float(share)) * F.sum("source_size")).alias("all_words"), F.sum("weight").alias("all_weights"))
    per = per.crossJoin(F.broadcast(whole))  # one row
    held, free = F.col("caps") - F.col("cap"), F.col("all_weights") - F.col("weights") + F.col("weight")
    level = per.agg(F.max((F.col("all_words") - held) / free).alias("level"))
    return per.crossJoin(F.broadcast(level)).select(
        "source", "source_size", "n_docs", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    keep: bool = False,
) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, epochs, taken``.

    ``taken`` is the number of words that the mix takes, repeats counted: ``epochs`` whole copies
    and, for documents before the cut, one more, which the cut may shorten. ``keep`` keeps all
    columns of the input beside the added ones.
    """
    row = F.struct(*docs.columns).alias("_row")
    sized = docs.select(row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), w.n_words(w.text_of(text_col)).alias("size"))
    narrow = stored(sized.drop("_row"))
    plan = stored(budgets(narrow, weights, share, max_epochs))
    largest = plan.agg(F.max("n_docs")).first()[0] or 0
    n_ranges = max(1, -(-largest // ROWS_PER_RANGE))

    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = (
        (sized if keep else narrow)
        .withColumn("key", key)
        .withColumn("source_key", w.group_key("source"))
        .withColumn("key_range", F.shiftright(spread * n_ranges, 32).cast("int"))
    )
    ranges = (
        narrow.withColumn("key", key)
        .groupBy(w.group_key("source").alias("source_key"), F.shiftright(spread * n_ranges, 32).cast("int").alias("key_range"))
        .agg(F.sum("size").alias("range_size"))
    )
    earlier = Window.partitionBy("source_key").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .join(plan.withColumn("source_key", w.group_key("source")).drop("source", "n_docs"), "source_key")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
        .drop("range_size")
    )
    within = Window.partitionBy("source_key", "key_range").orderBy("key", "doc_id", "size")
    before = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("before")))
    added = ["size", "source_size", "target", "epochs", "taken"]
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in added] if keep else ["doc_id", "source"]
    return (
        keyed.withColumn("before", before)
        .join(offsets, ["source_key", "key_range"])
        .withColumn("taken", (F.col("epochs") * F.col("size") + partial).cast("long"))
        .select(*kept, *added)
    )


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mixture itself: one row per document and epoch with the text that this epoch takes.

    Takes the result of ``mix(keep=True)``. A copy that the cut shortens keeps its first words.
    """
    out = (
        mixed.filter("taken > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("cast((taken - 1) div size as int)"))))
        .withColumn("copy_words", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    )
    # Words with the blanks before them, so that what is kept stays as it was.
    parts = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    cut = F.array_join(F.slice(parts, F.lit(1), F.col("copy_words").cast("int")), "")
    return out.withColumn(text_col, F.when(F.col("copy_words") < F.col("size"), cut).otherwise(F.col(text_col)))
