"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and names within sentences (of any number of words) become typed
placeholders, so that a question with other values has the same template. Windows of template words
of the documents are hash-joined with those of the benchmark. Matches are grouped by alignment
(document, item, distance of their positions), and in each alignment every value of the item must
always stand for the same value of the document; alignments that fail are coincidences of templates.

Windows of an item's own words, without regard to case and with values as they are, go through the same
join. Copies are found by these whatever their case, and however many of their words are values.
Template windows of which less than ``MIN_FIXED`` are fixed words are not compared: they would
match any list of numbers or names.

The first word of an item becomes a name by what stands before it in the document, so its template
window is also looked for with a name there, which must be that word.

Defined results: null text has no words; items of fewer than ``MIN_ITEM_WORDS`` words match nothing;
items shorter than a window are one window of their own length; equal items match each; rows of one
id and text are one document, unlike texts of one id (or of none) are documents each; empty tables
give no rows; texts are read whole; only id and text are read, so no other column clashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import words as w
from .bounded import small_side

WINDOW = 8
MIN_ITEM_WORDS = 4
#: Words of a template window that are not placeholders, at least, as a share.
MIN_FIXED = 0.5
#: Windows of one alignment that make a leak; fewer suffice if the item has no more.
MIN_WINDOWS = 4
#: Benchmark windows are broadcast up to this many rows.
BROADCAST_WINDOWS = 1_000_000
#: Documents with matching templates, and leaking ones, are broadcast up to so many.
BROADCAST_IDS = 500_000

# Units that count as such after a number.
UNITS = "km|m|cm|mm|miles?|feet|ft|inch(?:es)?|kg|g|mg|pounds?|lbs?|tons?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|liters?|litres?|ml|mph|kmh|degrees?"
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
_SPLIT = r"[^\p{L}\p{N}_<>]+"
_CAPITAL = r"\p{Lu}\p{Ll}++"
_END = r"(?![\p{L}\p{N}_])"
# Patterns begin with the rare letter and look behind it afterwards, which is faster than at every place.
_JOIN = rf"(\p{{Lu}}(?<![\p{{L}}\p{{N}}_]\p{{Lu}})\p{{Ll}}++) (?={_CAPITAL}{_END})"
_NAMES = rf"\p{{Lu}}(?:(?<=[\p{{L}},;] \p{{Lu}})\p{{Ll}}++(?:_{_CAPITAL})*+|(?<![\p{{L}}\p{{N}}_]\p{{Lu}})\p{{Ll}}++(?:_{_CAPITAL})++){_END}"


def _raw(text: Column) -> Column:
    """The text with every value as one word: blanks within names and separators within numbers become underscores."""
    numbers = F.regexp_replace(F.regexp_replace(text, r"[.,](?<=\p{N}[.,])(?=\p{N})", "_"), r"(\p{N})(?=\p{L})", "$1 ")
    clean = F.when(text.rlike("[<>]"), F.translate(text, "<>", "  ")).otherwise(text)
    return F.regexp_replace(F.when(text.rlike(r"\p{N}"), F.translate(numbers, "<>", "  ")).otherwise(clean), _JOIN, "$1_")


def _template(raw: Column) -> Column:
    numbers = F.regexp_replace(F.regexp_replace(raw, r"\p{N}(?<![\p{L}\p{N}_]\p{N})[\p{N}_]*+", NUMBER), rf"(?<={NUMBER} )(?i:{UNITS}){_END}", UNIT)
    with_numbers = F.when(raw.rlike(r"\p{N}"), numbers).otherwise(raw)
    return F.lower(F.regexp_replace(with_numbers, _NAMES, NAME))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, _SPLIT), lambda x: x != "")


def _own(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` with hashes of 1, 2, 4 and 8 words in a row of both kinds, each made of two of the ones before."""
    df = df.withColumns({f"_{c}1": F.transform(c, lambda x: F.xxhash64(x)) for c in ("own", "tokens")})
    for n in (1, 2, 4):
        df = df.withColumns({f"_{c}{2 * n}": F.transform(f"_{c}{n}", _with_next(f"_{c}{n}", n)) for c in ("own", "tokens")})
    return df


def _with_next(hashes: str, at: int) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.xxhash64(x, F.get(hashes, i + at))


def _hashes(kind: str, n: int) -> Column:
    """The hash of each window of ``n`` words, up to 15; those of templates are told from own words by their bits."""
    c = "own" if kind == "own" else "tokens"
    at = 1 << (n.bit_length() - 1)
    out = F.col(f"_{c}{at}")
    while at < n:
        more = 1 << ((n - at).bit_length() - 1)
        out, at = F.transform(out, _with_next(f"_{c}{more}", at)), at + more
    out = F.slice(out, F.lit(1), F.greatest(F.lit(0), F.size(c) - n + 1))
    return out if kind == "own" else F.transform(out, lambda h: F.bitwise_not(h))


def _is_slot(t: Column) -> Column:
    return t.isin(NUMBER, UNIT, NAME)


def _slots(at: Column, n: Column) -> Column:
    """Place, type and value of the placeholders of the window at a position of ``tokens`` and ``values``."""
    both = F.zip_with(F.slice("tokens", at + 1, n), F.slice("values", at + 1, n), lambda t, v: F.struct(t.alias("type"), F.lower(v).alias("value")))
    placed = F.transform(both, lambda s, k: F.struct(k.alias("k"), s["type"].alias("type"), s["value"].alias("value")))
    return F.filter(placed, lambda s: _is_slot(s["type"]))


def _read(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with own words, template words and the values of these, read from ``text_col``."""
    read = df.withColumn("raw", _raw(w.text_of(text_col))).withColumn("own", _own(w.text_of(text_col)))
    return read.withColumn("tokens", _tokens(_template(F.col("raw"))))


def _grams(items: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """All windows of the items that are looked for, and the kinds and lengths that occur."""
    bench = _read(items, "item_text").withColumn("values", _tokens(F.col("raw"))).withColumn("item", F.xxhash64("item_text", "item_id"))
    n = lambda c: F.least(F.lit(WINDOW), F.size(c))
    bench = stored(bench.select("item_id", "item", "own", "tokens", "values", n("own").alias("n_own"), n("tokens").alias("n_template")).distinct())
    sizes = [(kind, r[0]) for kind in ("own", "template") for r in bench.select(f"n_{kind}").filter(F.col(f"n_{kind}") >= MIN_ITEM_WORDS).distinct().orderBy(f"n_{kind}").collect()]
    capital = F.get("values", F.lit(0)).rlike(r"^\p{Lu}\p{Ll}+$") & ~_is_slot(F.get("tokens", F.lit(0)))
    out = None
    for i, (kind, n) in enumerate(sizes):
        of = bench.filter(F.col(f"n_{kind}") == n)
        if kind == "own":
            of = _hashed(of).withColumns({"first": F.lit(False), "n_item": F.size("own") - n + 1}).select("*", F.posexplode(_hashes(kind, n)).alias("at", "h"))
            slots = F.array().cast("array<struct<k:int,type:string,value:string>>")
        else:
            fixed = lambda j: F.size(F.filter(F.slice("tokens", j + 1, F.lit(n)), lambda t: ~_is_slot(t)))  # noqa: B023, E731
            of = of.withColumn("kept", F.filter(F.sequence(F.lit(0), F.size("tokens") - n), lambda j: fixed(j) >= MIN_FIXED * n)).withColumn("n_item", F.size("kept"))
            of = of.withColumn("first", F.explode(F.when(capital, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
            of = of.withColumn("tokens", F.when(F.col("first"), F.concat(F.array(F.lit(NAME)), F.slice("tokens", F.lit(2), F.size("tokens")))).otherwise(F.col("tokens")))
            of = _hashed(of).select("*", F.posexplode(_hashes(kind, n)).alias("at", "h")).filter(F.array_contains("kept", F.col("at")) & (~F.col("first") | (F.col("at") == 0)))
            slots = _slots(F.col("at"), F.lit(n))
        one = of.select(F.lit(i).alias("seq"), F.lit(kind == "own").alias("exact"), F.lit(n).alias("n"), "item_id", "item", "n_item", "first", "at", "h", slots.alias("slots"))
        out = one if out is None else out.unionByName(one)
    return out, sizes


LEAK = "doc_key string, told long, doc_id {}, item_id {}, n_windows long, share double, exact boolean"


def _leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_key, told, doc_id, item_id, n_windows, share, exact`` from ``doc_id, text`` and ``item_id, item_text``."""
    docs = docs.withColumn("doc_key", w.group_key("doc_id")).withColumn("told", F.xxhash64(w.text_of("text")))
    grams, sizes = _grams(items)
    if grams is None:
        kinds = LEAK.format(dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"])
        return docs.sparkSession.createDataFrame([], kinds)
    grams = small_side(grams, BROADCAST_WINDOWS)
    # One pass over the texts: the windows of all kinds in one list, of which hashes alone meet the benchmark.
    lists = _hashed(_read(docs, "text")).select("doc_key", "told", "doc_id", *[_hashes(k, n).alias(f"_h{i}") for i, (k, n) in enumerate(sizes)])
    begins = F.array(*[sum((F.size(f"_h{j}") for j in range(i)), F.lit(0)) for i in range(len(sizes))])
    lists = lists.select("doc_key", "told", "doc_id", begins.alias("begins"), F.concat(*[f"_h{i}" for i in range(len(sizes))]).alias("all"))
    seen = lists.select("doc_key", "told", "doc_id", "begins", F.posexplode_outer("all").alias("place", "h"))
    pos = F.col("place") - F.get("begins", F.col("seq"))
    hits = seen.join(grams, "h").select("doc_key", "told", "doc_id", "exact", "n", "item_id", "item", "n_item", "first", "at", "slots", pos.alias("pos"), (pos - F.col("at")).alias("shift"))
    hits = stored(hits.distinct())

    aligned = ["doc_key", "told", "item_id", "item", "n_item", "exact", "shift"]
    enough = F.col("n_windows") >= F.least(F.lit(MIN_WINDOWS), F.col("n_item"))
    counts = hits.groupBy(aligned).agg(F.first("doc_id").alias("doc_id"), F.count_distinct("at").alias("n_windows")).filter(enough)
    counts = stored(counts)
    own = counts.filter("exact").select("doc_key", "told", "doc_id", "item_id", "n_windows", "n_item", F.lit(True).alias("exact"))

    # Values are read only in documents with an alignment of templates.
    maybe = counts.filter("not exact").select("doc_key", "told", "item", "shift")
    open_hits = hits.filter("not exact").join(small_side(maybe, BROADCAST_IDS), ["doc_key", "told", "item", "shift"], "left_semi")
    one = F.struct("item_id", "item", "n_item", "first", "at", "n", "slots", "pos", "shift").alias("hit")
    found = small_side(open_hits.groupBy("doc_key", "told").agg(F.collect_list(one).alias("hits")), BROADCAST_IDS)
    read = docs.join(found, ["doc_key", "told"]).dropDuplicates(["doc_key", "told"])
    # Stored, or the planner would spell out the words again at every hit.
    read = stored(_read(read, "text").withColumn("values", _tokens(F.col("raw"))).select("doc_key", "told", "doc_id", "tokens", "values", "hits"))
    met = F.transform("hits", lambda h: F.struct(h.alias("h"), _slots(h["pos"], h["n"]).alias("seen")))
    read = read.select("doc_key", "told", "doc_id", met.alias("met")).select("doc_key", "told", "doc_id", F.explode("met").alias("m")).select("doc_key", "told", "doc_id", "m.h.*", "m.seen")
    fits = ~F.col("first") | F.coalesce(F.get("seen", F.lit(0))["value"] == F.get("slots", F.lit(0))["value"], F.lit(False))
    pairs = F.zip_with("slots", "seen", lambda a, b: F.struct(F.concat_ws(" ", a["type"], a["value"]).alias("v"), b["value"].alias("u")))
    groups = read.filter(fits).groupBy("doc_key", "told", "item_id", "item", "n_item", "shift").agg(
        F.first("doc_id").alias("doc_id"), F.count_distinct("at").alias("n_windows"), F.array_distinct(F.flatten(F.collect_list(pairs))).alias("pairs")
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["v"])))
    same = F.forall("pairs", lambda p: F.substring_index(p["v"], " ", -1) == p["u"])
    groups = groups.filter(consistent & enough).select("doc_key", "told", "doc_id", "item_id", "n_windows", "n_item", same.alias("exact"))
    share = F.max(F.least(F.lit(1.0), F.col("n_windows") / F.col("n_item")))
    return own.unionByName(groups).groupBy("doc_key", "told", "item_id").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_windows").alias("n_windows"), share.alias("share"), F.max("exact").alias("exact")
    )


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that leaks into it: ``doc_id, item_id, n_windows, share, kind``.

    ``kind`` is ``exact`` if all values are the item's own, else ``reparameterised``.
    """
    found = _leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")))
    kind = F.when(F.col("exact"), "exact").otherwise("reparameterised")
    return found.select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.round("share", 6).alias("share"), kind.alias("kind"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents into which no item leaks; documents are told by id and text."""
    found = _leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")))
    bad = small_side(found.select(F.col("doc_key").alias("leak_key"), F.col("told").alias("leak_told")).distinct(), BROADCAST_IDS)
    same = (w.group_key(docs[id_col]) == F.col("leak_key")) & (F.xxhash64(w.text_of(docs[text_col])) == F.col("leak_told"))
    return docs.join(bad, same, "left_anti")
