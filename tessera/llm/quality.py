"""Quality rules: distribution divergence from language references.

Per document two histograms are compared with references by Jensen-Shannon distance: character
classes, and common words of the document's language (each of them, and all other words). The
references are fixed shares per language, so a verdict depends on the document alone and not on the
corpus around it. Documents of other or no language are compared with general character shares, by a
wider limit, and not by words; there are two sets of these, one for scripts that are written without
blanks between words, which a document gets if most of its letters belong to them. A comparison counts only for documents above a minimum length.

Defined results: null text has no words and fails the base rules; a null or unknown language has the
general reference; texts are counted whole, whatever their length; distances at a limit are kept;
repeated rows are judged each; an empty table gives no rows; ``quality`` reads id, text and language
only, ``stats`` replaces columns of the input that clash with the names it adds, and ``keep_good``
returns the input's columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w

# Common words of each language with their share of all words in thousandths, rounded,
# from general knowledge of the languages.
COMMON_WORDS = {
    "en": "the 60 of 30 and 28 to 26 in 20 a 22 is 11 that 10 it 10 for 9 as 7 with 7 was 8 on 7 by 6 are 5 be 6 this 5 from 4 or 4 an 3.5 at 5",
    "fr": "de 50 la 30 le 25 et 25 les 22 des 18 en 14 un 13 une 11 du 13 que 10 qui 8 dans 9 pour 8 par 8 sur 7 est 9 pas 5 au 7 avec 4 elle 3 plus 5",
    "de": "der 35 die 33 und 28 in 19 den 13 von 11 zu 11 das 11 mit 9 sich 7 des 7 auf 8 ist 8 im 8 dem 8 nicht 6 ein 7 eine 7 als 6 auch 5 es 5 an 5",
    "es": "de 62 la 38 que 30 el 28 en 27 y 26 a 21 los 17 se 13 del 12 las 11 un 10 por 9 con 9 no 9 una 8 su 8 para 8 es 7 al 6 lo 6 como 5",
}
CHAR_CLASSES = ("upper", "lower", "digit", "blank", "symbol", "other")
# Shares of the character classes in prose, rounded, from general knowledge; letters
# without case and the marks that go with letters count as lower, symbols are #*$%&|<>.
CHAR_SHARES = {
    "en": (0.025, 0.78, 0.008, 0.168, 0.0005, 0.0185),
    "fr": (0.025, 0.79, 0.008, 0.157, 0.0005, 0.0195),
    "de": (0.055, 0.775, 0.008, 0.142, 0.0005, 0.0195),
    "es": (0.025, 0.79, 0.008, 0.16, 0.0005, 0.0165),
}
GENERAL_SHARES = (0.0325, 0.78375, 0.008, 0.15675, 0.0005, 0.0185)
# The same for scripts without blanks between words, and those scripts.
UNSPACED_SHARES = (0.002, 0.89, 0.01, 0.04, 0.0005, 0.0575)
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")
N_COMMON = 22


def common_words(lang: str) -> dict[str, float]:
    """The common words of a language with their shares."""
    listed = COMMON_WORDS[lang].split()
    return {x: float(y) / 1000 for x, y in zip(listed[::2], listed[1::2], strict=True)}


def word_shares(lang: str) -> list[float]:
    """The shares of the common words and of all others."""
    shares = list(common_words(lang).values())
    return [*shares, 1 - sum(shares)]


MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Fewest characters and words for a comparison to count, and the distances above which it rejects.
MIN_CHARS_COMPARED = 200
MIN_WORDS_COMPARED = 50
MAX_CHAR_DISTANCE = 0.2
#: The same where the language has no reference of its own.
MAX_GENERAL_DISTANCE = 0.25
#: Both distances together reject from here on.
BOTH_CHAR_DISTANCE = 0.17
BOTH_WORD_DISTANCE = 0.3


LETTERS = r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+"


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _repeat_words(tri: Column, packed: Column) -> tuple[Column, Column]:
    """Positions of windows that may repeat; how many words the windows that do repeat cover.

    ``packed`` holds the high bits of each window's hash above its position, sorted, so that equal
    neighbours are candidates; the full hashes then decide.
    """
    near = lambda x, y: F.shiftright(x, 24) == F.shiftright(y, 24)
    flagged = F.transform(
        packed,
        lambda x, k: F.when(
            F.coalesce(near(F.get(packed, k - 1), x), F.lit(False)) | F.coalesce(near(F.get(packed, k + 1), x), F.lit(False)),
            x.bitwiseAND(F.lit(0xFFFFFF)).cast("int"),
        ).otherwise(F.lit(-1)),
    )
    everything = F.sequence(F.lit(0), F.size(tri) - 1)
    candidates = F.when(F.size(tri) < (1 << 24), F.filter(flagged, lambda i: i >= 0)).otherwise(everything)
    return candidates, F.array_sort(F.transform("_cand", lambda i: F.struct(F.get(tri, i).alias("h"), i.alias("i"))))


def stats(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with word, symbol, line and repeat counts, both histograms and the base verdict."""
    text = w.text_of(text_col)
    low_high = F.col("_low") + F.col("_up")
    n = F.size("_words")
    tri = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
    ).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(w.WORD))
    listed = sorted({x for k in COMMON_WORDS for x in common_words(k)})
    # Each listed word of the text becomes one letter, so that counting them reads a short string.
    letter = {k: {x: chr(97 + i) for i, x in enumerate(common_words(k))} for k in COMMON_WORDS}
    literal = lambda m: F.create_map(*[F.lit(y) for kv in m.items() for y in kv])
    letters = F.create_map(*[y for k, m in letter.items() for y in (F.lit(k), literal(m))])
    hits = F.filter(F.transform("_words", F.lower), lambda x: x.isin(listed))
    coded = F.array_join(F.transform(hits, lambda x: F.element_at(F.col("_letters"), x)), "")
    counts = F.array(*[(F.length("_hits") - F.length(F.replace(F.col("_hits"), F.lit(chr(97 + i)), F.lit("")))).cast("long") for i in range(N_COMMON)])

    df = docs.withColumn("_text", text).withColumns(
        {
            "_words": w.words(F.col("_text")),
            "_n": F.length("_text").cast("long"),
            "word_chars": _without(F.col("_text"), w.BLANKS),
            "_up": _without(F.col("_text"), r"[^\p{Lu}]+"),
            "_low": F.length("_text") - _without(F.col("_text"), LETTERS),
            "_digit": _without(F.col("_text"), "[^0-9]+"),
            "unspaced_chars": F.when(F.coalesce(F.col(lang_col).isin(*CHAR_SHARES), F.lit(False)), F.lit(0)).otherwise(_without(F.col("_text"), f"[^{''.join(rf'\p{{Is{x}}}' for x in UNSPACED)}]+")).cast("long"),
            "n_symbols": _without(F.col("_text"), "[^#*$%&|<>]+"),
            "_lines": lines,
            "_letters": F.element_at(letters, F.col(lang_col)),
        }
    )
    df = df.withColumns(
        {
            "_tri": tri,
            "n_words": n.cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hits": F.when(F.col("_letters").isNotNull(), coded),
            "char_counts": F.array(
                F.col("_up"), F.col("_low"), F.col("_digit"), F.col("_n") - F.col("word_chars"), F.col("n_symbols"),
                F.col("word_chars") - low_high - F.col("_digit") - F.col("n_symbols"),
            ),
        }
    ).drop("_words", "_lines", "_text", "_up", "_low", "_digit", "_letters")
    df = df.withColumns(
        {
            "_packed": F.sort_array(F.transform("_tri", lambda h, i: h.bitwiseAND(F.lit(~0xFFFFFF)).bitwiseOR(i.cast("long")))),
            "_counts": F.when(F.col("_hits").isNotNull(), counts),
        }
    )
    candidates, pairs = _repeat_words(F.col("_tri"), F.col("_packed"))
    same = lambda x, k: F.coalesce(F.get("_pairs", k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_cand", candidates).withColumn("_pairs", pairs)
    df = df.withColumn(
        "_at", F.array_sort(F.transform(F.filter("_pairs", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    covered = total(F.transform("_at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - i, F.lit(3)))))
    df = df.withColumns(
        {
            "n_repeat_words": covered,
            "common_counts": F.concat("_counts", F.array(F.col("n_words") - total(F.col("_counts")))),
        }
    ).drop("_packed", "_counts", "_cand", "_pairs", "_at", "_tri", "_hits")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("n_chars_seen", F.col("_n")).drop("_n")


def distance(counts: Column, n: Column, ref: Column) -> Column:
    """Jensen-Shannon distance, base 2, between counts that sum to ``n`` and shares.

    The three meet in a struct first, as the planner would spell out a column again within a function
    of elements.
    """
    def gain(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    def of(s: Column) -> Column:
        parts = F.zip_with(s["c"], s["r"], lambda c, q: gain(c / s["n"], q) + gain(q, c / s["n"]))
        return F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))

    return F.get(F.transform(F.array(F.struct(counts.alias("c"), n.alias("n"), ref.alias("r"))), of), F.lit(0))


def _literal(shares: list[float] | tuple[float, ...]) -> Column:
    return F.array(*[F.lit(float(x)) for x in shares])


def _by_language(lang: Column, shares: dict[str, list[float]], general: Column | None) -> Column:
    """The literal array of the language, or the general one."""
    out = None
    for k, xs in shares.items():
        out = F.when(lang == k, _literal(xs)) if out is None else out.when(lang == k, _literal(xs))
    return out if general is None else out.otherwise(general)


def judge(measured: DataFrame, lang_col: str = "lang") -> DataFrame:
    """``measured`` with ``char_distance``, ``word_distance`` and ``kept``."""
    lang = F.col(lang_col)
    unspaced = 2 * F.col("unspaced_chars") > F.get("char_counts", F.lit(0)) + F.get("char_counts", F.lit(1))
    chars = _by_language(lang, CHAR_SHARES, F.when(unspaced, _literal(UNSPACED_SHARES)).otherwise(_literal(GENERAL_SHARES)))
    common = _by_language(lang, {k: word_shares(k) for k in COMMON_WORDS}, None)
    far = lambda d, most: F.coalesce(F.col(d) > most, F.lit(False))
    compared = measured.withColumns(
        {
            "char_distance": F.round(F.when(F.col("n_chars_seen") >= MIN_CHARS_COMPARED, distance(F.col("char_counts"), F.col("n_chars_seen"), chars)), 6),
            "word_distance": F.round(F.when(F.col("n_words") >= MIN_WORDS_COMPARED, distance(F.col("common_counts"), F.col("n_words"), common)), 6),
        }
    )
    known = F.coalesce(lang.isin(*CHAR_SHARES), F.lit(False))
    both = far("char_distance", BOTH_CHAR_DISTANCE) & far("word_distance", BOTH_WORD_DISTANCE)
    rejected = F.when(known, far("char_distance", MAX_CHAR_DISTANCE) | both).otherwise(far("char_distance", MAX_GENERAL_DISTANCE))
    return compared.withColumn("kept", ~F.col("base_failed") & ~rejected)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: its counts, distances and verdict, without its text."""
    return judge(stats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))).drop("text"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, in full, in one pass.

    A filter on the verdict would be pushed below the counts and spell them out again, so it also
    reads a column that the planner takes for non-deterministic and must not move a filter across.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    judged = judge(stats(rows)).select("_row", "kept", F.spark_partition_id().alias("_task"))
    return judged.filter(F.col("kept") & (F.col("_task") >= 0)).select("_row.*")
