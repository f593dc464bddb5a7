"""Personal data: regular expressions propose spans, validators confirm, context adjusts the score.

Spans are in code points with exclusive ends. Every span has a score: a start value for its kind,
raised by context words near the span, before or after it. Base kinds (email, ip, card, phone) need
their pattern and validator only, so their score is told but decides nothing. Further kinds (a card
number within a longer chain of digits, IBAN, national id, secret) need a score of ``MIN_SCORE``.
Secrets are keys of known shape, values assigned to a name that says secret, and long tokens of many
different characters near such a name. Context ends at the candidates of the same kind.

Defined results: null or empty text has no spans; texts are searched whole, whatever their length;
spans that start together are ordered by kind, then end, and equal spans are one, with the higher
score; repeated rows are searched each; an empty table gives no rows; ``pii`` and ``pii_base`` of
the input are replaced, and no other column clashes. Patterns are possessive, so that time is linear
in the text whatever it holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w

MIN_SCORE = 0.5
#: Code points before and after a span in which context words count.
CONTEXT = 40


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def luhn(v: Column) -> Column:
    """Whether the digits of a short string pass the Luhn check."""
    d = _digits(v)

    def weighed(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def mod97(v: Column) -> Column:
    """Whether an IBAN, its first four characters moved to the end, leaves 1 when divided by 97."""
    s = F.regexp_replace(v, "[ ]+", "")
    s = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def fold(a: Column, c: Column) -> Column:
        x = F.ascii(c)
        return F.when(x >= 65, (a * 100 + x - 55) % 97).otherwise((a * 10 + x - 48) % 97)

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), fold) == 1


def _ip_parts(v: Column) -> Column:
    # Leading zeros do not count towards the size of a part.
    return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.substr(-3, 3).cast("int"), F.lit(0)) <= 255))


def _n_digits(v: Column, least: int, most: int) -> Column:
    return F.length(_digits(v)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; ``score`` counts for kinds beyond the base ones."""

    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]
    base: bool = True
    score: float = 1.0
    context: str = ""
    bonus: float = 0.0


def _card(v: Column) -> Column:
    return F.when(_n_digits(v, 14, 19), luhn(v)).otherwise(False)


def _mixed(v: Column) -> Column:
    """Enough different characters, digits and letters among them, for a value that nobody would write as prose."""
    return (F.size(F.array_distinct(F.split(v, ""))) >= 6) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")


_CARD = r"(?i)card|visa|credit|master|amex"
_SAYS_SECRET = "token|secret|api.?key|access.?key|passw(?:or)?d|pwd|auth"
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda v: F.lit(True), True, 0.8, r"(?i)mail|contact|write", 0.2),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", _ip_parts, True, 0.5, r"(?i)\bip\b|address|host|server|login", 0.4),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]{2}|[0-9][\\x20-][0-9]", _card, True, 0.6, _CARD, 0.3),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda v: _n_digits(v, 10, 15), True, 0.6, r"(?i)tel|phone|call|mobile|fax", 0.3),
    Kind("card", r"(?<![0-9])(?:[0-9]{14,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])", "[0-9]{14}|[0-9]{4}[\\x20-][0-9]{4}", _card, False, 0.6, _CARD, 0.3),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}+(?:[\x20]?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", mod97, False, 0.6, r"(?i)iban|account|konto|compte|cuenta", 0.3),
    Kind("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), False, 0.3, r"(?i)ssn|social|security|tax|id\b", 0.4),
    Kind("secret", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])", "[0-9A-Fa-f]{32}", lambda v: v.rlike("[0-9]"), False, 0.2, f"(?i){_SAYS_SECRET}", 0.6),
    # Prefixes by which well-known services mark their keys.
    Kind("secret", r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsru]_[0-9A-Za-z]{36,255}|xox[abprs]-[0-9A-Za-z-]{10,250}|AIza[0-9A-Za-z_-]{35}|sk-[0-9A-Za-z_-]{20,200}|eyJ[0-9A-Za-z_-]{10,}+\.eyJ[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+)(?![0-9A-Za-z])", "AKIA|ASIA|gh[opsru]_|xox|AIza|sk-|eyJ", lambda v: F.lit(True), False, 0.9, f"(?i){_SAYS_SECRET}", 0.1),
    Kind("secret", rf"(?<=(?i:{_SAYS_SECRET})[\"']{{0,1}} {{0,2}}[:=] {{0,2}}[\"']{{0,1}})(?<![^\s:=\"'])[^\s\"'<>;,()]{{8,200}}+", f"(?i)(?:{_SAYS_SECRET})[\"']? {{0,2}}[:=]", _mixed, False, 0.7),
    Kind("secret", r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_-]{32,200}+={0,2}(?![0-9A-Za-z+/_=-])", "[0-9A-Za-z+/_-]{32}", lambda v: _mixed(v) & v.rlike("[A-Z]") & v.rlike("[a-z]"), False, 0.2, f"(?i){_SAYS_SECRET}", 0.6),
)
BASE = tuple(k.name for k in KINDS if k.base)
ORDER = ("email", "ip", "card", "phone", "iban", "national_id", "secret")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _lengths(gaps: str) -> Callable[[Column, Column], Column]:
    return lambda h, j: F.length(h) + F.length(F.get(gaps, j))


def _at_least(score: float) -> Callable[[Column], Column]:
    return lambda s: s["score"] >= score


def _scored(k: Kind, i: int) -> Callable[[Column, Column], Column]:
    """From a match and its number to its span and score; -1 where the validator rejects it."""

    def span(h: Column, j: Column) -> Column:
        before, after = F.right(F.get(f"_gap{i}", j), F.lit(CONTEXT)), F.left(F.get(f"_gap{i}", j + 1), F.lit(CONTEXT))
        near = before.rlike(k.context) | after.rlike(k.context)
        score = F.lit(k.score) + F.when(near, k.bonus).otherwise(0.0) if k.context else F.lit(k.score)
        end = F.get(f"_end{i}", j)
        return F.struct(
            (end - F.length(h)).alias("start"), F.lit(ORDER.index(k.name)).alias("rank"), end.alias("end"), F.lit(k.name).alias("kind"),
            F.when(F.coalesce(k.valid(h), F.lit(False)), score).otherwise(-1.0).alias("score"),
        )

    return span


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii``, all spans in order of start and kind, and ``pii_base``, the base spans."""
    df = docs.select(F.struct(*docs.columns).alias("_row"), w.text_of(text_col).alias("_text"))
    empty = F.array().cast("array<string>")
    for i, k in enumerate(KINDS):
        seen = F.col("_text").contains(k.needs) if k.needs == "@" else F.col("_text").rlike(k.needs)
        df = df.withColumn(f"_hit{i}", F.when(seen, F.regexp_extract_all("_text", F.lit(k.pattern), F.lit(0))).otherwise(empty))
    for i, k in enumerate(KINDS):
        df = df.withColumn(f"_gap{i}", F.when(F.size(f"_hit{i}") > 0, F.split("_text", k.pattern, -1)).otherwise(empty))
    df = df.drop("_text")
    for i, _ in enumerate(KINDS):
        df = df.withColumn(f"_len{i}", F.transform(f"_hit{i}", _lengths(f"_gap{i}")))
    for i, _ in enumerate(KINDS):
        df = df.withColumn(f"_end{i}", F.when(F.size(f"_len{i}") > 0, w.running(F.col(f"_len{i}"))).otherwise(F.array().cast("array<int>")))
    for i, k in enumerate(KINDS):
        found = F.filter(F.transform(f"_hit{i}", _scored(k, i)), _at_least(0.0 if k.base else MIN_SCORE))
        df = df.withColumn(f"_span{i}", F.when(F.size(f"_hit{i}") > 0, found.cast(SPAN)).otherwise(F.array().cast(SPAN)))
    base = [f"_span{i}" for i, k in enumerate(KINDS) if k.base]
    more = [f"_span{i}" for i, k in enumerate(KINDS) if not k.base]
    df = df.withColumn("pii_base", F.array_sort(F.concat(*base)))
    places = F.transform(F.filter("pii_base", lambda b: b["kind"] == "card"), lambda b: F.struct(b["start"], b["end"]))
    new = F.filter(F.concat(*more), lambda s: (s["kind"] != "card") | ~F.array_contains(places, F.struct(s["start"], s["end"])))
    both = F.array_sort(F.concat("pii_base", new))
    df = df.withColumn("pii", F.when(F.size(F.concat(*more)) > 0, both).otherwise(F.col("pii_base")))
    # Of equal spans the last has the highest score.
    equal = lambda s, o: F.coalesce((o["start"] == s["start"]) & (o["end"] == s["end"]) & (o["kind"] == s["kind"]), F.lit(False))
    single = F.filter("pii", lambda s, j: ~equal(s, F.get("pii", j + 1)))
    return df.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("pii", "pii_base")], single.alias("pii"), "pii_base")


def written(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base counts, the digest of the base spans, and all spans and their scores as text."""
    found = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    n = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in BASE], F.sha2(written(F.col("pii_base")), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``[KIND]`` in place of each span; a span that begins inside an earlier one is merged into it."""
    df = spans(docs, text_col)
    start = lambda s: F.aggregate(F.filter("pii", lambda o: o["start"] < s["start"]), F.lit(0), lambda a, o: F.greatest(a, o["end"]))
    df = df.withColumn("_open", F.filter("pii", lambda s, j: (s["start"] >= start(s)) & ((j == 0) | (F.coalesce(F.get("pii", j - 1)["start"], F.lit(-1)) != s["start"]))))
    upto = lambda s, j: F.aggregate(F.filter("pii", lambda o: o["start"] < F.coalesce(F.get("_open", j + 1)["start"], F.lit(1 << 30))), F.lit(0), lambda a, o: F.greatest(a, o["end"]))
    text = w.text_of(text_col)
    part = lambda s, j: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"), F.substr(text, upto(s, j) + 1, F.coalesce(F.get("_open", j + 1)["start"], F.length(text)) - upto(s, j)))
    out = F.concat(F.substr(text, F.lit(1), F.get("_open", F.lit(0))["start"]), F.array_join(F.transform("_open", part), ""))
    return df.withColumn(text_col, F.when(F.size("_open") > 0, out).otherwise(F.col(text_col))).drop("_open", "pii", "pii_base")
