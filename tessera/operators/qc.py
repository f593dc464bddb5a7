"""Quality metrics of cells, fragment filters and doublets by coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..session import stored, tasks_of
from .intervals import deep_segments, join_overlaps, join_points, union_intervals

MITO = ("chrM", "M")
AUTOSOME = "^chr[0-9]+$"


def qc_metrics(fragments: DataFrame, min_unique: int = 100, chrom_sizes: DataFrame | None = None) -> DataFrame:
    """Per barcode ``n_unique, duplicate_fraction, mito_fraction``; one shuffle, partly summed before it."""
    if chrom_sizes is not None:
        fragments = fragments.join(F.broadcast(chrom_sizes.select("chrom")), "chrom", "left_semi")
    per = fragments.groupBy("barcode").agg(
        F.sum("count").alias("n_total"), F.count(F.lit(1)).alias("n_unique"), F.sum(F.when(F.col("chrom").isin(*MITO), F.col("count")).otherwise(0)).alias("n_mito")
    )
    total = F.col("n_total") + 1e-9
    return per.filter(F.col("n_unique") >= min_unique).select(
        "barcode", "n_unique", ((F.col("n_total") - F.col("n_unique")) / total).alias("duplicate_fraction"), (F.col("n_mito") / total).alias("mito_fraction")
    )


def tss_of(transcripts: DataFrame) -> DataFrame:
    """Distinct ``chrom, tss, strand`` of 1-based transcripts."""
    return transcripts.select("chrom", (F.when(F.col("strand") == "-", F.col("g_end")).otherwise(F.col("g_start")) - 1).alias("tss"), "strand").distinct()


def tss_enrichment(fragments: DataFrame, tss: DataFrame, window: int = 2000, smooth: int = 11, exclude: tuple[str, ...] = MITO) -> DataFrame:
    """``barcode, tsse_score``: insertions near transcription starts against both flanks.

    Insertions are counted per position before the join, which every pair then multiplies.
    """
    half = smooth // 2
    points = fragments.select("barcode", "chrom", F.explode(F.array(F.col("start"), F.col("end") - 1)).alias("pos")).groupBy("barcode", "chrom", "pos").agg(F.count(F.lit(1)).alias("k"))
    near = tss.filter(~F.col("chrom").isin(*exclude)).select("chrom", "tss", "strand", (F.col("tss") - window).alias("lo"), (F.col("tss") + window + 1).alias("hi"))
    pairs = join_points(points, near, "pos", "lo", "hi")
    o = F.when(F.col("strand") == "-", F.col("tss") - F.col("pos")).otherwise(F.col("pos") - F.col("tss")) + window
    part = F.when(o < 100, 0).when(o.between(window - half, window + half), 1).when(o > 2 * window - 100, 2)
    sums = pairs.withColumn("part", part).groupBy("barcode").agg(*[F.sum(F.when(F.col("part") == i, F.col("k")).otherwise(0)).alias(f"b{i}") for i in range(3)])
    return sums.select("barcode", ((F.col("b1") / smooth) / ((F.col("b0") / 100 + F.col("b2") / 100) / 2 + 0.1)).alias("tsse_score"))


def compute_metrics(fragments: DataFrame, tss: DataFrame, window: int = 2000, smooth: int = 11, min_unique: int = 100, chrom_sizes: DataFrame | None = None) -> DataFrame:
    cells = qc_metrics(fragments, min_unique, chrom_sizes)
    score = tss_enrichment(fragments, tss, window, smooth)
    return cells.join(score, "barcode", "left").withColumn("tsse_score", F.coalesce("tsse_score", F.lit(0.0))).select("barcode", "tsse_score", "n_unique", "duplicate_fraction", "mito_fraction")


_WORD = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<text>'[^']*'|\"[^\"]*\")|(?P<name>`[^`]+`|[A-Za-z_]\w*)|(?P<op><=|>=|==|!=|[<>()&|~-]))")


class _Predicate:
    """Comparisons of columns and constants, joined by and, or, not and parentheses."""

    def __init__(self, text: str, columns: list[str]) -> None:
        self.words: list[tuple[str, str]] = []
        self.columns = columns
        at = 0
        while text[at:].strip():
            m = _WORD.match(text, at)
            if not m:
                raise ValueError(f"cannot read filter query {text!r} at {text[at:].strip()[:20]!r}")
            kind = m.lastgroup or ""
            word = m[kind]
            if kind == "name" and word in ("and", "or", "not"):
                kind, word = "op", {"and": "&", "or": "|", "not": "~"}[word]
            self.words.append((kind, word))
            at = m.end()
        self.text, self.at = text, 0
        self.column = self.any_of()
        if self.at < len(self.words):
            raise ValueError(f"cannot read filter query {text!r} at {self.words[self.at][1]!r}")

    def take(self, *ops: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] == "op" and self.words[self.at][1] in ops:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def any_of(self) -> Column:
        out = self.all_of()
        while self.take("|"):
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.one()
        while self.take("&"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.take("~"):
            return ~self.one()
        if self.take("("):
            out = self.any_of()
            if not self.take(")"):
                raise ValueError(f"a parenthesis is open in filter query {self.text!r}")
            return out
        left, out = self.value(), None
        while op := self.take("<", "<=", ">", ">=", "==", "!="):
            right = self.value()
            more = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "==": left == right, "!=": left != right}[op]
            left, out = right, more if out is None else out & more
        if out is None:
            raise ValueError(f"filter query {self.text!r} lacks a comparison")
        return out

    def value(self) -> Column:
        sign = -1 if self.take("-") else 1
        kind, word = self.words[self.at] if self.at < len(self.words) else ("", "its end")
        self.at += 1
        if kind == "number":
            return F.lit(sign * (float(word) if re.search("[.eE]", word) else int(word)))
        if kind == "text" and sign > 0:
            return F.lit(word[1:-1])
        if kind == "name" and word.strip("`") in self.columns:
            return F.col(f"`{word.strip('`')}`") * sign if sign < 0 else F.col(f"`{word.strip('`')}`")
        raise ValueError(f"cannot read filter query {self.text!r} at {word!r}")


def apply_query(df: DataFrame, query: str) -> DataFrame:
    """Rows that satisfy comparisons (``> < >= <= == !=``, chained as well) joined by and, or, not; ValueError if it cannot be read.

    Nothing else is read, so no function can be called.
    """
    return df.filter(_Predicate(query, df.columns).column)


def add_prefix(df: DataFrame, prefix: str | None, column: str = "barcode") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column))) if prefix else df


def passing_cells(fragments: DataFrame, metrics: DataFrame | None = None, query: str | None = None, min_fragments: int = 100) -> DataFrame:
    """The ``barcode`` of cells with enough fragments: by ``n_unique`` of the metrics if given, else counted."""
    if metrics is None:
        return fragments.groupBy("barcode").count().filter(F.col("count") >= min_fragments).select("barcode")
    cells = apply_query(metrics, query) if query else metrics
    if "n_unique" in cells.columns:
        cells = cells.filter(F.col("n_unique") >= min_fragments)
    return cells.select("barcode").distinct()


def filter_fragments(fragments: DataFrame, *, metrics: DataFrame | None = None, query: str | None = None, min_fragments: int = 100, prefix: str | None = None, chrom_sizes: DataFrame | None = None) -> DataFrame:
    """The fragments of passing cells on valid chromosomes; the prefix is added before cells are matched."""
    df = add_prefix(fragments, prefix)
    if chrom_sizes is not None:
        df = df.join(F.broadcast(chrom_sizes.select("chrom")), "chrom", "left_semi")
    return df.join(passing_cells(df, metrics, query, min_fragments), "barcode", "left_semi").select(*fragments.columns)


def _untouched(df: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows whose interval shares no position with any of the spans of its chromosome, told by their place and not by a number."""
    spans = spans.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    places = df.select("chrom", "start", "end").distinct()
    hit = join_overlaps(places, spans, "start", "end", "r_start", "r_end").select("chrom", "start", "end").distinct()
    return df.join(hit, ["chrom", "start", "end"], "left_anti").select(*df.columns)


def without_repeats(fragments: DataFrame, repeats: DataFrame) -> DataFrame:
    """Fragments that touch no repeat of their chromosome."""
    return _untouched(fragments, repeats)


def overlap_segments(fragments: DataFrame, expected: int = 2, max_insert: int = 900) -> DataFrame:
    """Segments where a cell has more fragments than two chromosome copies allow."""
    return deep_segments(fragments.filter(F.col("end") - F.col("start") <= max_insert).select("barcode", "chrom", "start", "end"), ("barcode", "chrom"), expected + 1)


def incidence(regions: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct ``chrom, start, end, barcode`` of regions and the cells with a segment in them."""
    seg = segments.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "barcode")
    return join_overlaps(regions, seg, "start", "end", "s", "e").select("chrom", "start", "end", "barcode").distinct()


def poisson_excess(counts: DataFrame, value: str, key: tuple[str, ...]) -> DataFrame:
    """``p_value`` and ``q_value`` of each count under a Poisson law with the mean of all."""
    mean = counts.agg(F.avg(value).alias("_mean"))
    tested = counts.crossJoin(F.broadcast(mean)).withColumn("p_value", stats.poisson_upper(F.col(value), F.col("_mean"))).drop("_mean")
    return stats.benjamini_hochberg(tested, "p_value", "q_value", tie=key)


def repeat_regions(per_region: DataFrame, q_repeat: float = 0.01) -> DataFrame:
    """Regions (chrom, start, end, n) that more cells share than chance lets expect."""
    tested = poisson_excess(per_region, "n", ("chrom", "start", "end"))
    return tested.filter(F.col("q_value") < q_repeat).select("chrom", "start", "end")


def detect_doublets(
    fragments: DataFrame, *, barcodes: DataFrame | None = None, min_fragments: int = 100, expected: int = 2, max_insert: int = 900,
    q_threshold: float = 0.01, q_repeat: float = 0.01, repeats: DataFrame | None = None, min_overlap_bp: int = 1,
) -> DataFrame:
    """``cell_id, p_value, q_value, is_doublet`` of candidate cells, on autosomes.

    Regions that too many cells share are taken for repeats and left out, then regions are formed anew.
    """
    reads = fragments.filter(F.col("chrom").rlike(AUTOSOME))
    cells = passing_cells(reads, min_fragments=min_fragments)
    if barcodes is not None:
        cells = cells.join(barcodes.select("barcode").distinct(), "barcode", "left_semi")
    reads = reads.join(cells, "barcode", "left_semi")
    if repeats is not None:
        reads = without_repeats(reads, repeats)
    tasks = tasks_of(fragments.sparkSession, fragments.count())
    segments = stored(overlap_segments(reads, expected, max_insert).filter(F.col("end") - F.col("start") >= min_overlap_bp), tasks=tasks)
    regions = stored(union_intervals(segments.select("chrom", "start", "end")), tasks=tasks)
    found = stored(incidence(regions, segments), tasks=tasks)
    per_region = regions.join(found.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n")), ["chrom", "start", "end"], "left").fillna(0, ["n"])
    kept = stored(_untouched(segments, repeat_regions(per_region, q_repeat)), tasks=tasks)
    found = stored(incidence(union_intervals(kept.select("chrom", "start", "end")), kept), tasks=tasks)
    per_cell = cells.join(found.groupBy("barcode").agg(F.count(F.lit(1)).alias("n")), "barcode", "left").fillna(0, ["n"])
    tested = poisson_excess(per_cell, "n", ("barcode",))
    most = per_cell.agg(F.max("n").alias("_most"))
    none = F.coalesce(F.col("_most"), F.lit(0)) == 0
    p, q = F.when(none, 1.0).otherwise(F.col("p_value")), F.when(none, 1.0).otherwise(F.col("q_value"))
    tested = tested.crossJoin(F.broadcast(most))  # one row
    return tested.select(F.col("barcode").alias("cell_id"), p.alias("p_value"), q.alias("q_value")).withColumn("is_doublet", F.col("q_value") < q_threshold)
