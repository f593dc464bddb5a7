"""Cell-by-feature counts in coordinate form: tiles, genes, gene scores, feature selection, unions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import along
from ..session import stored, tasks_of
from .intervals import join_points
from .qc import apply_query, passing_cells

EXCLUDED = ("chrM", "chrY", "M", "Y")
REGION = r"^(.+)[:;]([0-9]+)-([0-9]+)$"


def tiles_of(size: int) -> Column:
    """The tiles that both ends of a fragment fall in, each once."""
    return F.array_distinct(F.array(F.floor(F.col("start") / size), F.greatest(F.floor((F.col("end") - 1) / size), F.lit(0)).cast("long")))


def tile_matrix(fragments: DataFrame, chrom_sizes: DataFrame, tile_size: int = 5000, min_fragments: int = 100, exclude: tuple[str, ...] = EXCLUDED, strategy: str = "unique", cells: DataFrame | None = None) -> DataFrame:
    """``barcode, chrom, tile, value``; strategy is unique, count or binarize.

    Cells are judged on all chromosomes. Tiles beyond the end of a chromosome are left out.
    """
    if strategy not in ("unique", "count", "binarize"):
        raise ValueError(f"unknown count strategy {strategy!r}")
    sizes = F.broadcast(chrom_sizes.select("chrom", "size"))
    known = fragments.join(sizes, "chrom")
    keep = passing_cells(known, min_fragments=min_fragments)
    if cells is not None:
        keep = keep.join(cells.select("barcode").distinct(), "barcode", "left_semi")
    used = known.filter(~F.col("chrom").isin(*exclude)).join(keep, "barcode", "left_semi")
    spread = used.select("barcode", "chrom", "count", "size", F.explode(tiles_of(tile_size)).alias("tile")).filter(F.col("tile") * tile_size < F.col("size"))
    value = {"unique": F.count(F.lit(1)), "count": F.sum("count"), "binarize": F.max(F.lit(1))}[strategy]
    return spread.groupBy("barcode", "chrom", "tile").agg(value.cast("long").alias("value"))


def tile_dimension(chrom_sizes: DataFrame, tile_size: int = 5000, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """All tiles ``chrom, tile, start, end, name, index``, the last of a chromosome clipped to its size."""
    n = F.ceil(F.col("size") / tile_size).cast("long")
    sized = chrom_sizes.filter(~F.col("chrom").isin(*exclude)).withColumn("n", n)
    sized = sized.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tiles = sized.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start, end = F.col("tile") * tile_size, F.least((F.col("tile") + 1) * tile_size, F.col("size"))
    return tiles.select("chrom", "tile", start.alias("start"), end.cast("long").alias("end"), F.concat("chrom", F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")).alias("name"), (F.col("offset") + F.col("tile")).alias("index"))


def parse_regions(df: DataFrame, name: str = "feature", closed: bool = False) -> DataFrame:
    """``df`` with ``chrom, start, end`` from names as ``chr:1-2`` or ``chr;1-2``; others, and empty intervals, are dropped."""
    part = lambda i: F.regexp_extract(name, REGION, i)
    return df.filter(F.col(name).rlike(REGION)).withColumns({"chrom": part(1), "start": part(2).try_cast("long"), "end": part(3).try_cast("long")}).filter("end >= start" if closed else "end > start")


#: Columns that tell how many fragments a cell has, by preference, after a join with metrics and before it.
COUNT_COLUMNS = ("n_unique_metrics", "n_unique", "n_fragment", "n_interval_counts")


def retile(x: DataFrame, tile_size: int, *, obs: DataFrame | None = None, metrics: DataFrame | None = None, query: str | None = None, min_fragments: int = 0) -> DataFrame:
    """An interval matrix ``cell, feature, value`` on tiles; every tile that is touched gets the full value.

    Cells may be judged: ``metrics`` (barcode, ...) are joined to the cells of ``obs`` (cell, ...), clashing
    names get ``_metrics``, ``query`` filters, and the first of ``COUNT_COLUMNS`` must reach ``min_fragments``;
    without any of these, the sum of a cell's values does. ValueError if there is no interval name, no
    common cell, or no cell left.
    """
    if tile_size < 1:
        raise ValueError("a tile has one base at least")
    named = parse_regions(x)
    if named.isEmpty():
        raise ValueError("no feature is named as an interval")
    cells = x.groupBy("cell").agg(F.sum("value").cast("long").alias("n_interval_counts"))
    if obs is not None:
        cells = cells.join(obs.drop("n_interval_counts"), "cell")
    if metrics is not None:
        other = metrics.withColumnRenamed("barcode", "cell")
        clash = [c for c in other.columns if c != "cell" and c in cells.columns]
        cells = cells.join(other.select("cell", *[F.col(c).alias(f"{c}_metrics" if c in clash else c) for c in other.columns if c != "cell"]), "cell")
        if cells.isEmpty():
            raise ValueError("no cell of the matrix has metrics")
    if query or min_fragments or metrics is not None:
        if query:
            cells = apply_query(cells, query)
        count = next(c for c in COUNT_COLUMNS if c in cells.columns)
        cells = cells.filter(F.col(count) >= min_fragments)
        if cells.isEmpty():
            raise ValueError("no cell passes the filter")
        named = named.join(cells.select("cell"), "cell", "left_semi")
    spread = named.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile_size), F.floor((F.col("end") - 1) / tile_size))))
    return spread.groupBy("cell", "chrom", "tile").agg(F.sum("value").cast("long").alias("value"))


def gene_domains(transcripts: DataFrame, upstream: int = 2000, downstream: int = 0, include_body: bool = True) -> DataFrame:
    """``chrom, start, end, id``: transcripts widened by strand, from 1-based to 0-based, each once."""
    s, e, plus = F.col("g_start") - 1, F.col("g_end") - 1, F.col("strand") == "+"
    if include_body:
        lo, hi = F.when(plus, s - upstream).otherwise(s - downstream), F.when(plus, e + downstream).otherwise(e + upstream)
    else:
        lo, hi = F.when(plus, s - upstream).otherwise(e - downstream), F.when(plus, s + downstream).otherwise(e + upstream)
    out = transcripts.filter(F.col("gene_id").isNotNull()).select("chrom", F.greatest(lo, F.lit(0)).alias("start"), hi.alias("end"), F.col("gene_id").alias("id"), "transcript_id")
    first = F.row_number().over(Window.partitionBy("chrom", "start", "end", "id").orderBy("transcript_id"))
    return out.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def gene_matrix(fragments: DataFrame, domains: DataFrame, min_fragments: int = 100, metrics: DataFrame | None = None, query: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``barcode, id, value``: fragments with an insertion in a domain, the largest over the id's domains.

    A fragment that reaches a domain with both ends counts once for it.
    """
    domains = domains.filter(~F.col("chrom").isin(*exclude)) if exclude else domains
    known = fragments.join(F.broadcast(domains.select("chrom").distinct()), "chrom", "left_semi")
    used = known.join(passing_cells(known, metrics, query, min_fragments), "barcode", "left_semi")
    spans = domains.select("chrom", F.col("start").alias("lo"), F.col("end").alias("hi"), "id")
    rows = used.select("barcode", "chrom", "start", "end").withColumn("ends", F.array_distinct(F.array(F.col("start"), F.col("end") - 1)))
    points = rows.select("barcode", "chrom", F.explode("ends").alias("pos"), F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    hits = join_points(points, spans, "pos", "lo", "hi")
    # The second end counts only where the first lies outside of the domain.
    first = (F.col("pos") == F.col("f_start")) | (F.col("f_start") < F.col("lo")) | (F.col("f_start") >= F.col("hi"))
    per = hits.filter(first).groupBy("barcode", "id", "chrom", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("barcode", "id").agg(F.max("n").cast("long").alias("value"))


def model_column(model: str | Callable[[Column], Column] | Callable[[pd.Series], pd.Series]) -> Column:
    """A weight as a function of the column ``_x``.

    A function gets the column, or, wrapped by ``pandas_model``, batches of it; a text may hold numbers, x,
    arithmetic and a few functions, nothing else.
    """
    if callable(model):
        return model(F.col("_x"))
    words = set(re.findall(r"[A-Za-z_]\w*", re.sub(r"\d+(\.\d*)?[eE][+-]?\d+", "", model)))
    if words - {"x", "exp", "abs", "sqrt", "log", "log2", "log10", "np"} or not re.fullmatch(r"[\w\s.+\-*/(),]*", model):
        raise ValueError(f"cannot use gene model {model!r}")
    body = model.replace("np.", "")
    body = re.sub(r"(\w+|\([^()]*\))\s*\*\*\s*(\w+)", r"pow(\1, \2)", body)
    body = re.sub(r"\blog\(", "ln(", body)
    return F.expr(re.sub(r"\bx\b", "_x", body))


def pandas_model(f: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A gene model from a function of pandas series, for what column expressions cannot say."""
    return F.pandas_udf(f, "double")


def gene_score_domains(genes: DataFrame, upstream: int = 5000, downstream: int = 0, use_tss: bool = False, weight_factor: float = 5.0, search: tuple[tuple[int, int], tuple[int, int]] = ((1000, 100000), (1000, 100000)), tile_size: int = 500, boundary: bool = True) -> DataFrame:
    """Genes ``symbol, chrom, lo, hi, strand`` with extended body, weight and search window."""
    (up_min, up_max), (dn_min, dn_max) = search
    plus = F.col("strand") != "-"
    tss = F.when(plus, F.col("lo")).otherwise(F.col("hi"))
    s, e = (tss, tss) if use_tss else (F.col("lo"), F.col("hi"))
    ext_lo, ext_hi = F.when(plus, s - upstream).otherwise(s - downstream), F.when(plus, e + downstream).otherwise(e + upstream)
    g = genes.withColumns({"tss": tss, "g_lo": F.greatest(ext_lo, F.lit(1)).cast("long"), "g_hi": ext_hi.cast("long"), "_m": 1.0 / (e - s + 1)})
    low, high = F.col("_low"), F.col("_high")
    weight = F.lit(float(weight_factor)) if use_tss else F.when(high > low, 1 + F.col("_m") * (weight_factor - 1) / (high - low)).otherwise(1.0)
    g = g.crossJoin(F.broadcast(g.agg(F.min("_m").alias("_low"), F.max("_m").alias("_high"))))  # one row
    g = g.withColumn("gene_weight", weight).drop("_low", "_high")
    w = Window.partitionBy("chrom").orderBy("g_lo", "symbol")
    left_min, left_max = F.when(plus, up_min).otherwise(dn_min), F.when(plus, up_max).otherwise(dn_max)
    right_min, right_max = F.when(plus, dn_min).otherwise(up_min), F.when(plus, dn_max).otherwise(up_max)
    if boundary:
        prev, following = F.lag("g_hi").over(w), F.lead("g_lo").over(w)
        left = F.least(F.greatest(F.coalesce(prev + tile_size, F.lit(1)), F.col("g_lo") - left_max), F.col("g_lo") - left_min)
        right = F.greatest(F.least(F.coalesce(following - tile_size, F.lit(1 << 40)), F.col("g_hi") + right_max), F.col("g_hi") + right_min)
    else:
        left, right = F.col("g_lo") - left_max, F.col("g_hi") + left_max
    return g.withColumns({"s_lo": F.greatest(left, F.lit(1)).cast("long"), "s_hi": right.cast("long")}).drop("_m")


def gene_scores(fragments: DataFrame, domains: DataFrame, tile_size: int = 500, model: str | Callable[[Column], Column] = "exp(-abs(x)/5000) + exp(-1)", ceiling: int = 4, scale_to: float = 10000.0, cells: DataFrame | None = None) -> DataFrame:
    """``barcode, symbol, value``: tile counts weighted by distance, each cell scaled to the same sum."""
    used = fragments if cells is None else fragments.join(cells.select("barcode").distinct(), "barcode", "left_semi")
    ends = used.select("barcode", "chrom", F.explode(F.array("start", "end")).alias("pos"))
    counts = ends.groupBy("barcode", "chrom", (F.floor(F.col("pos") / tile_size) * tile_size).alias("t_start")).agg(F.least(F.count(F.lit(1)), F.lit(ceiling)).alias("n"))
    occupied = counts.select("chrom", "t_start").distinct()
    spans = domains.select("chrom", "symbol", "tss", "g_lo", "g_hi", "strand", "gene_weight", (F.col("s_lo") - tile_size + 1).alias("lo"), (F.col("s_hi") + 1).alias("hi"))
    pairs = join_points(occupied, spans, "t_start", "lo", "hi", width=32768)
    gap = F.greatest(F.col("g_lo") - (F.col("t_start") + tile_size - 1) - 1, F.col("t_start") - F.col("g_hi") - 1, F.lit(0))
    sign = F.signum(F.col("t_start") - F.col("tss")) * F.when(F.col("strand") == "-", -1).otherwise(1)
    weighted = pairs.withColumn("_x", (gap * sign).cast("double")).withColumn("weight", model_column(model) * F.col("gene_weight"))
    raw = counts.join(weighted.select("chrom", "t_start", "symbol", "weight"), ["chrom", "t_start"]).groupBy("barcode", "symbol").agg(F.sum(F.col("n") * F.col("weight")).alias("raw"))
    raw = stored(raw, tasks=tasks_of(fragments.sparkSession, fragments.count()))
    total = F.sum("raw").over(Window.partitionBy("barcode"))
    return raw.withColumn("value", F.round(F.col("raw") * scale_to / total, 3)).filter("value <> 0").select("barcode", "symbol", "value")


def feature_counts(x: DataFrame) -> DataFrame:
    return x.groupBy("feature").agg(F.sum("value").cast("long").alias("accessibility_count"))


def select_features(x: DataFrame, n_features: int = 500000, lower: float = 0.005, upper: float = 0.005, binary: bool = False) -> DataFrame:
    """``feature, accessibility_count, selected``: the most accessible, for counts without both extremes.

    Ties are broken by the feature's name; if nothing is left or asked for, nothing is selected.
    """
    counts = feature_counts(x)
    if binary:
        top = along(counts, [F.desc("accessibility_count"), "feature"], number="_rank")
        return top.withColumn("selected", F.col("_rank") <= n_features).drop("_rank")
    ranked = along(counts, ["accessibility_count", F.desc("feature")], number="_rank")
    # Features without counts come first, and are not ranked.
    sizes = counts.agg(F.count_if(F.expr("accessibility_count > 0")).alias("_n"), F.count_if(F.expr("accessibility_count <= 0")).alias("_none"))
    ranked = ranked.crossJoin(F.broadcast(sizes)).withColumn("_rank", F.col("_rank") - F.col("_none"))  # one row
    cut_low, cut_high = F.floor(F.lit(lower) * F.col("_n")), F.col("_n") - F.floor(F.lit(upper) * F.col("_n"))
    chosen = (F.col("_rank") > F.greatest(cut_low, cut_high - n_features)) & (F.col("_rank") <= cut_high) & (F.col("_rank") > 0)
    return ranked.select("feature", "accessibility_count", chosen.alias("selected"))


def select_features_multi(parts: list[DataFrame], n_features: int = 500000, lower: float = 0.005, upper: float = 0.005, binarize: bool = True) -> DataFrame:
    """Several matrices on the features chosen over all of them; repeated barcodes get the suffixes -1, -2."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    chosen = select_features(every, n_features, lower, upper).filter("selected").select("feature")
    again = every.select("cell", "_part").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("cell").orderBy("_part")) - 1)
    out = every.join(chosen, "feature", "left_semi").join(again, ["cell", "_part"])
    cell = F.when(F.col("_k") > 0, F.concat("cell", F.lit("-"), F.col("_k").cast("string"))).otherwise(F.col("cell"))
    return out.select(cell.alias("cell"), "feature", (F.lit(1).cast("long") if binarize else F.col("value")).alias("value"))


def combine(parts: dict[str, DataFrame]) -> DataFrame:
    """Row union of matrices over the same features, with ``source_file``; ValueError on clashes."""
    from functools import reduce

    frames = [p.withColumn("source_file", F.lit(name)) for name, p in parts.items()]
    every = reduce(DataFrame.unionByName, frames)
    clash = every.select("cell", "source_file").distinct().groupBy("cell").count().filter("count > 1")
    if not clash.isEmpty():
        raise ValueError("a barcode occurs in several inputs")
    return every


def unique_names(genes: DataFrame, name: str = "symbol", key: str = "gene_id") -> DataFrame:
    """Names that several rows share get their key appended."""
    n = F.count(F.lit(1)).over(Window.partitionBy(name))
    return genes.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit("_"), F.col(key).cast("string"))).otherwise(F.col(name)))

