"""Marker features of groups of cells by a binomial test on equal samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


#: Parts in which the first cells of a side are found before they are compared.
PARTS = 256


def sample_cells(cells: DataFrame, group: str, max_cells: int = 500, seed: int = 42) -> DataFrame:
    """``cell, side``: equally many cells of the group and of the rest, in the order of a seeded hash.

    The first ``max_cells`` of a side are among the first of its parts, so no task sorts all cells.
    """
    told = F.md5(F.concat("cell", F.lit(f":{seed}")))
    sided = cells.select("cell", F.when(F.col("group") == group, "fg").otherwise("bg").alias("side"), told.alias("_told"))
    sizes = sided.groupBy("side").count().agg(F.min("count").alias("n"), F.count(F.lit(1)).alias("sides"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_told", "cell"))
    parts = sided.withColumn("_part", F.pmod(F.xxhash64("cell"), F.lit(PARTS))).withColumn("_k", first("side", "_part")).filter(F.col("_k") <= max_cells)
    picked = parts.withColumn("_k", first("side")).crossJoin(F.broadcast(sizes))
    return picked.filter((F.col("_k") <= F.least(F.col("n"), F.lit(max_cells))) & (F.col("sides") == 2)).select("cell", "side")


def binomial_test(counts: DataFrame) -> DataFrame:
    """``counts`` (feature, fg, bg, n_fg, n_bg) with ``log2_fc`` and the two-sided ``p_value``."""
    n_fg, n_bg = F.col("n_fg"), F.col("n_bg")
    up = F.col("fg") / n_fg >= F.col("bg") / n_bg
    hit = lambda k, n, other, m: 2 * stats.binomial_upper(k, n, F.greatest(other, F.lit(1)) / m)
    p = F.when(up, hit(F.col("fg"), n_fg, F.col("bg"), n_bg)).otherwise(hit(F.col("bg"), n_bg, F.col("fg"), n_fg))
    return counts.withColumn("log2_fc", F.log2((F.col("fg") + 1) / (F.col("bg") + 1))).withColumn("p_value", F.greatest(F.lit(stats.TINY), F.least(F.lit(1.0), p)))


def marker_test(x: DataFrame, cells: DataFrame, group: str, *, max_cells: int = 500, seed: int = 42) -> DataFrame:
    """All features with counts of cells that have them on both sides, fold change, p and adjusted p."""
    sample = sample_cells(cells, group, max_cells, seed)
    sizes = sample.agg(F.sum(F.when(F.col("side") == "fg", 1).otherwise(0)).alias("n_fg"), F.sum(F.when(F.col("side") == "bg", 1).otherwise(0)).alias("n_bg"))
    seen = x.filter("value > 0").select("cell", "feature").distinct().join(sample, "cell")
    counts = seen.groupBy("feature").agg(F.sum(F.when(F.col("side") == "fg", 1).otherwise(0)).alias("fg"), F.sum(F.when(F.col("side") == "bg", 1).otherwise(0)).alias("bg"))
    counts = x.select("feature").distinct().join(counts, "feature", "left").fillna(0, ["fg", "bg"]).crossJoin(F.broadcast(sizes))
    return stats.benjamini_hochberg(binomial_test(counts), "p_value", "fdr", tie=("feature",)).withColumn("group", F.lit(group))


def marker_peaks(x: DataFrame, cells: DataFrame, groups: list[str], *, min_pct: float = 0.05, min_log2_fc: float = 1.0, max_cells: int = 500, seed: int = 42) -> DataFrame:
    """Tests of several groups, filtered by frequency and fold change after adjustment."""
    out = None
    for g in groups:
        one = marker_test(x, cells, g, max_cells=max_cells, seed=seed)
        out = one if out is None else out.unionByName(one)
    frequent = (F.col("fg") / F.col("n_fg") >= min_pct) | (F.col("bg") / F.col("n_bg") >= min_pct)
    return out.filter(frequent & (F.abs("log2_fc") >= min_log2_fc))


def top_markers(markers: DataFrame, fdr: float = 0.05, log2_fc: float = 0.0, n: int = 10) -> DataFrame:
    """The first ``n`` of each group by fdr, then by absolute fold change."""
    good = markers.filter((F.col("fdr") < fdr) & (F.col("log2_fc") > log2_fc))
    rank = F.row_number().over(Window.partitionBy("group").orderBy("fdr", F.desc(F.abs("log2_fc")), "feature"))
    return good.withColumn("rank", rank).filter(F.col("rank") <= n)
