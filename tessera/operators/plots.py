"""The numbers behind the plots: histograms and the best of each group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fragment_sizes(fragments: DataFrame, max_size: int = 1000, bins: int = 200) -> DataFrame:
    """``bin, start, n`` of fragment lengths below ``max_size``."""
    size = F.col("end") - F.col("start")
    width = max_size / bins
    b = F.least(F.floor(size / width), F.lit(bins - 1)).cast("long")
    return fragments.filter((size < max_size) & (size >= 0)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.col("bin") * width)


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n`` of the values from ``low`` to ``high``, which belongs to the last bin."""
    inside = df.withColumn("_v", value).filter(F.col("_v").between(low, high))
    at = F.least(F.floor((F.col("_v") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def hexagons(df: DataFrame, x: Column, y: Column, gridsize: int = 100) -> DataFrame:
    """``q, r, x, y, n``: hexagons that hold points, by axial coordinates, with their centres.

    ``gridsize`` hexagons span the extent of ``x``, and so many rows that of ``y`` that they are regular
    in a square. A point belongs to the hexagon that the rounding of cube coordinates gives: each is
    rounded, and the one rounded furthest follows from the others.
    """
    points = df.select(x.cast("double").alias("_x"), y.cast("double").alias("_y")).filter("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)")
    ends = points.agg(*[f(c).alias(f"{n}{c}") for c in ("_x", "_y") for n, f in (("lo", F.min), ("hi", F.max))])
    rows = max(1, int(gridsize / math.sqrt(3)))
    unit = lambda c, n: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), (F.col(f"hi{c}") - F.col(f"lo{c}")) / n).otherwise(1.0)
    # In units of a hexagon's width and of the distance of two rows, which is half of a period.
    placed = points.crossJoin(F.broadcast(ends)).withColumns({"_u": (F.col("_x") - F.col("lo_x")) / unit("_x", gridsize), "_v": (F.col("_y") - F.col("lo_y")) / unit("_y", 2 * rows)})
    a, b = F.col("_u") - F.col("_v") / 2, F.col("_v")
    placed = placed.withColumns({"_a": a, "_b": b, "_c": -a - b})
    near = {c: F.floor(F.col(f"_{c}") + 0.5) for c in "abc"}
    off = {c: F.abs(near[c] - F.col(f"_{c}")) for c in "abc"}
    q = F.when((off["a"] > off["b"]) & (off["a"] > off["c"]), -near["b"] - near["c"]).otherwise(near["a"])
    r = F.when((off["a"] > off["b"]) & (off["a"] > off["c"]), near["b"]).when(off["b"] > off["c"], -near["a"] - near["c"]).otherwise(near["b"])
    at_x, at_y = F.col("lo_x") + (F.col("q") + F.col("r") / 2) * unit("_x", gridsize), F.col("lo_y") + F.col("r") * unit("_y", 2 * rows)
    counted = placed.withColumns({"q": q.cast("long"), "r": r.cast("long")}).groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"), F.first(at_x).alias("x"), F.first(at_y).alias("y"))
    return counted.select("q", "r", "x", "y", "n")


def qc_hexagons(metrics: DataFrame, gridsize: int = 100) -> DataFrame:
    """Hexagonal density of cells over ``log10(n_unique + 1)`` and ``tsse_score``."""
    return hexagons(metrics, F.log10(F.col("n_unique") + 1), F.col("tsse_score"), gridsize)


def qc_grid(metrics: DataFrame, bins: int = 50) -> DataFrame:
    """Counts of cells over ``log10(n_unique + 1)`` and ``tsse_score``, in tenths and whole numbers."""
    x, y = F.floor(F.log10(F.col("n_unique") + 1) * 10).cast("long"), F.floor("tsse_score").cast("long")
    return metrics.groupBy(x.alias("x"), F.least(y, F.lit(bins)).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def top_motifs(results: DataFrame, n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("group").orderBy("fdr", F.desc("log2_fc"), "motif"))
    return results.withColumn("rank", rank).filter(F.col("rank") <= n)
