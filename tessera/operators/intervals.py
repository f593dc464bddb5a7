"""Interval joins on hash keys, unions of intervals and coverage sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding


def bin_of(pos: Column, width: int) -> Column:
    return F.floor(pos / width).cast("long")


def join_points(points: DataFrame, intervals: DataFrame, pos: str, start: str, end: str, *, on: str = "chrom", width: int = 4096, broadcast: bool = False) -> DataFrame:
    """Pairs with ``start <= pos < end``: an equi-join on ``(on, bin)`` with the range as the rest.

    Each interval is listed in the bins that it touches, each point has one bin, so no pair repeats.
    """
    listed = intervals.filter(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start), width), bin_of(F.col(end) - 1, width))))
    keyed = points.withColumn("_bin", bin_of(F.col(pos), width))
    side = F.broadcast(listed) if broadcast else listed
    return keyed.join(side, [on, "_bin"]).filter((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))).drop("_bin")


def join_overlaps(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, *, on: str = "chrom", width: int = 4096) -> DataFrame:
    """Pairs of closed intervals that share a position; a pair is kept in the first bin that both touch."""
    bins = lambda s, e: F.sequence(bin_of(F.col(s), width), bin_of(F.col(e), width))
    a = left.filter(F.col(le) >= F.col(ls)).withColumn("_first", bin_of(F.col(ls), width)).withColumn("_bin", F.explode(bins(ls, le)))
    b = right.filter(F.col(re) >= F.col(rs)).withColumn("_other", bin_of(F.col(rs), width)).withColumn("_bin", F.explode(bins(rs, re)))
    meet = (F.col(ls) <= F.col(re)) & (F.col(le) >= F.col(rs)) & (F.col("_bin") == F.greatest("_first", "_other"))
    return a.join(b, [on, "_bin"]).filter(meet).drop("_bin", "_first", "_other")


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(UNBOUNDED, -1))
    opened = df.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(UNBOUNDED, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def union_intervals(df: DataFrame, keys: tuple[str, ...] = ("chrom",), block: int = 1 << 20) -> DataFrame:
    """Disjoint intervals that cover the same; touching ones merge.

    A first pass merges within blocks of the axis, so that the pass over whole keys, of which there
    may be few, gets islands and not rows.
    """
    local = _merge(df.withColumn("_block", F.floor(F.col("start") / block)), [*keys, "_block"]).drop("_block")
    return _merge(local, list(keys))


def coverage(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Runs ``keys, start, end, depth`` of equal coverage by half-open intervals."""
    events = df.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    at = events.groupBy(*keys, F.col("e.pos").alias("start")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("start")
    return at.withColumn("depth", F.sum("d").over(w.rowsBetween(UNBOUNDED, 0))).withColumn("end", F.lead("start").over(w)).filter("end is not null").select(*keys, "start", "end", "depth")


def deep_segments(df: DataFrame, keys: tuple[str, ...], least: int) -> DataFrame:
    """Maximal segments of coverage ``least`` or more, with the depth at their start and the largest."""
    runs = coverage(df, keys).filter(F.col("depth") >= least)
    w = Window.partitionBy(*keys).orderBy("start")
    marked = runs.withColumn("_new", F.when(F.lag("end").over(w) == F.col("start"), 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(UNBOUNDED, 0)))
    return island.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("depth", "start").alias("min_overlap"), F.max("depth").alias("max_overlap")
    ).drop("_island")
