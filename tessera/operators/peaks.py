"""Peak calling on runs of equal pileup, merging of peaks and cell-by-peak counts.

Work is on run-length intervals and never on single bases, so the size of a key is its number of
insertions, not the length of its chromosome.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.ranks import over_ranges
from ..session import stored
from .intervals import UNBOUNDED, join_points

PEAK_KEYS = ("group", "chrom")


def pileup(fragments: DataFrame, d_treat: int = 200, d_ctrl: int = 10000) -> DataFrame:
    """Runs ``group, chrom, start, end, treat, ctrl`` of windows around both ends of each fragment."""
    last = fragments.groupBy(*PEAK_KEYS).agg((F.max("end") - 1).alias("last"))
    # Equal ends are counted before they meet their neighbours; groups and chromosomes are few.
    ends = fragments.select(*PEAK_KEYS, F.explode(F.array("start", "end")).alias("p")).groupBy(*PEAK_KEYS, "p").agg(F.count(F.lit(1)).alias("k"))
    ends = ends.join(last, list(PEAK_KEYS))
    clip = lambda c: F.greatest(F.lit(0), F.least(c, F.col("last")))
    event = lambda off, t, c: F.struct(clip(F.col("p") + off).alias("pos"), (t * F.col("k")).alias("t"), (c * F.col("k")).alias("c"))
    a, b = d_treat // 2, d_ctrl // 2
    events = ends.select(*PEAK_KEYS, F.explode(F.array(event(-a, 1, 0), event(a, -1, 0), event(-b, 0, 1), event(b, 0, -1))).alias("e"))
    at = events.groupBy(*PEAK_KEYS, F.col("e.pos").alias("start")).agg(F.sum("e.t").alias("t"), F.sum("e.c").alias("c"))
    runs = over_ranges(at, PEAK_KEYS, "start", sums={"treat": "t", "ctrl": "c"}, after={"end": "start"})
    return runs.filter("end is not null").select(*PEAK_KEYS, "start", "end", "treat", "ctrl")


def score_runs(runs: DataFrame, fragments: DataFrame, genome_length: float, d_treat: int = 200, d_ctrl: int = 10000) -> DataFrame:
    """Runs with the local rate ``lam`` and ``p_score``, minus log10 of the Poisson tail.

    A tail costs the same whatever its rate, so runs keep their place and are not joined with distinct pairs.
    """
    reads = fragments.groupBy("group").agg(F.count(F.lit(1)).alias("reads"))
    lam = F.greatest(F.col("ctrl") * (d_treat / d_ctrl), 2.0 * d_treat * F.col("reads") / F.lit(float(genome_length)))
    rated = runs.join(F.broadcast(reads), "group").withColumn("lam", lam).drop("reads")
    return rated.withColumn("p_score", -F.log10(F.greatest(stats.poisson_upper(F.col("treat"), F.col("lam")), F.lit(stats.TINY))))


def q_table(scored: DataFrame) -> DataFrame:
    """``group, p_score, q_score``: Benjamini-Hochberg over bases, in minus log10, weighted by run length."""
    by_p = scored.groupBy("group", "p_score").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    down = Window.partitionBy("group").orderBy(F.desc("p_score"))
    better = F.coalesce(F.sum("bases").over(down.rowsBetween(UNBOUNDED, -1)), F.lit(0))
    total = F.sum("bases").over(Window.partitionBy("group"))
    raw = by_p.withColumn("raw", F.col("p_score") + F.log10(1.0 + better) - F.log10(total.cast("double")))
    return raw.withColumn("q_score", F.greatest(F.lit(0.0), F.min("raw").over(down.rowsBetween(UNBOUNDED, 0)))).select("group", "p_score", "q_score")


def islands(scored: DataFrame, q_thresh: float = 0.05, max_gap: int = 30, peak_amp: int = 200) -> DataFrame:
    """Significant runs with the island they belong to; islands shorter than ``peak_amp`` are dropped."""
    good = scored.filter(F.col("q_score") >= -F.log10(F.lit(q_thresh)))
    near = over_ranges(good, PEAK_KEYS, "start", before={"_before": "end"})
    apart = F.col("_before").isNull() | (F.col("start") - (F.col("_before") - 1) >= max_gap)
    marked = over_ranges(near.withColumn("_new", F.when(apart, 1).otherwise(0)).drop("_before"), PEAK_KEYS, "start", sums={"island": "_new"})
    own = Window.partitionBy(*PEAK_KEYS, "island")
    marked = marked.withColumns({"i_start": F.min("start").over(own), "i_end": F.max("end").over(own) - 1})
    return marked.filter(F.col("i_end") - F.col("i_start") >= peak_amp - 1).drop("_new")


def call_peaks(fragments: DataFrame, genome_length: float, *, q_thresh: float = 0.05, d_treat: int = 200, d_ctrl: int = 10000, max_gap: int = 30, peak_amp: int = 200, fe_cutoff: float = 1.0) -> DataFrame:
    """Peaks of ``fragments`` (group, chrom, start, end) in the ten narrow-peak columns and ``group``."""
    scored = stored(score_runs(pileup(fragments, d_treat, d_ctrl), fragments, genome_length, d_treat, d_ctrl))
    scored = scored.join(q_table(scored), ["group", "p_score"])
    best = F.struct((-F.col("p_score")).alias("k"), "start")
    peaks = islands(scored, q_thresh, max_gap, peak_amp).groupBy(*PEAK_KEYS, "island", "i_start", "i_end").agg(
        F.min_by(F.struct("start", "treat", "lam", "p_score", "q_score"), best).alias("s")
    )
    signal = (F.col("s.treat") + 1.0) / (F.col("s.lam") + 1.0)
    name = F.concat_ws("_", F.col("group").cast("string"), "chrom", F.col("i_start").cast("string"))
    return peaks.select(
        "group", "chrom", F.col("i_start").alias("start"), F.col("i_end").alias("end"), name.alias("name"),
        F.least(F.floor(F.col("s.q_score") * 10), F.lit(1000)).cast("int").alias("score"), F.lit(".").alias("strand"), signal.alias("signal_value"),
        F.col("s.p_score").alias("p_value"), F.col("s.q_score").alias("q_value"), (F.col("s.start") - F.col("i_start")).alias("peak"),
    ).filter(F.col("signal_value") >= fe_cutoff)


def group_fragments(fragments: DataFrame, groups: DataFrame) -> DataFrame:
    """``group, chrom, start, end`` of the fragments (barcode, chrom, start, end) of grouped cells.

    ``groups`` has (barcode, group). Where both have ``source_file``, cells are told by it as well, as
    barcodes of several samples may be equal.
    """
    keys = ["source_file", "barcode"] if "source_file" in groups.columns and "source_file" in fragments.columns else ["barcode"]
    return fragments.join(groups.select(*keys, "group").distinct(), keys).select("group", "chrom", "start", "end")


def read_grouped(spark: SparkSession, path: str, groups: DataFrame, suffixes: tuple[str, str] = ("_tile", ".parquet")) -> DataFrame:
    """Fragments of grouped cells of one Parquet file, or of a folder of samples.

    In a folder each sample's fragments are ``<sample>.parquet``; ``source_file`` of the groups names the
    sample's matrix, ``<sample>_tile`` with any ending, or the sample.
    """
    from ..sources.formats import COLUMNS, read_fragments

    if "source_file" not in groups.columns:
        return group_fragments(read_fragments(spark, path), groups)
    sample = F.regexp_replace(F.regexp_replace("source_file", r"\.[A-Za-z0-9]+$", ""), f"{re.escape(suffixes[0])}$", "")
    named = groups.select(sample.alias("source_file"), "barcode", "group")
    names = [r[0] for r in named.select("source_file").distinct().orderBy("source_file").collect()]
    parts = [read_fragments(spark, f"{path.rstrip('/')}/{n}{suffixes[1]}").select(*COLUMNS, F.lit(n).alias("source_file")) for n in names]
    if not parts:
        raise ValueError("there are no groups")
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return group_fragments(every, named)


#: Positions in a range of the choice among overlapping windows.
RANGE = 1 << 16
OWN, GUEST, KEPT = 0, 1, 2


def _choice(starts: list[int], ends: list[int], order: list[int], kinds: list[int]) -> list[bool | None]:
    """For windows in ``order``, best first: kept, dropped, or None where that depends on what others decide.

    A guest is decided elsewhere, so neither it nor a worse window that overlaps it is decided here.
    """
    out: list[bool | None] = [None] * len(starts)
    kept = sorted((starts[i], ends[i]) for i in range(len(starts)) if kinds[i] == KEPT)
    at_kept, to_kept = [s for s, _ in kept], [e for _, e in kept]
    open_: list[tuple[int, int]] = []
    widest = max((b - a for a, b in zip(starts, ends, strict=True)), default=0)
    for i in order:
        if kinds[i] == KEPT:
            continue
        a, b = starts[i], ends[i]
        # Kept windows don't overlap, so only the neighbours of a new one can overlap it.
        at = bisect.bisect_right(at_kept, a)
        if (at and to_kept[at - 1] > a) or (at < len(at_kept) and at_kept[at] < b):
            out[i] = False
            continue
        j = bisect.bisect_left(open_, (b, 0)) - 1
        while j >= 0 and open_[j][0] > a - widest and open_[j][1] <= a:
            j -= 1
        if kinds[i] == GUEST or (j >= 0 and open_[j][0] > a - widest):
            bisect.insort(open_, (a, b))
            continue
        out[i] = True
        at_kept.insert(at, a)
        to_kept.insert(at, b)
    return out


def _choose(group: pa.Table) -> pa.Table:
    starts, ends, p = (group[c].to_numpy() for c in ("start", "end", "p_value"))
    kinds = group["kind"].to_pylist()
    found = _choice(starts.tolist(), ends.tolist(), np.lexsort((ends, starts, -p)).tolist(), kinds)
    mine = np.array([k == OWN and f is not False for k, f in zip(kinds, found, strict=True)], bool)
    taken = pa.array([bool(f) for f, m in zip(found, mine, strict=True) if m], pa.bool_())
    rows = group.select(["chrom", "start", "end", "p_value"]).filter(pa.array(mine))
    return rows.append_column("taken", taken)


def best_apart(windows: DataFrame, size: int | None = None) -> DataFrame:
    """Of distinct windows (chrom, start, end, p_value) those that a greedy choice keeps: best first, ties leftmost.

    A range of the axis is decided as far as its own windows and guests from beside it allow. What
    depends on windows elsewhere waits for the next round, whose ranges are moved by half; the best
    window left is decided in each. Whatever the islands, a task holds one range.
    """
    windows = stored(windows)
    widest = windows.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1
    size = max(size or RANGE, 4 * widest)
    waiting, last, kept, turn = windows, None, [], 0
    while True:
        every = waiting.withColumn("kind", F.lit(OWN))
        if last is not None:
            every = every.unionByName(last.withColumn("kind", F.lit(KEPT)))
        at = F.col("start") + (size // 2 if turn % 2 else 0)
        beside = F.array_distinct(F.array(F.floor(at / size), F.floor((at - widest) / size), F.floor((at + widest) / size)))
        dealt = every.withColumn("_own", F.floor(at / size)).withColumn("range", F.explode(beside))
        dealt = dealt.withColumn("kind", F.when((F.col("kind") == OWN) & (F.col("range") != F.col("_own")), F.lit(GUEST)).otherwise(F.col("kind"))).drop("_own")
        out = stored(dealt.groupBy("chrom", "range").applyInArrow(_choose, "chrom string, start long, end long, p_value double, taken boolean"))
        last, waiting, turn = out.filter("taken").drop("taken"), stored(out.filter("not taken").drop("taken")), turn + 1
        kept.append(last)
        if waiting.isEmpty():
            break
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    return every


def merge_peaks(peaks: DataFrame, chrom_sizes: DataFrame, half_width: int = 250) -> DataFrame:
    """Fixed-width peaks around the summits of all groups that don't overlap, best first, clipped to chromosomes."""
    summit = F.col("start") + F.col("peak")
    wide = peaks.join(F.broadcast(chrom_sizes.select("chrom", "size")), "chrom").select(
        "chrom", F.greatest(summit - half_width, F.lit(0)).cast("long").alias("start"), F.least(summit + half_width + 1, F.col("size")).cast("long").alias("end"), "p_value"
    )
    wide = wide.groupBy("chrom", "start", "end").agg(F.max("p_value").cast("double").alias("p_value"))
    return best_apart(wide.filter(F.col("end") > F.col("start"))).orderBy(F.desc("p_value"), "chrom", "start")


def peak_matrix(fragments: DataFrame, peaks: DataFrame, strategy: str = "paired-insertion") -> DataFrame:
    """``barcode, chrom, start, end, value``: paired-insertion (a fragment once per peak), insertion or fragment."""
    spans = peaks.select("chrom", F.col("start").alias("lo"), F.col("end").alias("hi")).distinct()
    ends = F.array("start", F.col("end") - 1)
    rows = fragments.select("barcode", "chrom", F.col("start").alias("fs"), F.col("end").alias("fe"), "start", "end")
    if strategy == "fragment":
        # Anchored at the later of both starts, which lies in either interval if they overlap.
        longest = peaks.agg(F.max(F.col("end") - F.col("start")).alias("_longest"))
        reach = rows.crossJoin(F.broadcast(longest)).withColumn("_lo", F.col("fs") - F.col("_longest")).withColumn("_hi", F.col("fe"))
        pairs = join_points(spans.withColumn("pos", F.col("lo")), reach, "pos", "_lo", "_hi").filter((F.col("fs") < F.col("hi")) & (F.col("fe") > F.col("lo")))
    elif strategy in ("insertion", "paired-insertion"):
        points = rows.withColumn("pos", F.explode(ends if strategy == "insertion" else F.array_distinct(ends)))
        pairs = join_points(points, spans, "pos", "lo", "hi")
        if strategy == "paired-insertion":
            pairs = pairs.filter((F.col("pos") == F.col("fs")) | (F.col("fs") < F.col("lo")) | (F.col("fs") >= F.col("hi")))
    else:
        raise ValueError(f"unknown counting strategy {strategy!r}")
    return pairs.groupBy("barcode", "chrom", F.col("lo").alias("start"), F.col("hi").alias("end")).agg(F.count(F.lit(1)).alias("value"))
