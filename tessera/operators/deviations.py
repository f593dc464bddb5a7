"""Accessibility deviations of motifs per cell against matched background features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import along
from ..session import stored, tasks_of
from . import motifs


#: Entries of a band of features, cells and sets of a block; pairs that a task sums at once.
ENTRIES, CELLS, SETS, PAIRS = 1 << 16, 4096, 1024, 1 << 20
#: Rows that a task hands on at once, and sequences that it is handed at once.
ROWS, SEQUENCES = 1 << 14, 512


class _Sums:
    """What each cell of a block has in each of its sets, summed band by band; row 0 is all cells as one."""

    def __init__(self, n_rows: int, n_sets: int, entries: int, pairs: int) -> None:
        self.n_sets, self.entries, self.pairs = n_sets, entries, pairs
        self.total = np.zeros(n_rows * n_sets)
        self.begin()

    def begin(self) -> None:
        """A new band, whose cells come before its sets."""
        self.cells: list[pa.RecordBatch] = []
        self.sets: list[pa.RecordBatch] = []
        self.waiting, self.features = 0, None

    def add(self, piece: pa.RecordBatch, is_set: bool) -> None:
        (self.sets if is_set else self.cells).append(piece)
        self.waiting += is_set * len(piece)
        if self.waiting >= self.entries:
            self.meet()

    def meet(self) -> None:
        """Each entry of the sets that wait meets the cells of its feature, some pairs at a time."""
        if self.sets and self.cells:
            if self.features is None:
                cells = pa.Table.from_batches(self.cells)
                coded = cells["feature"].combine_chunks().dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                self.features, self.count = coded.dictionary, np.bincount(code, minlength=len(coded.dictionary))
                self.first = np.cumsum(self.count) - self.count
                self.row = cells["at"].combine_chunks().flatten().to_numpy()[order].astype(np.int64) * self.n_sets
                self.value = cells["v"].to_numpy()[order]
            sets = pa.Table.from_batches(self.sets)
            at = sets["at"].combine_chunks()
            code = np.repeat(pc.index_in(sets["feature"].combine_chunks(), value_set=self.features).fill_null(-1).to_numpy(), np.asarray(at.value_lengths()))
            known = code >= 0
            code, s = code[known], at.flatten().to_numpy()[known]
            width, first = self.count[code], self.first[code]
            upto = np.cumsum(width)
            a = 0
            while a < len(code):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + self.pairs)))
                n = width[a:b]
                e = np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                to = self.row[e] + np.repeat(s[a:b], n)
                if len(to) < len(self.total):
                    np.add.at(self.total, to, self.value[e])
                else:
                    self.total += np.bincount(to, self.value[e], len(self.total))
                a = b
        self.sets, self.waiting = [], 0


def _summed(n_cells: int, n_sets: int, bands: int, cells: int, sets: int, entries: int, pairs: int):
    """Sorted rows (key, feature, at, v) of cells and sets to a row for each cell and set of their blocks: ``c, s, n, want``."""
    wide = -(-n_sets // sets)

    def rows(pair: int, total: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        of, to = divmod(pair, wide)
        table = total.reshape(-1, n)
        step = max(1, ROWS // n)
        for a in range(1, len(table), step):
            some = table[a : a + step]
            c, s = np.repeat(of * cells + a - 1 + np.arange(len(some)), n), np.tile(to * sets + np.arange(n, dtype=np.int32), len(some))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(s), pa.array(some.ravel()), pa.array(np.tile(table[0], len(some)))], ["c", "s", "n", "want"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = -1, None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                if a == b:
                    continue
                band, is_set = divmod(int(keys[a]), 2)
                pair = band // bands
                if band != at:
                    if sums is not None:
                        sums.meet()
                        if pair != at // bands:
                            yield from rows(at // bands, sums.total, sums.n_sets)
                            sums = None
                    if sums is None:
                        of, to = divmod(pair, wide)
                        sums = _Sums(1 + min(cells, n_cells - of * cells), min(sets, n_sets - to * sets), entries, pairs)
                    sums.begin()
                    at = band
                piece = batch.slice(a, b - a)
                sums.add(piece.filter(pc.is_valid(piece.column("feature"))), bool(is_set))
        if sums is not None:
            sums.meet()
            yield from rows(at // bands, sums.total, sums.n_sets)

    return run


def compute_deviations(x: DataFrame, motif_features: DataFrame, background: DataFrame) -> DataFrame:
    """``cell, motif, deviation, z``; x (cell, feature, value), motif_features (motif, feature), background (feature, iteration, background).

    A deviation is (observed - expected) / expected, and -1 for a set of which a cell has nothing; z
    compares with the deviations of the background sets, by their mean and population deviation.
    Blocks of cells meet blocks of sets (a motif's own features, or those drawn for it in one iteration)
    in bands of features, which stream through a task: it holds the cells' entries of one band and a sum for
    each cell and set, however many features either has. The bands of a block are shared among tasks
    as long as their sums are fewer than the entries.
    """
    spark = x.sparkSession
    depths = x.groupBy("cell").agg(F.sum("value").alias("depth"), F.count_if(F.col("value") != 0).alias("size")).filter("depth > 0")
    cells = stored(along(depths, ["cell"], number="c").select("cell", F.col("depth").cast("double").alias("depth"), "size", (F.col("c") - 1).alias("c"), F.floor((F.col("c") - 1) / CELLS).alias("of")))
    totals = x.groupBy("feature").agg(F.sum("value").cast("double").alias("v"))
    # Motifs and iterations are few; their numbers give that of a set.
    nth = lambda df, name, to: F.broadcast(df.select(name).distinct().withColumn(to, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(name))))
    listed = motif_features.select("motif", "feature").join(nth(motif_features, "motif", "m"), "motif").groupBy("feature").agg(F.collect_list("m").alias("ms"))
    drawn = background.select("feature", "iteration", "background").join(nth(background, "iteration", "t"), "iteration").join(listed, "feature")
    # A feature drawn several times for one set counts each time.
    entries = stored(listed.select("feature", F.lit(0).alias("t"), "ms").unionByName(drawn.select(F.col("background").alias("feature"), "t", "ms")))
    sets = stored(entries.select("t", F.explode("ms").alias("m")).groupBy("m", "t").agg(F.count(F.lit(1)).alias("size")).join(nth(motif_features, "motif", "m"), "m"))
    n_cells, n_features, n_all = cells.count(), totals.count(), totals.agg(F.sum("v")).first()[0] or 0.0
    most = sets.agg(F.max("m"), F.max("t"), F.sum("size")).first()
    times = (most[1] or 0) + 1
    n_sets, n_entries = (most[0] or 0) * times, most[2] or 0
    if not n_cells or not n_sets:
        kinds = {"cell": dict(x.dtypes)["cell"], "motif": dict(motif_features.dtypes)["motif"]}
        return spark.createDataFrame([], f"cell {kinds['cell']}, motif {kinds['motif']}, deviation double, z double")
    high, wide = -(-n_cells // CELLS), -(-n_sets // SETS)
    largest, n_values = cells.groupBy("of").agg(F.sum("size").alias("n")).agg(F.max("n"), F.sum("n")).first()
    bands = max(1, -(-max(largest + n_features, n_entries // wide) // ENTRIES))
    moved = (n_values + n_features * high) * wide + n_entries * high
    shares = min(bands, max(1, moved // (n_cells * n_sets)))
    # Every block of cells meets every block of sets: their numbers, not rows, are multiplied.
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = lambda of, to, at, v: [of.cast("long").alias("of"), to.cast("long").alias("to"), "feature", at.cast("array<int>").alias("at"), v.cast("double").alias("v")]
    of_cells = x.filter("value <> 0").join(cells.select("cell", "c", "of"), "cell").withColumn("to", each(wide)).select(*row(F.col("of"), F.col("to"), F.array(F.col("c") % CELLS + 1), F.col("value")))
    of_all = totals.withColumn("of", each(high)).withColumn("to", each(wide)).select(*row(F.col("of"), F.col("to"), F.array(F.lit(0)), F.col("v")))
    # A block without any entry has its cells and sets too.
    of_none = spark.range(high * wide).withColumn("feature", F.lit(None).cast(dict(x.dtypes)["feature"])).select(*row(F.floor(F.col("id") / wide), F.col("id") % wide, F.array(), F.lit(0.0)))
    at = entries.select("feature", F.transform("ms", lambda m: (m - 1) * times + F.col("t")).alias("s"))
    at = at.withColumn("to", F.explode(F.array_distinct(F.transform("s", lambda s: F.floor(s / SETS))))).withColumn("of", each(high))
    of_sets = at.select(*row(F.col("of"), F.col("to"), F.transform(F.filter("s", lambda s: F.floor(s / SETS) == F.col("to")), lambda s: s % SETS), F.lit(0.0)))
    sides = [df.withColumn("side", F.lit(side)) for df, side in ((of_cells, 0), (of_all, 0), (of_none, 0), (of_sets, 1))]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    pair, band = F.col("of") * wide + F.col("to"), F.pmod(F.xxhash64("feature"), F.lit(bands))
    keyed = rows.select(((pair * bands + band) * 2 + F.col("side")).alias("key"), "feature", "at", "v")
    dealt = keyed.repartition(tasks_of(spark, moved), F.floor(F.col("key") / (2 * bands)), F.floor(F.col("key") / 2) % bands % shares).sortWithinPartitions("key")
    sums = dealt.mapInArrow(_summed(n_cells, n_sets, bands, CELLS, SETS, ENTRIES, PAIRS), "c long, s int, n double, want double")
    if shares > 1:
        sums = sums.groupBy("c", "s").agg(F.sum("n").alias("n"), F.sum("want").alias("want"))
    known = F.broadcast(sets.select(((F.col("m") - 1) * times + F.col("t")).cast("int").alias("s"), "motif", (F.col("t") == 0).alias("own")))
    ratio = sums.join(known, "s").join(cells.select("c", "cell", "depth"), "c").withColumn("r", F.col("n") * F.lit(float(n_all)) / (F.col("depth") * F.when(F.col("want") > 0, F.col("want"))))
    # Sets whose features have no reads at all deviate by 0, which is 1 in these terms.
    back = F.when(~F.col("own"), F.coalesce("r", F.lit(1.0)))
    per = ratio.groupBy("cell", "motif").agg(F.max(F.when(F.col("own"), F.col("r"))).alias("r"), F.avg(back).alias("mean"), F.stddev_pop(back).alias("sd"))
    deviation = F.coalesce(F.col("r") - 1, F.lit(0.0))
    z = F.when(F.col("sd") > 1e-12, (deviation - (F.col("mean") - 1)) / F.col("sd")).otherwise(0.0)
    return per.select("cell", "motif", deviation.alias("deviation"), z.alias("z"))


def chromvar(x: DataFrame, regions: DataFrame, motif_list: list[motifs.Motif], *, p_value: float = 5e-5, method: str = "grid", n_iterations: int = 50, seed: int = 0, base: str | tuple[float, ...] = "subject") -> DataFrame:
    """Deviations from a matrix (cell, feature, value) and the sequences of its features (region, seq).

    Features are whitened by GC content and log reads, matched backgrounds are drawn from a grid
    (``grid``) or are the nearest others (``knn``), motifs are scanned, and deviations follow.
    A feature without reads is an error. Sequences are made once, for both composition and scan.
    """
    regions = stored(regions.select("region", "seq"))
    reads = x.groupBy(F.col("feature").alias("region")).agg(F.sum("value").alias("reads"))
    bias = motifs.peak_bias(regions).join(reads, "region", "left").select(F.col("region").alias("feature"), "gc_content", F.coalesce("reads", F.lit(0)).alias("reads"))
    background = motifs.sample_background(stored(bias), method=method, n_iterations=n_iterations, seed=seed)
    hits = motifs.scan_motifs(regions, motif_list, p_value, background=base).select("motif", F.col("region").alias("feature"))
    return compute_deviations(x, stored(hits, batch=SEQUENCES), stored(background))
