"""Sequence composition, motif scanning and enrichment, matched backgrounds."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.ranks import along
from ..session import stored, tasks_of
from .neighbours import nearest

BASES = "ACGT"


def gc_content(seq: Column) -> Column:
    n = F.length(seq)
    return F.when(n > 0, (n - F.length(F.translate(seq, "GCgc", ""))) / n).otherwise(0.0)


def cpg_density(seq: Column) -> Column:
    n = F.length(seq)
    return F.when(n > 0, F.regexp_count(F.upper(seq), F.lit("CG")) / n).otherwise(0.0)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def base_frequencies(seqs: DataFrame, column: str = "seq") -> DataFrame:
    """One row ``a, c, g, t``: shares of the four bases over all sequences."""
    counts = [F.sum(F.regexp_count(F.upper(F.col(column)), F.lit(b))).alias(b.lower()) for b in BASES]
    n = sum((F.col(b.lower()) for b in BASES[1:]), F.col("a"))
    return seqs.agg(*counts).select(*[F.when(n > 0, F.col(b.lower()) / n).otherwise(0.25).alias(b.lower()) for b in BASES])


def background_of(name: str | tuple[float, ...] | np.ndarray, seqs: DataFrame) -> np.ndarray:
    """Base probabilities: of the sequences (``subject``), a quarter each (``even``), or the four given."""
    if isinstance(name, str):
        if name == "even":
            return np.full(4, 0.25)
        if name == "subject":
            return np.array(base_frequencies(seqs).first(), dtype=float)
        raise ValueError(f"unknown background {name!r}")
    out = np.asarray(name, dtype=float)
    if out.shape != (4,) or (out <= 0).any():
        raise ValueError("a background has four positive probabilities")
    return out / out.sum()


@dataclass
class Motif:
    """A position weight matrix, one row per position, columns A C G T; ``pfm`` are its counts, if known."""

    name: str
    pwm: np.ndarray
    family: str = ""
    id: str = field(default="")
    pfm: np.ndarray | None = None

    def __post_init__(self) -> None:
        pwm = np.clip(np.asarray(self.pwm, dtype=float), 1e-10, 1.0)
        self.pwm = pwm / pwm.sum(axis=1, keepdims=True)

    def __len__(self) -> int:
        return len(self.pwm)

    def information(self) -> float:
        return float((2 + (self.pwm * np.log2(self.pwm)).sum(axis=1)).sum())

    def log_odds(self, background: np.ndarray | None = None, mode: str = "natural", pseudocount: float = 0.8) -> np.ndarray:
        """Scores ln(p / background) (``natural``), or log2 against a quarter with the background added (``log2``).

        In the second mode counts, where known, are smoothed by ``pseudocount`` times the background.
        """
        bg = np.full(4, 0.25) if background is None else np.asarray(background, dtype=float)
        if mode == "natural":
            return np.log(self.pwm / bg)
        if mode != "log2":
            raise ValueError(f"unknown score mode {mode!r}")
        p = self.pwm
        if self.pfm is not None:
            p = np.asarray(self.pfm, dtype=float) + pseudocount * bg
            p = p / p.sum(axis=1, keepdims=True)
        return np.log2(p / 0.25) + np.log2(bg / 0.25)

    def reverse_complement(self) -> Motif:
        return Motif(self.name, self.pwm[::-1, ::-1], self.family, self.id, None if self.pfm is None else np.asarray(self.pfm)[::-1, ::-1])


def parse_meme(text: str) -> list[Motif]:
    """Motifs of a MEME file; the name is the id up to a plus sign."""
    out = []
    for part in re.split(r"^MOTIF\s+", text, flags=re.M)[1:]:
        lines = part.splitlines()
        head = lines[0].split()
        rows: list[list[float]] = []
        inside = False
        for line in lines[1:]:
            if line.startswith("letter-probability"):
                inside = True
            elif inside:
                cells = line.split()
                if len(cells) != 4 or line.startswith("URL"):
                    break
                rows.append([float(c) for c in cells])
        if rows:
            out.append(Motif(head[0].split("+")[0], np.array(rows), id=head[0], family=head[1] if len(head) > 1 else ""))
    return out


def read_motifs(path: str, unique: bool = True) -> list[Motif]:
    """Motifs of a file; of those with one name the most informative."""
    with open(path) as f:
        motifs = parse_meme(f.read())
    if not unique:
        return motifs
    best: dict[str, Motif] = {}
    for m in motifs:
        if m.name not in best or m.information() > best[m.name].information():
            best[m.name] = m
    return list(best.values())


def score_threshold(log_odds: np.ndarray, p_value: float, background: np.ndarray | None = None, bins: int = 20_000) -> float:
    """The least score whose tail under the background is at most ``p_value``, by convolution of positions."""
    bg = np.full(4, 0.25) if background is None else np.asarray(background, dtype=float)
    low, high = log_odds.min(axis=1).sum(), log_odds.max(axis=1).sum()
    step = max((high - low) / bins, 1e-9)
    shifts = np.round((log_odds - log_odds.min(axis=1, keepdims=True)) / step).astype(int)
    law = np.ones(1)
    for row in shifts:
        wider = np.zeros(len(law) + row.max())
        for s, p in zip(row, bg, strict=True):
            wider[s : s + len(law)] += p * law
        law = wider
    tail = np.cumsum(law[::-1])[::-1]
    # A score that occurs; sums of rounded steps differ from it by half a step per position at most.
    ok = np.flatnonzero((tail <= p_value) & (law > 0))
    return low + step * ((int(ok[0]) if len(ok) else len(law)) - (len(log_odds) + 1) / 2)


_CODE = np.full(256, 4, dtype=np.int8)
for _i, _b in enumerate(BASES):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


#: Letters that are scanned at once, and letters of a word that is scored by one look.
SCAN_LETTERS, SPAN = 1 << 18, 6


def find_motifs(seqs: list[str | None], tables: list[tuple[np.ndarray, float]], both: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each table and of the sequences with a window that reaches its threshold, on either strand.

    All sequences are scored as one text with a letter of no base between them; windows with such a
    letter score minus infinity. ``SPAN`` letters are one word, coded once for all tables, and a window's score
    is that of its words; scores beside the threshold are summed again letter by letter.
    """
    parts = [(x or "").encode("latin-1", "replace") for x in seqs]
    starts = np.cumsum([0] + [len(x) + 1 for x in parts])
    code = _CODE[np.frombuffer(b"N".join([*parts, b""]), np.uint8)]
    words = np.zeros(len(code), np.intp)
    padded = np.concatenate([code, np.full(SPAN, 4, np.int8)])
    for place in range(SPAN):
        words *= 5
        words += padded[place : place + len(code)]
    for number, (scores, least) in enumerate(tables):
        n = len(code) - len(scores) + 1
        if n <= 0:
            continue
        strands = [np.hstack([t, np.full((len(t), 1), -np.inf)]) for t in (scores, scores[::-1, ::-1])[: 1 + both]]
        if len(scores) <= SPAN:
            found = np.flatnonzero(np.logical_or.reduce([_word_scores(wide) >= least for wide in strands])[words[:n]])
        else:
            hit = np.zeros(n, bool)
            for wide in strands:
                total = _word_scores(wide[:SPAN])[words[:n]]
                for place in range(SPAN, len(wide), SPAN):
                    total += _word_scores(wide[place : place + SPAN])[words[place : place + n]]
                at = np.flatnonzero(total >= least - 1e-9 * (1 + abs(least)))
                exact = np.zeros(len(at))
                for place, row in enumerate(wide):
                    exact += row[code[at + place]]
                hit[at[exact >= least]] = True
            found = np.flatnonzero(hit)
        yield number, np.unique(np.searchsorted(starts, found, side="right") - 1)


def _word_scores(wide: np.ndarray) -> np.ndarray:
    """The score of each word of ``SPAN`` letters by its first ones, of which the table has a row each, summed in their order."""
    total = np.zeros(1)
    for row in wide:
        total = (total[:, None] + row).ravel()
    return np.repeat(total, 5 ** (SPAN - len(wide)))


def has_motif(seq: str | None, scores: np.ndarray, threshold: float, both: bool = True) -> bool:
    """Whether any window without other letters reaches the threshold, on either strand."""
    return any(len(found) for _, found in find_motifs([seq], [(scores, threshold)], both))


def with_sequences(regions: DataFrame, chunks: DataFrame, coordinates: str = "0-based", name: str = "region") -> DataFrame:
    """``regions`` with ``seq`` fetched by their names (``chr:1-2``); 1-based names are closed intervals."""
    from ..sources.formats import fetch_sequences
    from .matrix import parse_regions

    if coordinates not in ("0-based", "1-based"):
        raise ValueError(f"unknown coordinates {coordinates!r}")
    placed = parse_regions(regions.withColumn("feature", F.col(name)) if name != "feature" else regions, closed=coordinates == "1-based")
    if coordinates == "1-based":
        placed = placed.withColumn("start", F.col("start") - 1)
    return fetch_sequences(placed, chunks).select(*regions.columns, "seq")


def scan_motifs(
    regions: DataFrame, motifs: list[Motif], p_value: float = 5e-5, both: bool = True, background: str | tuple[float, ...] | np.ndarray = "subject",
    mode: str = "natural", chunks: DataFrame | None = None, coordinates: str = "0-based",
) -> DataFrame:
    """``region, motif`` of ``regions`` (region, seq) that hold a motif; sequences stream through numpy in blocks.

    Without a column ``seq`` sequences are fetched from FASTA ``chunks`` by the names of the regions.
    """
    if "seq" not in regions.columns:
        if chunks is None:
            raise ValueError("regions without sequences need the chunks of a FASTA file")
        regions = with_sequences(regions, chunks, coordinates)
    bg = background_of(background, regions)
    names = [m.name for m in motifs]
    tables = [(t, score_threshold(t, p_value, bg)) for t in (m.log_odds(bg, mode) for m in motifs)]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = np.cumsum(f["seq"].str.len().fillna(0).to_numpy(dtype=np.int64) + 1) // SCAN_LETTERS
            for _, part in f.groupby(size, sort=False):
                region = part["region"].to_numpy()
                for number, found in find_motifs(part["seq"].tolist(), tables, both):
                    if len(found):
                        yield pd.DataFrame({"region": region[found], "motif": names[number]})

    return regions.select("region", "seq").mapInPandas(scan, regions.select("region").schema.add("motif", "string"))


def kmer_hits(regions: DataFrame, kmers: DataFrame) -> DataFrame:
    """``region, motif`` where a sequence or its reverse complement holds one of the ``kmers`` (motif, kmer).

    The k-mers, one row of them, go to all tasks; each sequence is read once and nothing is shuffled.
    """
    one = F.struct("motif", F.upper("kmer").alias("kmer"), reverse_complement(F.upper("kmer")).alias("back"))
    listed = kmers.agg(F.collect_list(one).alias("kmers"))
    held = F.filter("kmers", lambda k: F.contains(F.col("_seq"), k["kmer"]) | F.contains(F.col("_seq"), k["back"]))
    found = regions.withColumn("_seq", F.upper("seq")).crossJoin(F.broadcast(listed)).select("region", F.array_distinct(F.transform(held, lambda k: k["motif"])).alias("motif"))
    return found.select("region", F.explode("motif").alias("motif"))


def motif_enrichment(hits: DataFrame, targets: DataFrame, background: DataFrame | None = None, method: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """Per group and motif: ``k`` of ``n_draw`` targets and ``n_hit`` of ``n_all`` background regions, fold change, p and adjusted p.

    ``targets`` has (group, region). The background is all target regions if none is given, else
    (region) for all groups or (group, region) for each; the test is ``hypergeometric`` in the first
    case and ``binomial`` otherwise, unless named. Enriched motifs are tested by the upper tail, depleted
    ones by the lower. Motifs are those of ``hits`` (region, motif), or all ``names`` (motif).
    """
    method = method or ("hypergeometric" if background is None else "binomial")
    if method not in ("hypergeometric", "binomial"):
        raise ValueError(f"unknown method {method!r}")
    hits = hits.select("region", "motif").distinct()
    names = (hits if names is None else names).select("motif").distinct()
    groups = targets.select("group").distinct()
    if background is None:
        background = targets.select("region").distinct()
    by_group = "group" in background.columns
    if by_group and (not groups.join(background, "group", "left_anti").isEmpty() or not background.join(groups, "group", "left_anti").isEmpty()):
        raise ValueError("a background by group needs the groups of the targets, and no others")
    if background.isEmpty():
        raise ValueError("the background has no regions")
    keys = ["group"] if by_group else []
    total = background.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"))
    inside = background.join(hits, "region").groupBy(*keys, "motif").agg(F.count(F.lit(1)).alias("n_hit"))
    sizes = targets.groupBy("group").agg(F.count(F.lit(1)).alias("n_draw"))
    both = targets.join(hits, "region").groupBy("group", "motif").agg(F.count(F.lit(1)).alias("k"))
    # Groups by motifs: the size of the result.
    grid = sizes.join(total, "group") if by_group else sizes.crossJoin(F.broadcast(total))
    grid = grid.crossJoin(names).join(both, ["group", "motif"], "left").join(inside, [*keys, "motif"], "left").fillna(0, ["k", "n_hit"])
    k, draws, good, n = (F.col(c) for c in ("k", "n_draw", "n_hit", "n_all"))
    infinite = F.lit(float("inf"))
    fc = F.when((k == 0) & (good == 0), 0.0).when(k == 0, -infinite).when(good == 0, infinite).otherwise(F.log2((k / draws) / (good / n)))
    if method == "binomial":
        share = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), good / n))
        up, down = stats.binomial_upper(k, draws, share), stats.binomial_lower(k, draws, share)
    else:
        up, down = stats.hypergeometric_upper(k, good, n, draws), stats.hypergeometric_lower(k, good, n, draws)
    tested = grid.withColumn("log2_fc", fc).withColumn("p_value", F.greatest(F.lit(stats.TINY), F.least(F.lit(1.0), F.when(F.col("log2_fc") >= 0, up).otherwise(down))))
    out = stats.benjamini_hochberg(tested, "p_value", "fdr", by=("group",), tie=("motif",))
    return out.select("group", "motif", "k", "n_draw", "n_hit", "n_all", "log2_fc", "p_value", "fdr")


def whitening(df: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """The matrix that makes the columns uncorrelated with unit variance; jitter helps singular ones."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    row = df.agg(*[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    if len(columns) == 1:
        return np.array([[1 / math.sqrt(cov[0, 0]) if cov[0, 0] > 0 else 0.0]])
    for jitter in (0.0, 1e-12, 1e-9, 1e-6, 1e-3):
        try:
            return np.linalg.inv(np.linalg.cholesky(cov + jitter * np.eye(len(columns)))).T
        except np.linalg.LinAlgError:
            continue
    return np.diag(1 / np.sqrt(np.maximum(np.diag(cov), 1e-12)))


def whiten(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``df`` with ``w0, w1, ...``, the whitened columns."""
    m = whitening(df, columns)
    return df.withColumns({f"w{j}": sum((F.col(c) * float(m[i, j]) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(len(columns))})


def check_bias(df: DataFrame, columns: tuple[str, ...]) -> None:
    """ValueError unless the table has rows and numbers in all bias columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing or not columns:
        raise ValueError(f"bias columns are missing: {', '.join(missing) or 'none given'}")
    bad = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(sum((F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False)).cast("int") + F.col(c).isNull().cast("int") for c in columns), F.lit(0)) > 0).alias("bad")).first()
    if not bad["n"]:
        raise ValueError("bias values need at least one row")
    if bad["bad"]:
        raise ValueError("a bias value is missing")


def peak_bias(regions: DataFrame, chunks: DataFrame | None = None, *, gc: bool = True, cpg: bool = False, coordinates: str = "0-based") -> DataFrame:
    """``regions`` with ``gc_content`` and ``cpg_density`` of their sequences, fetched if they have none."""
    seqs = regions if "seq" in regions.columns else with_sequences(regions, chunks, coordinates)
    more = {**({"gc_content": gc_content(F.col("seq"))} if gc else {}), **({"cpg_density": cpg_density(F.col("seq"))} if cpg else {})}
    return seqs.withColumns(more).select(*regions.columns, *more)


def sample_background(bias: DataFrame, *, columns: tuple[str, ...] = ("gc_content", "reads"), method: str = "knn", n_iterations: int = 50, bs: int = 50, w: float = 0.1, seed: int = 0) -> DataFrame:
    """``feature, iteration, background`` for features with bias columns; ``reads`` is taken by its logarithm.

    ``knn`` takes the nearest others, over again if there are fewer than iterations; ``grid`` draws
    from cells of a grid by distance. A feature without reads is an error.
    """
    if method not in ("knn", "grid"):
        raise ValueError(f"unknown background method {method!r}")
    check_bias(bias, columns)
    if "reads" in columns:
        if not bias.filter("reads <= 0").isEmpty():
            raise ValueError("a feature has no reads")
        bias = bias.withColumn("reads", F.log10("reads"))
    white = whiten(bias, columns)
    if method == "grid":
        if len(columns) != 2:
            raise ValueError("the grid needs two bias columns")
        return background_bins(white, bs, w, n_iterations, seed)
    found = nearest(white, white, tuple(f"w{i}" for i in range(len(columns))), n_iterations)
    near = found.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]).alias("others"))
    each = F.transform(F.sequence(F.lit(0), F.lit(n_iterations - 1)), lambda i: F.struct(i.alias("iteration"), F.get("others", i % F.size("others")).alias("background")))
    return near.select(F.col("query").alias("feature"), F.explode(each).alias("e")).select("feature", "e.iteration", "e.background")


def background_bins(peaks: DataFrame, bs: int = 50, w: float = 0.1, n_iterations: int = 50, seed: int = 0) -> DataFrame:
    """``feature, iteration, background`` by sampling from cells of a grid over ``w0, w1``, weighted by distance.

    Peaks are put to their grid cell; a cell draws other cells by a Gaussian law, then a peak of that
    cell uniformly. The grid is bs by bs whatever the number of peaks, and so are the places of cells that go
    to the tasks; draws are made from seeded hashes of feature and iteration.
    """
    low = peaks.agg(*[f(c).alias(f"{n}{c}") for c in ("w0", "w1") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    span = {c: max((low[f"hi{c}"] or 0) - (low[f"lo{c}"] or 0), 1e-12) for c in ("w0", "w1")}
    cell = lambda c: F.least(F.floor((F.col(c) - (low[f"lo{c}"] or 0)) / span[c] * (bs - 1) + 0.5), F.lit(bs - 1))
    placed = peaks.withColumn("cell", (cell("w0") * bs + cell("w1")).cast("int"))
    order = Window.partitionBy("cell").orderBy("feature")
    numbered = stored(placed.withColumn("k", F.row_number().over(order) - 1).select("feature", "cell", "k"))
    counts = numbered.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").toPandas()  # bs * bs rows at most
    cells, sizes = counts["cell"].to_numpy(), counts["n"].to_numpy()
    xy = np.stack([cells // bs, cells % bs], axis=1) * (np.array([span["w0"], span["w1"]]) / max(bs - 1, 1))
    unit = lambda tag: (F.shiftrightunsigned(F.xxhash64(F.col("feature").cast("string"), F.col("iteration"), F.lit(f"{tag}:{seed}")), 11)) * F.lit(2.0**-53)
    # Draws are dealt out before they are made: features are few where draws are many.
    dealt = numbered.select("feature", "cell").repartition(tasks_of(peaks.sparkSession, int(sizes.sum()) * n_iterations), "feature")
    each = dealt.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_iterations - 1))))
    asked = each.select("feature", "iteration", "cell", unit("cell").alias("_u"), unit("peak").alias("_v"))
    drawn = asked.mapInArrow(_drawn_cells(cells, sizes, xy, w), f"feature {dict(peaks.dtypes)['feature']}, iteration int, cell int, k int")
    return drawn.join(numbered.withColumnRenamed("feature", "background"), ["cell", "k"]).select("feature", "iteration", "background")


#: Bytes of laws that a task keeps.
LAW_BYTES = 64 << 20


def _drawn_cells(cells: np.ndarray, sizes: np.ndarray, xy: np.ndarray, w: float):
    """Rows (feature, iteration, cell, _u, _v) to the cell that ``_u`` draws by its cell's law, and the peak that ``_v`` draws in it.

    A cell's law is made from the places of all cells where it is needed, and searched by halves.
    """

    def law(at: int) -> np.ndarray:
        x = np.exp(-((xy - xy[at]) ** 2).sum(1) / (2 * w * w))
        return np.cumsum(x / x.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        laws: dict[int, np.ndarray] = {}
        for batch in batches:
            at, u, v = np.searchsorted(cells, batch.column(2).to_numpy()), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            order = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1])[: len(at)])
            to = np.empty(len(at), np.int64)
            for part in np.split(order, heads[1:]):
                if len(part):
                    own = int(at[part[0]])
                    if own not in laws:
                        if (len(laws) + 1) * 8 * len(cells) > LAW_BYTES:
                            laws.clear()
                        laws[own] = law(own)
                    to[part] = np.minimum(len(cells) - 1, np.searchsorted(laws[own], u[part]))
            k = np.floor(v * sizes[to]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells[to].astype(np.int32)), pa.array(k)], ["feature", "iteration", "cell", "k"])

    return run


def sample_matched(targets: DataFrame, pool: DataFrame, columns: tuple[str, ...], *, n_samples: int | None = None, n_bins: int = 50, replace: bool = True, seed: int = 0, key: str = "region") -> DataFrame:
    """``sample, region`` drawn from the pool so that their bias is that of the targets.

    Targets are drawn first, over again if there are fewer than samples. Each draws among its nearest
    of the pool by a Gaussian law, whose width is the pool's extent over ``n_bins``. Without replacement
    samples that draw the same region are told apart by the draw, and the others draw again among
    what is left; where nothing near is left, the nearest unused region is taken. Draws are made from
    seeded hashes, so they repeat on any cluster.
    """
    check_bias(targets, columns)
    check_bias(pool, columns)
    n_targets, n_pool = targets.count(), pool.count()
    n = n_targets if n_samples is None else int(n_samples)
    if n < 1 or n_bins < 1:
        raise ValueError("at least one sample and one bin are needed")
    if not replace and n > n_pool:
        raise ValueError("the pool has fewer regions than are to be drawn without replacement")
    told = F.xxhash64(F.col(key).cast("string"), F.lit(f"target:{seed}"))
    ordered = along(targets.select(F.col(key).alias("_target"), told.alias("_told"), *columns), ["_told", "_target"], number="_k")
    copies = -(-n // n_targets)
    drawn = ordered.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("sample", F.col("_turn") * n_targets + F.col("_k")).filter(F.col("sample") <= n)
    drawn = stored(drawn.select("sample", *columns))
    spread = pool.agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns]).first()
    width = max(math.sqrt(sum(float(x) ** 2 for x in spread)) / n_bins, 1e-6)
    points = stored(pool.select(F.col(key).cast("string").alias("name"), *columns))
    taken = None
    wanted, near = drawn, max(64, min(2048, 8 * n_bins))
    while True:
        free = points if taken is None else points.join(taken.select(F.col("region").alias("name")), "name", "left_anti")
        asked = wanted.select(F.concat(F.lit("sample "), F.col("sample").cast("string")).alias("name"), *columns)
        found = nearest(free, asked, columns, near, key="name").select(F.substring_index("query", " ", -1).cast("long").alias("sample"), F.col("name").alias("region"), "distance")
        unit = (F.shiftrightunsigned(F.xxhash64("region", "sample", F.lit(seed)), 11) + 1) * F.lit(2.0**-53)
        law = F.exp(-0.5 * F.pow(F.col("distance") / width, F.lit(2)))
        # The least of exponential times by weight falls on each candidate with its share; far ones come by distance.
        race = F.when(law > 0, F.struct(F.lit(0).alias("far"), (-F.log(unit) / law).alias("at"))).otherwise(F.struct(F.lit(1).alias("far"), F.col("distance").alias("at")))
        left = stored(found.withColumn("race", race))
        if replace:
            return left.groupBy("sample").agg(F.min_by("region", F.struct("race", "region")).alias("region"))
        while not left.isEmpty():
            best = left.groupBy("sample").agg(F.min(F.struct("race", "region")).alias("b")).select("sample", "b.race", "b.region")
            won = stored(best.groupBy("region").agg(F.min_by("sample", F.struct("race", "sample")).alias("sample")).select("sample", "region"))
            taken = won if taken is None else stored(taken.unionByName(won))
            left = stored(left.join(won.select("sample"), "sample", "left_anti").join(won.select("region"), "region", "left_anti"))
        wanted = stored(drawn.join(taken.select("sample"), "sample", "left_anti"))
        if wanted.isEmpty():
            return taken


def matched_background(targets: DataFrame, pool: DataFrame, n_background: int | None = None, n_bins: int = 50, replace: bool = True, seed: int = 0) -> DataFrame:
    """Regions of the pool, without targets, whose GC content is spread as that of the targets: ``sample, region, gc``.

    With a column ``group`` in the targets each group draws its own, from the pool or, if that has the
    column as well, from its part of the pool. As many as there are targets are drawn, or
    ``n_background``.
    """
    if "group" in targets.columns:
        names = [r[0] for r in targets.select("group").distinct().orderBy("group").collect()]
        if "group" in pool.columns and {r[0] for r in pool.select("group").distinct().collect()} != set(names):
            raise ValueError("a pool by group needs the groups of the targets, and no others")
        out = None
        for g in names:
            of = pool.filter(F.col("group").eqNullSafe(F.lit(g))).drop("group") if "group" in pool.columns else pool
            one = matched_background(targets.filter(F.col("group").eqNullSafe(F.lit(g))).drop("group"), of, n_background, n_bins, replace, seed).withColumn("group", F.lit(g))
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("there are no targets")
        return out
    kind = dict(pool.dtypes)["region"]
    t = stored(targets.select("region", gc_content(F.col("seq")).alias("gc")))
    p = stored(pool.join(targets.select("region"), "region", "left_anti").dropDuplicates(["region"]).select("region", gc_content(F.col("seq")).alias("gc")))
    if t.isEmpty() or p.isEmpty():
        raise ValueError("targets and, without them, the pool must not be empty")
    drawn = sample_matched(t, p, ("gc",), n_samples=n_background, n_bins=n_bins, replace=replace, seed=seed)
    return drawn.select("sample", F.col("region").cast(kind).alias("region")).join(p, "region").select("sample", "region", "gc")


def motif_table(spark: SparkSession, motifs: list[Motif]) -> DataFrame:
    return spark.createDataFrame([(m.id, m.name, m.family, m.pwm.tolist()) for m in motifs], "id string, name string, family string, pwm array<array<double>>")
