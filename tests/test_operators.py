import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import deviations, embed, gsea, intervals, markers, matrix, motifs, peaks, qc
from tessera.session import materialize

FRAG = "chrom string, start long, `end` long, barcode string, count int"


def frags(spark, rows):
    return spark.createDataFrame(rows, FRAG)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_tiles_count_both_ends_once_per_tile(spark):
    sizes = spark.createDataFrame([("chr1", 20), ("chrM", 20)], "chrom string, size long")
    f = frags(spark, [("chr1", 0, 10, "a", 5), ("chr1", 5, 11, "a", 2), ("chr1", 18, 25, "a", 1), ("chrM", 0, 5, "a", 1)])
    assert got(matrix.tile_matrix(f, sizes, 10, 1)) == [("a", "chr1", 0, 2), ("a", "chr1", 1, 2)]
    assert got(matrix.tile_matrix(f, sizes, 10, 1, strategy="count")) == [("a", "chr1", 0, 7), ("a", "chr1", 1, 3)]
    assert got(matrix.tile_matrix(f, sizes, 10, 5)) == []
    with pytest.raises(ValueError):
        matrix.tile_matrix(f, sizes, strategy="other")


def test_binned_joins_equal_nested_loops(spark):
    rng = random.Random(5)
    a = [(f"c{rng.randint(1, 2)}", s, s + rng.randint(0, 900), i) for i in range(120) for s in [rng.randint(0, 5000)]]
    b = [(f"c{rng.randint(1, 2)}", s, s + rng.randint(0, 90), i) for i in range(120) for s in [rng.randint(0, 5000)]]
    left = spark.createDataFrame(a, "chrom string, s long, e long, i long")
    right = spark.createDataFrame(b, "chrom string, rs long, re long, j long")
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1])
    assert got(intervals.join_overlaps(left, right, "s", "e", "rs", "re", width=64).select("i", "j")) == want
    points = right.select("chrom", F.col("rs").alias("p"), "j")
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[1] < x[2])
    assert got(intervals.join_points(points, left, "p", "s", "e", width=64).select("i", "j")) == want


def test_union_merges_touching_and_crosses_blocks(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 5, 8), ("c", 9, 12), ("c", 11, 40), ("c", 2, 3)], "chrom string, start long, end long")
    for block in (4, 1 << 20):
        assert got(intervals.union_intervals(df, block=block)) == [("c", 0, 8), ("c", 9, 40)]


def test_deep_segments_merge_events_by_position(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 2, 8), ("a", 4, 6), ("a", 6, 7), ("a", 20, 30)], "k string, start long, end long")
    assert got(intervals.deep_segments(df, ("k",), 3).select("k", "start", "end", "min_overlap", "max_overlap")) == [("a", 4, 7, 3, 3)]


def test_filter_prefix_query_and_errors(spark):
    f = frags(spark, [("chr1", i, i + 5, "a", 1) for i in range(3)] + [("chr1", 0, 5, "b", 1)])
    assert {r.barcode for r in qc.filter_fragments(f, min_fragments=2, prefix="x_").collect()} == {"x_a"}
    m = spark.createDataFrame([("x_b", 9)], "barcode string, n_unique long")
    assert {r.barcode for r in qc.filter_fragments(f, min_fragments=2, prefix="x_", metrics=m, query="n_unique > 5 and not n_unique == 8").collect()} == {"x_b"}
    with pytest.raises(ValueError):
        qc.apply_query(m, "n_unique >")
    assert got(qc.filter_fragments(f, min_fragments=50)) == []


def test_doublets_without_overlaps_are_singlets(spark):
    f = frags(spark, [("chr1", i * 100, i * 100 + 5, c, 1) for i in range(5) for c in "ab"])
    assert [(r.p_value, r.q_value, r.is_doublet) for r in qc.detect_doublets(f, min_fragments=2).collect()] == [(1.0, 1.0, False)] * 2


def test_gene_domains_by_strand_and_gene_matrix_bounds(spark):
    tx = spark.createDataFrame([("chr1", 101, 200, "+", "t1", "g1"), ("chr1", 101, 200, "-", "t2", "g2"), ("chr1", 5, 9, "+", "t3", None)], "chrom string, g_start long, g_end long, strand string, transcript_id string, gene_id string")
    d = materialize(matrix.gene_domains(tx, 50, 10))
    assert got(d.select("start", "end", "id")) == [(50, 209, "g1"), (90, 249, "g2")]
    f = frags(spark, [("chr1", 50, 60, "a", 1), ("chr1", 209, 220, "a", 1), ("chr1", 20, 50, "a", 1)])
    assert got(matrix.gene_matrix(f, d, 1)) == [("a", "g1", 1), ("a", "g2", 1)]


def test_gene_model_is_not_evaluated_as_code():
    for bad in ("__import__('os')", "x; 1", "open(x)"):
        with pytest.raises(ValueError):
            matrix.model_column(bad)


def test_feature_selection_edges(spark):
    x = spark.createDataFrame([("c", f"f{i}", i) for i in range(10)], "cell string, feature string, value long")
    assert {r.feature for r in matrix.select_features(x, 3, 0.2, 0.2).filter("selected").collect()} == {"f8", "f7", "f6"}
    assert matrix.select_features(x, 0).filter("selected").count() == 0
    assert {r.feature for r in matrix.select_features(x, 2, binary=True).filter("selected").collect()} == {"f9", "f8"}
    with pytest.raises(ValueError):
        matrix.combine({"a": x, "b": x})


def test_tails_against_exact_sums(spark):
    p = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert p(stats.poisson_upper(F.lit(4), F.lit(2.5))) == pytest.approx(1 - sum(math.exp(-2.5) * 2.5**i / math.factorial(i) for i in range(5)))
    assert p(stats.binomial_upper(F.lit(3), F.lit(9), F.lit(0.2))) == pytest.approx(sum(math.comb(9, i) * 0.2**i * 0.8 ** (9 - i) for i in range(3, 10)))
    assert p(stats.hypergeometric_upper(F.lit(2), F.lit(5), F.lit(20), F.lit(6))) == pytest.approx(sum(math.comb(5, i) * math.comb(15, 6 - i) for i in range(2, 6)) / math.comb(20, 6))
    q = stats.benjamini_hochberg(spark.createDataFrame([(0.01,), (0.02,), (0.9,)], "p double"), "p", "q")
    assert [r.q for r in q.orderBy("p").collect()] == pytest.approx([0.03, 0.03, 0.9])


def test_merge_peaks_is_greedy_and_clipped(spark):
    cols = "group int, chrom string, start long, peak long, p_value double"
    pk = spark.createDataFrame([(0, "c", 100, 0, 5.0), (0, "c", 300, 0, 9.0), (1, "c", 700, 0, 4.0), (1, "c", 995, 0, 1.0)], cols)
    sizes = spark.createDataFrame([("c", 1000)], "chrom string, size long")
    assert [(r.start, r.end) for r in peaks.merge_peaks(pk, sizes, 150).collect()] == [(150, 451), (550, 851)]
    out = [(r.start, r.end) for r in peaks.merge_peaks(pk, sizes, 100).collect()]
    assert out == [(200, 401), (600, 801), (895, 1000)]


def test_motif_parsing_thresholds_and_scans():
    text = "MEME version 4\n\nMOTIF M1+x NAME\nletter-probability matrix: alength= 4 w= 3\n 1 0 0 0\n 0 1 0 0\n 0 0 1 0\nURL x\n"
    (m,) = motifs.parse_meme(text)
    assert m.name == "M1" and len(m) == 3
    s = m.log_odds()
    t = motifs.score_threshold(s, 1 / 64 * 1.01)
    assert motifs.has_motif("TTACGTT", s, t) and not motifs.has_motif("TTACNGT", s, t)
    assert motifs.has_motif("CGT", s, t) and not motifs.has_motif("CGT", s, t, both=False)
    assert not motifs.has_motif("AC", s, t) and not motifs.has_motif(None, s, t)


def test_deviation_of_missing_pairs_is_minus_one(spark):
    x = spark.createDataFrame([("a", "f1", 2), ("b", "f2", 3)], "cell string, feature string, value long")
    m = spark.createDataFrame([("m", "f1")], "motif string, feature string")
    bg = spark.createDataFrame([("f1", i, f"f{i + 1}") for i in range(2)], "feature string, iteration int, background string")
    out = {r.cell: r.deviation for r in deviations.compute_deviations(x, m, bg).collect()}
    assert out["b"] == -1 and out["a"] == pytest.approx((2 - 0.8) / 0.8)


def test_enrichment_score_against_a_walk(spark):
    rng = random.Random(3)
    scores = [(f"f{i}", rng.uniform(-2, 2)) for i in range(60)]
    ranked = sorted(scores, key=lambda s: (-s[1], s[0]))
    sets = {t: set(rng.sample([s[0] for s in scores], 12)) for t in "xyz"}
    want = {}
    for t, s in sets.items():
        total, at, path = sum(abs(v) for f, v in ranked if f in s), 0.0, []
        for f, v in ranked:
            at += abs(v) / total if f in s else -1 / (60 - len(s))
            path.append(at)
        want[t] = max(path) if max(path) > -min(path) else min(path)
    r = spark.createDataFrame(scores, "feature string, score double")
    terms = spark.createDataFrame([(t, f) for t, s in sets.items() for f in s], "term string, feature string")
    assert {x.term: x.es for x in gsea.enrichment_scores(r, terms).collect()} == pytest.approx(want)
    assert {x.term: x.es for x in gsea.prerank(r, terms, permutations=50, min_size=2).collect()} == pytest.approx(want)


def test_spectral_agrees_with_dense_eigenvectors(spark):
    rng = np.random.default_rng(0)
    dense = (rng.random((12, 30)) < 0.4).astype(int)
    dense[:, 0], dense[6:, 1] = 1, 1
    x = spark.createDataFrame([(f"c{i:02}", f"f{j:02}", int(v)) for i, row in enumerate(dense) for j, v in enumerate(row) if v], "cell string, feature string, value long")
    out = {r.cell: r.embedding for r in embed.spectral(x, 3, steps=12).collect()}
    df = dense.sum(0)
    idf = np.log(12 / np.where(df >= 12, 11, np.maximum(df, 1)))
    w = dense * idf
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    d = w @ w.sum(0) - 1
    full = w @ w.T / np.sqrt(np.outer(d, d)) - np.diag(1 / d)
    values, vectors = np.linalg.eigh(full)
    lead = np.argsort(-np.abs(values))[:3]
    lead = lead[np.argsort(-values[lead])]
    mine = np.array([out[f"c{i:02}"] for i in range(12)])
    keep = [i for i in lead if values[i] > 0]
    assert np.abs(mine) == pytest.approx(np.abs(vectors[:, keep] * np.sqrt(values[keep])), abs=1e-6)


def test_samples_are_equal_and_seeded(spark):
    cells = spark.createDataFrame([(f"c{i}", "a" if i < 5 else "b") for i in range(20)], "cell string, group string")
    one, two = (got(markers.sample_cells(cells, "a", 4, s)) for s in (1, 1))
    assert one == two and [s for _, s in one].count("fg") == [s for _, s in one].count("bg") == 4


def test_background_cells_are_drawn_by_search(spark):
    """A draw doesn't read its cell's whole law, and is the one that a scan of the law finds."""
    rng = np.random.default_rng(3)
    w = rng.normal(size=(3000, 2))
    peaks = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(w)], "feature long, w0 double, w1 double")
    out = motifs.background_bins(peaks, bs=8, n_iterations=3)
    assert "exists" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "lambda" not in plan
    low, span = w.min(0), np.maximum(np.ptp(w, axis=0), 1e-12)
    cell = (np.minimum(np.floor((w - low) / span * 7 + 0.5), 7) @ [8, 1]).astype(int)
    cells = np.unique(cell)
    xy = np.stack([cells // 8, cells % 8], axis=1) * (span / 7)
    unit = lambda tag: f"shiftrightunsigned(xxhash64(cast(feature as string), iteration, '{tag}:0'), 11) * {2.0**-53!r}D"
    asked = peaks.selectExpr("feature", "explode(sequence(0, 2)) as iteration").selectExpr("feature", "iteration", f"{unit('cell')} as u", f"{unit('peak')} as v").collect()
    want = set()
    for r in asked:
        law = np.exp(-((xy - xy[np.searchsorted(cells, cell[r.feature])]) ** 2).sum(1) / (2 * 0.1 * 0.1))
        to = cells[min(len(cells) - 1, int((np.cumsum(law / law.sum()) < r.u).sum()))]
        members = np.flatnonzero(cell == to)
        want.add((r.feature, r.iteration, int(members[int(np.floor(r.v * len(members)))])))
    assert {tuple(r) for r in out.collect()} == want


def test_tasks_go_with_the_rows(spark, monkeypatch, tmp_path):
    """Scores, doublets and tile counts are dealt to more tasks if there are more rows, with the same results."""
    from tessera import session
    from tessera.streaming import counts

    rows = spark.range(6000).selectExpr("concat('chr', 1 + id % 3) as chrom", "id * 37 % 9000 as start", "id * 37 % 9000 + 100 + id % 80 as `end`", "concat('b', id % 9) as barcode", "1 as count")
    genes = spark.createDataFrame([("g1", "chr1", 1000, 2000, "+"), ("g2", "chr2", 4000, 4500, "-")], "symbol string, chrom string, lo long, hi long, strand string")
    rows.write.parquet(str(tmp_path / "in"))
    asked = []

    def results(turn):
        counts.count_stream(counts.stream_fragments(spark, str(tmp_path / "in")), str(tmp_path / f"state{turn}"), str(tmp_path / f"check{turn}")).awaitTermination()
        tiles = counts.read_counts(spark, str(tmp_path / f"state{turn}"))
        return got(matrix.gene_scores(rows, matrix.gene_score_domains(genes))), got(qc.detect_doublets(rows)), got(tiles), tiles._jdf.queryExecution().optimizedPlan().toString()

    keep = session.stored
    for module in (matrix, qc):
        monkeypatch.setattr(module, "stored", lambda df, path=None, tasks=None: asked.append(tasks) or keep(df, path, tasks))
    few = results(0)
    assert set(asked) == {4}
    monkeypatch.setattr(session, "TASK_ROWS", 600)
    many = results(1)
    assert few[:3] == many[:3] and set(asked) == {4, 10} and "RepartitionByExpression [barcode" in many[3]


def test_state_goes_with_the_rows(spark, tmp_path):
    """A stream's state has as many partitions as asked for, and the session keeps its settings."""
    from tessera.streaming import counts

    rows = spark.range(300).selectExpr("'chr1' as chrom", "id as start", "id + 9 as `end`", "concat('b', id % 2) as barcode", "2 as count", "timestamp_seconds(1700000000 + id) as seen")
    rows.write.parquet(str(tmp_path / "in"))
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counts.qc_stream(stream, str(tmp_path / "state"), str(tmp_path / "check"), tasks=7).awaitTermination()
    assert len([x for x in (tmp_path / "check" / "state" / "0").iterdir() if x.name.isdigit()]) == 7
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert [tuple(r)[:2] for r in counts.read_qc(spark, str(tmp_path / "state")).orderBy("barcode").collect()] == [("b0", 150), ("b1", 150)]
