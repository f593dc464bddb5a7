"""Operators against plain numpy and hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import deviations, embed, gsea, markers, matrix, motifs, peaks, qc
from tessera.sources import formats


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_filter_language(spark):
    m = spark.createDataFrame([(1, 2.5, "x"), (5, 0.5, "y"), (9, -1.0, "x")], "n long, v double, `a b` string")
    said = lambda q: [r.n for r in qc.apply_query(m, q).orderBy("n").collect()]
    assert said("n > 1 and not (v < 0 or n == 7)") == [5] and said("1 < n <= 9") == [5, 9] and said("v >= -1e0 & `a b` == 'x'") == [1, 9]
    assert said("v != .5 | n == 5") == [1, 5, 9] and said("~(n > 1)") == [1] and said("n > v") == [5, 9]
    for bad in ("reflect('a', 'b') > 1", "n", "n >", "n > 1 extra", "missing > 1", "(n > 1", "n > 1; drop", "exp(n) > 1", ""):
        with pytest.raises(ValueError):
            qc.apply_query(m, bad)


def test_retile_judges_cells(spark):
    x = spark.createDataFrame([("a", "chr1:0-150", 2), ("a", "chr1;100-200", 3), ("b", "chr1:0-10", 1), ("b", "no interval", 7), ("c", "chr1:5-5", 4)], "cell string, feature string, value long")
    assert got(matrix.retile(x, 100)) == [("a", "chr1", 0, 2), ("a", "chr1", 1, 5), ("b", "chr1", 0, 1)]
    metrics = spark.createDataFrame([("a", 50, 0.5), ("b", 500, 0.9)], "barcode string, n_unique long, tsse double")
    obs = spark.createDataFrame([("a", 900), ("b", 3), ("c", 1)], "cell string, n_unique long")
    # The metrics' count comes first, although the matrix has one of its own.
    assert {r.cell for r in matrix.retile(x, 100, obs=obs, metrics=metrics, min_fragments=100).collect()} == {"b"}
    assert {r.cell for r in matrix.retile(x, 100, obs=obs, min_fragments=100).collect()} == {"a"}
    assert {r.cell for r in matrix.retile(x, 100, min_fragments=5).collect()} == {"a", "b"}
    assert {r.cell for r in matrix.retile(x, 100, metrics=metrics, query="tsse < 0.6").collect()} == {"a"}
    for bad in (dict(metrics=metrics.filter("barcode = 'z'")), dict(min_fragments=10**6), dict(metrics=metrics, query="tsse > 2")):
        with pytest.raises(ValueError):
            matrix.retile(x, 100, **bad)
    with pytest.raises(ValueError):
        matrix.retile(x.filter("feature = 'no interval'"), 100)


def test_gene_models_as_functions_and_unique_names(spark):
    x = spark.range(4).withColumn("_x", F.col("id").cast("double"))
    one = [r.v for r in x.select(matrix.model_column("exp(-abs(x)/2) + exp(-1)").alias("v")).collect()]
    two = [r.v for r in x.select(matrix.model_column(lambda c: F.exp(-F.abs(c) / 2) + math.exp(-1)).alias("v")).collect()]
    three = [r.v for r in x.select(matrix.model_column(matrix.pandas_model(lambda s: np.exp(-s.abs() / 2) + math.exp(-1))).alias("v")).collect()]
    assert one == pytest.approx(two) and one == pytest.approx(three)
    g = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "3")], "symbol string, gene_id string")
    assert {r.symbol for r in matrix.unique_names(g).collect()} == {"A_1", "A_2", "B"}


def test_doublets_and_repeats(spark):
    """One cell has three reads at many places, all cells at one place that is taken for a repeat."""
    rng, rows = random.Random(1), []
    for c in range(40):
        rows += [("chr1", 5000, 5100, f"c{c}", 1)] * 3
        rows += [("chr2", s, s + 50, f"c{c}", 1) for s in rng.sample(range(0, 10**7, 100), 30)]
    for k in range(25):
        rows += [("chr3", k * 1000 + d, k * 1000 + 100 + d, "c7", 1) for d in range(3)]
    f = spark.createDataFrame(rows, "chrom string, start long, `end` long, barcode string, count int")
    out = {r.cell_id: r for r in qc.detect_doublets(f, min_fragments=20).collect()}
    assert len(out) == 40 and [c for c, r in out.items() if r.is_doublet] == ["c7"]
    # The repeat does not count, so other cells have no region at all.
    assert out["c1"].p_value > 0.2
    spans = spark.createDataFrame([("chr1", 5050, 5060), ("chr3", 0, 24_500)], "chrom string, start long, `end` long")
    assert [c.cell_id for c in qc.detect_doublets(f, min_fragments=20, repeats=spans).collect() if c.is_doublet] == []
    assert qc.without_repeats(f, spans).count() == 40 * 30
    per = spark.createDataFrame([("chr1", i, i + 1, 40 if i == 3 else 1) for i in range(50)], "chrom string, start long, `end` long, n long")
    assert got(qc.repeat_regions(per)) == [("chr1", 3, 4)]


def test_fragments_of_groups_from_a_folder(spark, tmp_path):
    for n, shift in (("s1", 0), ("s2", 1000)):
        rows = [("chr1", shift + i, shift + i + 50, f"B{i % 2}", 1) for i in range(4)]
        formats.write_fragments(spark.createDataFrame(rows, formats.FRAGMENT), str(tmp_path / f"{n}.parquet"))
    groups = spark.createDataFrame([("s1_tile.h5ad", "B0", "x"), ("s2", "B0", "y"), ("s2", "B1", "x")], "source_file string, barcode string, group string")
    out = got(peaks.read_grouped(spark, str(tmp_path), groups).select("group", "start"))
    assert out == [("x", 0), ("x", 2), ("x", 1001), ("x", 1003), ("y", 1000), ("y", 1002)]
    one = peaks.read_grouped(spark, str(tmp_path / "s1.parquet"), groups.select("barcode", "group").filter("group = 'y'"))
    assert got(one.select("group", "start")) == [("y", 0), ("y", 2)]


def _chosen(rows):
    kept = []
    for a, b, p in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if all(b <= s or a >= e for s, e, _ in kept):
            kept.append((a, b, p))
    return sorted(kept)


def test_greedy_choice_by_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(a, a + rng.randint(1, 30), rng.randint(0, 5) / 2) for a in (rng.randint(0, 120) for _ in range(rng.randint(1, 25)))]
        order = sorted(range(len(rows)), key=lambda i: (-rows[i][2], rows[i][0], rows[i][1]))
        found = peaks._choice([r[0] for r in rows], [r[1] for r in rows], order, [peaks.OWN] * len(rows))
        assert sorted(r for r, f in zip(rows, found, strict=True) if f) == _chosen(rows)


def test_choice_over_ranges(spark):
    """One island over many ranges, also with values that fall along it, and clipped windows."""
    rng = random.Random(4)
    falling = [(10 * i, 10 * i + 31, 1000.0 - i) for i in range(150)]
    mixed = list({(a, a + w): (a, a + w, float(rng.randint(0, 4))) for a in range(0, 1500, 3) for w in (rng.choice([5, 31]),)}.values())
    both = [("a", *r) for r in falling] + [("b", *r) for r in mixed]
    df = spark.createDataFrame(both, "chrom string, start long, end long, p_value double")
    want = sorted([("a", *r) for r in _chosen(falling)] + [("b", *r) for r in _chosen(mixed)])
    for size in (124, 400, 1 << 16):
        assert sorted(map(tuple, peaks.best_apart(df, size).collect())) == want
    assert peaks.best_apart(df.limit(0)).count() == 0


def test_scans_with_options(spark, tmp_path):
    counts = np.array([[8, 1, 1, 0], [0, 9, 0, 1], [0, 0, 10, 0], [1, 0, 0, 9]], float)
    m = motifs.Motif("m", counts / 10, pfm=counts)
    bg = np.array([0.3, 0.2, 0.2, 0.3])
    smooth = (counts + 0.8 * bg) / 10.8
    assert m.log_odds(bg, "log2") == pytest.approx(np.log2(smooth / 0.25) + np.log2(bg / 0.25)) and m.log_odds(bg) == pytest.approx(np.log(m.pwm / bg))
    with pytest.raises(ValueError):
        m.log_odds(mode="other")
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, ""]
    flip = str.maketrans("ACGT", "TGCA")
    for both in (True, False):
        for least in (1.0, 3.0, 5.0):
            s = m.log_odds()
            score = lambda w: sum(s[i]["ACGT".index(b)] for i, b in enumerate(w))  # noqa: B023, E731
            hit = lambda t: any(score(w) >= least for x in ((t, t[::-1].translate(flip)) if both else (t,)) for w in (x[i : i + 4] for i in range(len(x) - 3)) if "N" not in w)  # noqa: B023, E731
            assert {i for _, f in motifs.find_motifs(seqs, [(s, least)], both) for i in f} == {i for i, t in enumerate(seqs) if t and hit(t)}
    (tmp_path / "g.fa").write_text(">chr1\nTTTTTACGTTTTTT\n")
    chunks = formats.fasta_chunks(spark, str(tmp_path / "g.fa"))
    names = spark.createDataFrame([("chr1:5-9",), ("chr1:6-9",), ("chr1:0-4",), ("chrX:0-4",)], "region string")
    near = dict(p_value=4.0**-4 * 1.01, both=False, background="even", chunks=chunks)
    exact = [motifs.Motif("acgt", np.eye(4))]
    assert got(motifs.scan_motifs(names, exact, **near)) == [("chr1:5-9", "acgt")]
    assert got(motifs.scan_motifs(names, exact, coordinates="1-based", **near)) == [("chr1:6-9", "acgt")] or got(motifs.with_sequences(names, chunks, "1-based"))[1][1] == "TACGT"[:5]
    assert motifs.background_of("subject", spark.createDataFrame([("AAC",), ("GTN",)], "seq string")) == pytest.approx([0.4, 0.2, 0.2, 0.2])
    for bad in (dict(chunks=None), dict(chunks=chunks, background="other"), dict(chunks=chunks, background=(1, 0, 0, 0)), dict(chunks=chunks, coordinates="2-based")):
        with pytest.raises(ValueError):
            motifs.scan_motifs(names, exact, **bad)
    bias = {r.region: (r.gc_content, r.cpg_density) for r in motifs.peak_bias(names, chunks, cpg=True).collect()}
    assert bias["chr1:5-9"] == (0.5, 0.25) and bias["chrX:0-4"] == (0, 0)


def test_enrichment_folds_and_backgrounds(spark):
    hits = spark.createDataFrame([(1, "a"), (2, "a"), (9, "a"), (8, "b"), (1, "c")], "region int, motif string")
    targets = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 3), ("h", 4)], "group string, region int")
    pool = spark.createDataFrame([(i,) for i in (3, 4, 5, 8, 9)], "region int")
    names = spark.createDataFrame([(m,) for m in "abcd"], "motif string")
    out = {(r.group, r.motif): r for r in motifs.motif_enrichment(hits, targets, pool, names=names).collect()}
    assert len(out) == 8 and out["g", "a"].log2_fc == pytest.approx(math.log2((2 / 3) / (1 / 5)))
    assert out["g", "b"].log2_fc == -math.inf and out["g", "c"].log2_fc == math.inf and out["g", "d"].log2_fc == 0 and out["g", "d"].p_value == 1
    assert out["g", "a"].p_value == pytest.approx(3 * 0.2**2 * 0.8 + 0.2**3) and out["g", "b"].p_value == pytest.approx(0.8**3) and out["g", "c"].p_value == pytest.approx(3e-10, rel=1e-6)
    own = {(r.group, r.motif): r for r in motifs.motif_enrichment(hits, targets).collect()}
    assert own["h", "a"].n_all == 4 and own["h", "a"].log2_fc == -math.inf and own["h", "a"].p_value == pytest.approx(1 / 6)
    each = pool.withColumn("group", F.explode(F.array(F.lit("g"), F.lit("h")))).filter("group = 'g' or region < 6")
    by = {(r.group, r.motif): (r.n_hit, r.n_all) for r in motifs.motif_enrichment(hits, targets, each).collect()}
    assert by["g", "a"] == (1, 5) and by["h", "a"] == (0, 3)
    for bad in (each.filter("group = 'g'"), pool.limit(0)):
        with pytest.raises(ValueError):
            motifs.motif_enrichment(hits, targets, bad)
    with pytest.raises(ValueError):
        motifs.motif_enrichment(hits, targets, pool, "other")


def test_matched_sampling(spark):
    rng = np.random.default_rng(4)
    pool = spark.createDataFrame([(f"p{i}", float(v)) for i, v in enumerate(rng.uniform(0, 1, 600))], "region string, gc double")
    targets = spark.createDataFrame([(f"t{i}", float(v)) for i, v in enumerate(rng.normal(0.7, 0.03, 150))], "region string, gc double")
    value = {r.region: r.gc for r in pool.collect()}
    for replace, n in ((True, 400), (False, 150), (True, None)):
        out = motifs.sample_matched(targets, pool, ("gc",), n_samples=n, replace=replace).collect()
        assert len(out) == (n or 150) == len({r.sample for r in out})
        assert np.mean([value[r.region] for r in out]) == pytest.approx(0.7, abs=0.03)
        assert replace or len({r.region for r in out}) == 150
    assert len({r.region for r in motifs.sample_matched(targets, pool, ("gc",), n_samples=600, n_bins=1, replace=False).collect()}) == 600
    assert got(motifs.sample_matched(targets, pool, ("gc",), seed=1)) == got(motifs.sample_matched(targets, pool, ("gc",), seed=1)) != got(motifs.sample_matched(targets, pool, ("gc",), seed=2))
    for bad in (dict(n_samples=0), dict(n_bins=0), dict(n_samples=601, replace=False)):
        with pytest.raises(ValueError):
            motifs.sample_matched(targets, pool, ("gc",), **bad)
    with pytest.raises(ValueError):
        motifs.sample_matched(targets, pool, ("missing",))
    with pytest.raises(ValueError):
        motifs.check_bias(pool.withColumn("gc", F.lit(None).cast("double")), ("gc",))
    seqs = spark.createDataFrame([(i, "GC" * (i % 10) + "AT" * (10 - i % 10), "x" if i < 20 else "y") for i in range(200)], "region int, seq string, group string")
    out = motifs.matched_background(seqs.filter("region < 40"), seqs.drop("group"), 30).collect()
    assert {r.group for r in out} == {"x", "y"} and len(out) == 60 and all(r.region >= 20 if r.group == "x" else r.region < 20 or r.region >= 40 for r in out)
    with pytest.raises(ValueError):
        motifs.matched_background(seqs.drop("group"), seqs.drop("group"))


def test_background_of_features(spark):
    bias = spark.createDataFrame([(i, i / 10, 10 + i) for i in range(8)], "feature int, gc_content double, reads long")
    out = motifs.sample_background(bias, n_iterations=10).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.collect_set("background").alias("b")).collect()
    assert all(r.n == 10 and set(r.b) == set(range(8)) - {r.feature} for r in out) and len(out) == 8
    grid = motifs.sample_background(bias, method="grid", n_iterations=300, bs=4, w=0.2)
    assert grid.count() == 2400 and {r.iteration for r in grid.collect()} == set(range(300))
    with pytest.raises(ValueError):
        motifs.sample_background(bias.withColumn("reads", F.lit(0)))
    with pytest.raises(ValueError):
        motifs.sample_background(bias, method="other")


def test_deviations_by_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.poisson(0.4, (15, 30))
    x[:, 3] = 0
    x[4] = 0
    sets = {f"m{k}": sorted(rng.choice(30, 4, replace=False).tolist()) for k in range(5)} | {"idle": [3]}
    draws = rng.integers(0, 30, (30, 6))
    draws[:, 5] = 3
    frame = spark.createDataFrame([(c, f, int(v)) for (c, f), v in np.ndenumerate(x) if v], "cell int, feature int, value long")
    mf = spark.createDataFrame([(m, f) for m, fs in sets.items() for f in fs], "motif string, feature int")
    bg = spark.createDataFrame([(f, i, int(draws[f, i])) for f in range(30) for i in range(6)], "feature int, iteration int, background int")
    got_ = {(r.cell, r.motif): (r.deviation, r.z) for r in deviations.compute_deviations(frame, mf, bg).collect()}
    share, depth = x.sum(0) / x.sum(), x.sum(1)

    def dev(c, fs):
        e = depth[c] * share[fs].sum()
        return (x[c, fs].sum() - e) / e if e > 0 else 0.0

    want = {}
    for c in range(15):
        for m, fs in sets.items():
            if depth[c]:
                own, others = dev(c, fs), np.array([dev(c, draws[fs, i]) for i in range(6)])
                want[c, m] = (own, (own - others.mean()) / others.std() if others.std() > 1e-12 else 0.0)
    assert got_.keys() == want.keys() and all(got_[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_ranked_set_statistics(spark):
    rng = np.random.default_rng(6)
    rows = [(f"t{i}", float(rng.normal()), rng.normal(size=20).tolist()) for i in range(12)] + [("t90", 1.5, [1.5, 2.0]), ("t91", 1.5, [-1.5])]
    df = spark.createDataFrame([(t, 5, 0.1, n, 0.2, z) for t, n, z in rows], "term string, size long, es double, nes double, p_value double, null array<double>")
    out = {r.term: r.fdr for r in gsea._discovery_rates(df).collect()}
    null, seen = np.concatenate([z for _, _, z in rows]), np.array([n for _, n, _ in rows])
    for t, n, _ in rows:
        sign = 1 if n >= 0 else -1
        a, b = sign * null, sign * seen
        a, b = (a[null >= 0], b[seen >= 0]) if n >= 0 else (a[null < 0], b[seen < 0])
        assert out[t] == pytest.approx(min(1, (a >= abs(n)).mean() / (b >= abs(n)).mean()))
    ranking = spark.createDataFrame([(i, 100.0 - i) for i in range(200)], "feature int, score double")
    sets = spark.createDataFrame([("top", i) for i in range(20)] + [("spread", i * 10) for i in range(20)] + [("small", 1)], "term string, feature int")
    res = {r.term: r for r in gsea.prerank(ranking, sets, permutations=200).collect()}
    assert set(res) == {"top", "spread"} and res["top"].p_value == 0 and res["top"].nes > 1.5 and res["top"].fdr < 0.05 and res["spread"].p_value > 0.05
    assert [r.term for r in gsea.motif_gsea(ranking, sets.select(F.col("feature").alias("region"), F.col("term").alias("motif")), permutations=50).collect()] == ["top", "spread"]


def test_default_embedding_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(7)
    centers = rng.random((6, 300)) < 0.15
    dense = ((rng.random((240, 300)) < 0.1) | centers[rng.integers(0, 6, 240)]).astype(int)
    x = spark.createDataFrame([(int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(dense) if v], "cell int, feature int, value int")
    out = {r.cell: r.embedding for r in embed.spectral(x, 5).collect()}
    df = dense.sum(0)
    w = dense * np.log(240 / np.where(df >= 240, 239, np.maximum(df, 1)))
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    d = w @ w.sum(0) - 1
    values, vectors = np.linalg.eigh(w @ w.T / np.sqrt(np.outer(d, d)) - np.diag(1 / d))
    lead = np.argsort(-np.abs(values))[:5]
    lead = [i for i in lead[np.argsort(-values[lead])] if values[i] > 0]
    mine = np.array([out[i] for i in range(240)])
    assert np.abs(mine) == pytest.approx(np.abs(vectors[:, lead] * np.sqrt(values[lead])), abs=1e-5)
    even = x.select("feature").distinct().withColumn("weight", F.lit(1.0))
    assert len(embed.spectral(x, 3, feature_weights=even).first().embedding) == 3


def test_topics_of_two_kinds_of_cells(spark):
    rng = random.Random(8)
    x = spark.createDataFrame([(c, f"f{(c % 2) * 20 + j:02}", rng.randint(1, 4)) for c in range(60) for j in rng.sample(range(20), 12)], "cell int, feature string, value int")
    model = embed.Topics(2, max_iter=30, seed=1)
    with pytest.raises(ValueError):
        model.transform(x)
    side = {r.cell: r.topics[0] > 0.5 for r in model.fit_transform(x).collect()}
    assert len({side[c] for c in range(0, 60, 2)}) == 1 and all(side[c] != side[0] for c in range(1, 60, 2))
    tops = {}
    for r in model.top_peaks(5).collect():
        tops.setdefault(r.topic, set()).add(int(r.feature[1:]) // 20)
    assert sorted(map(tuple, tops.values())) == [(0,), (1,)]
    sums = {r.topic: r.s for r in model.weights().groupBy("topic").agg(F.sum("weight").alias("s")).collect()}
    assert list(sums.values()) == pytest.approx([1, 1])
    assert model.transform(x.filter("cell < 4").unionByName(spark.createDataFrame([(0, "unseen", 3)], x.schema))).count() == 4


def test_marker_filters(spark):
    cells = spark.createDataFrame([(f"c{i}", "a" if i < 10 else "b") for i in range(20)], "cell string, group string")
    rows = [(f"c{i}", "up", 1) for i in range(10)] + [(f"c{i}", "even", 2) for i in range(20)] + [("c3", "rare", 1)]
    out = {r.feature: r for r in markers.marker_peaks(spark.createDataFrame(rows, "cell string, feature string, value int"), cells, ["a", "b"], min_pct=0.2).collect() if r.group == "a"}
    assert set(out) == {"up"} and (out["up"].fg, out["up"].bg) == (10, 0) and out["up"].log2_fc == pytest.approx(math.log2(11))
    assert out["up"].p_value == pytest.approx(2 * 0.1**10, rel=1e-6)
