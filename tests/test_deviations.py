"""Blocked deviations against sums over dense arrays, for blocks of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import deviations, motifs
from tessera.session import stored


def plain(x, sets, names):
    """x: cells by features; sets: {(motif, iteration): {feature: times}}."""
    depth, share = x.sum(1), x.sum(0) / x.sum()
    out = {}
    for motif in {m for m, _ in sets}:
        ratio = {}
        for (m, t), of in sets.items():
            if m == motif:
                js = [names.index(f) for f in of if f in names]
                w = np.array([of[names[j]] for j in js], float)
                want = float((share[js] * w).sum())
                ratio[t] = (x[:, js] * w).sum(1) / (depth * want) if want > 0 else None
        own = ratio.get(-1)
        back = np.array([np.ones(len(x)) if r is None else r for t, r in ratio.items() if t >= 0])
        for c in range(len(x)):
            if depth[c] > 0:
                dev = 0.0 if own is None else own[c] - 1
                sd = back[:, c].std() if len(back) else 0.0
                out[c, motif] = (dev, (dev - (back[:, c].mean() - 1)) / sd if sd > 1e-12 else 0.0)
    return out


@pytest.mark.parametrize("sizes", [(1 << 23, 4096, 1024, 1 << 21), (6, 3, 2, 5), (1, 1, 1, 1)])
def test_any_blocks(spark, monkeypatch, sizes):
    for name, n in zip(("ENTRIES", "CELLS", "SETS", "PAIRS"), sizes, strict=True):
        monkeypatch.setattr(deviations, name, n)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (7, 12)) * (rng.random((7, 12)) < 0.5)
    x[:, 0] = 3  # a feature of every cell
    x[4] = 0  # a cell without reads
    x[:, 11] = 0  # a feature without reads
    names = [f"f{j}" for j in range(12)]
    mf = [("m1", f"f{j}") for j in (0, 2, 5)] + [("m2", "f3"), ("m3", "f11"), ("m4", "elsewhere")]
    bg = [(f"f{j}", t, f"f{rng.integers(12)}") for j in range(12) for t in range(3)] + [("elsewhere", 0, "f1"), ("elsewhere", 1, "nowhere")]
    sets = {}
    for m, f in mf:
        for t, g in [(-1, f)] + [(t, g) for h, t, g in bg if h == f]:
            of = sets.setdefault((m, t), {})
            of[g] = of.get(g, 0) + 1
    frame = spark.createDataFrame([(i, names[j], int(x[i, j])) for i in range(7) for j in range(12) if x[i, j] or j == 11], "cell int, feature string, value int")
    out = deviations.compute_deviations(frame, spark.createDataFrame(mf, "motif string, feature string"), spark.createDataFrame(bg, "feature string, iteration int, background string"))
    got = {(r.cell, r.motif): (r.deviation, r.z) for r in out.collect()}
    want = plain(x, sets, names)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_no_row_holds_all_features(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(deviations, "stored", lambda df, *a, **b: kept.append(stored(df, *a, **b)) or kept[-1])
    monkeypatch.setattr(deviations, "ENTRIES", 50)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (3, 300))
    x[0] += 1
    names = [f"f{j}" for j in range(300)]
    mf = [("m1", f"f{j}") for j in range(0, 300, 2)] + [("m2", f"f{j}") for j in range(0, 300, 3)]
    bg = [(f"f{j}", t, f"f{rng.integers(300)}") for j in range(300) for t in range(4)]
    sets = {}
    for m, f in mf:
        for t, g in [(-1, f)] + [(t, g) for h, t, g in bg if h == f]:
            of = sets.setdefault((m, t), {})
            of[g] = of.get(g, 0) + 1
    frame = spark.createDataFrame([(i, names[j], int(x[i, j])) for i in range(3) for j in range(300)], "cell int, feature string, value int")
    out = deviations.compute_deviations(frame, spark.createDataFrame(mf, "motif string, feature string"), spark.createDataFrame(bg, "feature string, iteration int, background string"))
    got, want = {(r.cell, r.motif): (r.deviation, r.z) for r in out.collect()}, plain(x, sets, names)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    lists = [(df, c) for df in kept for c, kind in df.dtypes if kind.startswith("array")]
    assert lists and all(df.agg(F.max(F.size(c))).first()[0] <= 2 for df, c in lists)


def test_sequences_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def letters(i):
        made.add(1)
        return ("GATTACA" if i % 3 else "CCGCGG") * (1 + i % 5) + "ACGT"[i % 4] * (i % 7)

    # Two columns that read a sequence, and a scan of it, ask for it once a region.
    regions = spark.range(40).select(F.col("id").alias("region"), F.udf(letters)("id").alias("seq"))
    x = spark.range(40).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("cell"), F.col("id").alias("feature"), (F.col("id") % 5 + 1).alias("value"))
    out = deviations.chromvar(x, regions, [motifs.Motif("m", np.eye(4)[[2, 0, 3, 3, 0, 1, 0]])], p_value=4.0**-7 * 1.01, n_iterations=4, base="even").collect()
    assert {(r.cell, r.motif) for r in out} == {(0, "m"), (1, "m")}
    assert made.value == 40


def test_sequences_come_in_small_batches(spark, monkeypatch):
    given = []
    monkeypatch.setattr(deviations, "stored", lambda df, *a, **b: given.append(b.get("batch")) or stored(df, *a, **b))
    regions = spark.range(9).select(F.col("id").alias("region"), F.repeat(F.lit("GATTACA"), F.col("id").cast("int") + 1).alias("seq"))
    x = spark.range(9).select(F.lit(0).alias("cell"), F.col("id").alias("feature"), (F.col("id") % 5 + 1).alias("value"))
    assert deviations.chromvar(x, regions, [motifs.Motif("m", np.eye(4)[[2, 0, 3]])], p_value=4.0**-3 * 1.01, n_iterations=2, base="even").count() == 1
    assert deviations.SEQUENCES in given
    sizes = stored(spark.range(0, 100, 1, 1).mapInPandas(lambda frames: (f.assign(id=len(f)) for f in frames), "id long"), batch=8)
    assert sizes.agg(F.max("id")).first()[0] == 8


def test_words_of_a_long_motif(spark):
    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.24, 0.24, 0.24, 0.24, 0.04])) for n in rng.integers(0, 60, 300)] + [None, ""]
    for length in (1, 5, 6, 7, 12, 13, 20):
        scores = rng.integers(-3, 3, (length, 4)).astype(float)
        least = np.quantile([scores[np.arange(length), rng.integers(0, 4, length)].sum() for _ in range(2000)], 0.97)
        code = {b: i for i, b in enumerate("ACGT")}
        total = lambda t, w: sum(t[i, code[b]] if b in code else -np.inf for i, b in enumerate(w))
        want = [i for i, s in enumerate(seqs) if any(total(t, (s or "")[a : a + length]) >= least for t in (scores, scores[::-1, ::-1]) for a in range(len(s or "") - length + 1))]
        assert [f.tolist() for _, f in motifs.find_motifs(seqs, [(scores, least)])] == [want]
