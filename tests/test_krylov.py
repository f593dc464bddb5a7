"""The distributed block iteration against dense factorizations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embed, krylov
from tessera.session import bucketed


def dense_product(spark, a):
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(len(a)) for j in range(len(a)) if a[i, j]], "cell long, other long, v double")

    def product(last, width):
        q = last.select(F.col("cell").alias("other"), "q")
        sums = cells.join(q, "other").groupBy("cell").agg(*[F.sum(F.col("v") * F.get("q", F.lit(i))).alias(f"s{i}") for i in range(width)])
        return last.join(sums, "cell", "left").select("cell", F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(width)]).alias("w"))

    return product


@pytest.mark.parametrize("case", ["repeated", "low rank", "negative", "zero"])
def test_pairs_of_hard_matrices(spark, tmp_path, case):
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    values = {"repeated": [3] * 9 + [1] * 21, "low rank": [5, 4, 3] + [0] * 27, "negative": [-9, 8, -7, 6, *rng.normal(size=26) * 0.1], "zero": [0] * 30}[case]
    a = turn @ np.diag(np.array(values, float)) @ turn.T
    a = (a + a.T) / 2
    rows = spark.createDataFrame([(i, 1.0) for i in range(30)], "cell long, degree double").repartition(3)
    basis, got, vectors = krylov.leading(rows, "cell", 30, 4, dense_product(spark, a), str(tmp_path / "k"), seed=3)
    want = sorted(values, key=abs, reverse=True)[: len(got)]
    assert got == pytest.approx(sorted(want, reverse=True), abs=1e-6) and (len(got) == 4 or case in ("low rank", "zero"))
    table = {r.cell: np.array(r.q) @ vectors for r in basis.collect()}
    v = np.array([table[i] for i in range(30)])
    assert v.T @ v == pytest.approx(np.eye(v.shape[1]), abs=1e-9)
    assert np.linalg.norm(a @ v - v * got, axis=0) == pytest.approx(0, abs=1e-6 * max(1, abs(got).max()))


def test_triangles_of_tasks_make_one(spark):
    rng = np.random.default_rng(2)
    w = rng.normal(size=(400, 5))
    w[:, 4] = w[:, 0] + 1e-9 * rng.normal(size=400)
    df = spark.createDataFrame([([], r.tolist()) for r in w], "q array<double>, w array<double>").repartition(7)
    r = krylov.triangle(df, 5, lambda q, w: w)
    assert r.T @ r == pytest.approx(w.T @ w, rel=1e-12)
    assert np.linalg.svd(r)[1] == pytest.approx(np.linalg.svd(w)[1], rel=1e-6)
    assert krylov.summed(df, (5, 5), lambda q, w: w.T @ w) == pytest.approx(w.T @ w)


def test_the_matrix_is_dealt_out_once(spark):
    x = spark.createDataFrame([(i % 50, f"f{i % 7}", 1.0) for i in range(500)], "cell long, feature string, v double")
    tables = []
    try:
        by_cell, by_feature = (bucketed(x, c, tables) for c in ("cell", "feature"))
        last = spark.createDataFrame([(i, 1.0, [1.0, 2.0]) for i in range(50)], "cell long, degree double, q array<double>")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = embed._affinity(by_cell, by_feature)(last, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in tables:
            spark.sql(f"drop table {t}")
    for line, text in ((k, t) for k, t in enumerate(plan.split("\n")) if "Scan parquet" in t):
        above = plan.split("\n")[max(0, line - 4) : line]
        assert not any("Exchange" in t for t in above), text


def test_nothing_is_left_behind(spark, tmp_path):
    from tessera.session import shared_dir

    import os

    before = {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("spectral-")}
    x = spark.createDataFrame([(i % 9, i % 5, 1 + i % 3) for i in range(45)] + [(i, 9, 1) for i in range(4)], "cell int, feature int, value int")
    assert embed.spectral(x, 2).count() == 9
    assert {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("spectral-")} == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_")]
    with pytest.raises(ValueError):
        embed.spectral(spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "cell int, feature int, value int"), 1)
