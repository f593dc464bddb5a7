"""What the spectral embedding moves of its matrix."""

import pytest

from tessera.operators import embed
from tessera.session import bucketed


def matrix(spark):
    return spark.createDataFrame([(f"c{i % 40}", f"f{i * i % 23}", 1 + i % 5) for i in range(600)], "cell string, feature string, value long").groupBy("cell", "feature").sum("value").toDF("cell", "feature", "value")


def test_no_entry_moves_in_a_step(spark):
    tables = []
    try:
        x = bucketed(matrix(spark).withColumnRenamed("value", "v"), "cell", tables)
        last = spark.createDataFrame([(f"c{i}", 1.0, [1.0, 2.0]) for i in range(40)], "cell string, degree double, q array<double>")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = embed._affinity(x)(last, 2)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in tables:
            spark.sql(f"drop table {t}")
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    scans = [k for k, s in enumerate(plan) if "Scan parquet" in s]
    assert len(scans) == 2
    for k in scans:
        above, at = [], depth(plan[k])
        for s in reversed(plan[:k]):
            if depth(s) < at:
                above.append(s)
                at = depth(s)
        # Between an entry and the sum that it goes into there is no exchange, and none of them is sorted.
        to_sum = above[: next(i for i, s in enumerate(above) if "HashAggregate" in s)]
        assert not any("Exchange" in s or "Sort" in s for s in to_sum)


def test_few_and_many_features_agree(spark, monkeypatch):
    x = matrix(spark)
    few = {r.cell: r.embedding for r in embed.spectral(x, 3).collect()}
    monkeypatch.setattr(embed, "FEW_FEATURES", 0)
    many = {r.cell: r.embedding for r in embed.spectral(x, 3).collect()}
    assert few.keys() == many.keys() and len(few) == 40
    for c, e in few.items():
        assert e == pytest.approx(many[c], abs=1e-6)
