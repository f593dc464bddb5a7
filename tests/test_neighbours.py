"""The k-NN join against all pairs."""

import numpy as np
import pytest

from tessera.operators import neighbours


def plain(points, queries, k):
    out = []
    for name, *q in queries:
        if q[0] is None or any(v != v for v in q):
            continue
        d = sorted({(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(q, p, strict=True)))), key) for key, *p in points if key != name and p[0] is not None and all(v == v for v in p)})
        out += [(name, key, dist, i + 1) for i, (dist, key) in enumerate(d[:k])]
    return sorted(out)


def found(spark, points, queries, k, dim, kind):
    schema = f"feature {kind}, " + ", ".join(f"c{i} double" for i in range(dim))
    p, q = spark.createDataFrame(points, schema), spark.createDataFrame(queries, schema)
    rows = neighbours.nearest(p, q, tuple(f"c{i}" for i in range(dim)), k).collect()
    return sorted((r.query, r.feature, r.distance, r["rank"]) for r in rows)


@pytest.mark.parametrize("dim", [1, 2, 5])
@pytest.mark.parametrize("size", [8, 4096])
def test_against_all_pairs(spark, monkeypatch, dim, size):
    """Clusters, lattices with ties, a third of one place, questions beside no point, missing numbers."""
    monkeypatch.setattr(neighbours, "SIZE", size)
    monkeypatch.setattr(neighbours, "PAIRS", 100)
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.normal(size=(60, dim)), rng.integers(0, 3, (60, dim)), np.full((60, dim), 1.0), rng.normal(50, 1, (10, dim))])
    points = [(i, *map(float, r)) for i, r in enumerate(x)] + [(900, *[None] * dim), (901, *[float("nan")] * dim), (902, *[-0.0] * dim)]
    queries = points[::3] + points[125:150] + [(5000 + i, *map(float, r)) for i, r in enumerate(rng.normal(0, 30, (10, dim)))] + points[-3:]
    queries = list({q[0]: q for q in queries}.values())
    got, want = found(spark, points, queries, 7, dim, "long"), plain(points, queries, 7)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-12)


def test_cells_that_the_sample_missed_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SIZE", 16)
    monkeypatch.setattr(neighbours, "SAMPLE", 20)
    rng = np.random.default_rng(1)
    points = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([rng.normal(size=(150, 2)), rng.normal(9, 0.01, (150, 2))]))]
    queries = points[:100] + [(f"q{i}", 9.0, 9.0 + i * 1e-4) for i in range(100)]
    assert found(spark, points, queries, 5, 2, "string") == plain(points, queries, 5)


def test_few_points_and_empty_tables(spark):
    points = [("a", 0.0), ("b", 1.0)]
    assert found(spark, points, points, 5, 1, "string") == [("a", "b", 1.0, 1), ("b", "a", 1.0, 1)]
    assert found(spark, [], points, 5, 1, "string") == [] and found(spark, points, [], 5, 1, "string") == []
