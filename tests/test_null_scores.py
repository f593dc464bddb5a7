"""Null scores shared by sets of a size, against plain draws."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import gsea


def mixed(place, draw, seed):
    x = (place % gsea.PRIME * 1103515245 + draw * 69621 + seed % gsea.PRIME * 16807 + 12345) % gsea.PRIME
    y = (x * x + draw) % gsea.PRIME
    z = (y * 48271 + x) % gsea.PRIME
    return (z * z + y) % gsea.PRIME


def score(places, r):
    n, total, at, ends = len(r), sum(r[p] for p in places), 0.0, [0.0]
    for p in range(n):
        at += r[p] / total if p in places else -1 / (n - len(places))
        ends.append(at)
    return max(ends) if max(ends) > -min(ends) else min(ends)


@pytest.mark.parametrize("n,sizes", [(400, [15, 17, 40]), (60, [15, 60])])
def test_null_scores(spark, n, sizes):
    rng = random.Random(n)
    r = [rng.random() + 0.01 for _ in range(n)]
    ranked = spark.createDataFrame(list(enumerate(r)), "place long, r double").repartition(5)
    got = sorted((x.size, round(x.null, 9)) for x in gsea.null_scores(ranked, sizes, n, 8, seed=3).select("size", "null").toPandas().itertuples())
    want = []
    for t in range(8):
        order = sorted(range(n), key=lambda p: (mixed(p, t, 3), p))
        want += [(s, round(score(set(order[:s]), r), 9)) for s in sizes if s < n]
    assert [g for g in got if g[0] < n] == sorted(want) and len(got) == 8 * len(sizes)


def test_draws_are_even_and_unlike(spark):
    """Each place is as likely as any other, and draws share no more than chance."""
    rows = spark.range(1000).select(F.col("id").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(299))).alias("t"))
    low = rows.filter(gsea.mixed(F.col("place"), F.col("t"), 0) < gsea.PRIME // 10)
    by_place = [r["count"] for r in low.groupBy("place").count().collect()]
    by_draw = {t: {r.place for r in g} for t, g in ((t, [r for r in low.collect() if r.t == t]) for t in range(20))}
    assert len(by_place) == 1000 and 10 <= min(by_place) and max(by_place) <= 55
    shared = [len(by_draw[a] & by_draw[b]) for a in range(20) for b in range(a)]
    assert 5 < sum(shared) / len(shared) < 15 and max(shared) < 30


def test_sets_of_one_size_share_their_scores(spark):
    ranking = spark.createDataFrame([(i, 100.0 - i) for i in range(200)], "feature int, score double")
    sets = spark.createDataFrame([(t, i * k % 200) for t, k in (("a", 1), ("b", 1), ("c", 7)) for i in range(20)], "term string, feature int")
    rows = {r.term: r for r in gsea.prerank(ranking, sets, permutations=100).collect()}
    assert rows["a"][1:] == rows["b"][1:] and rows["a"].p_value == 0 < rows["c"].p_value
    assert gsea.prerank(ranking, sets, min_size=21).count() == 0
