"""Tails against exact arithmetic, and ranks over ranges against plain sorting."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.functions import ranks, stats
from tessera.functions.ranks import along


def values(spark, rows, kinds, column):
    return [r.v for r in spark.createDataFrame(rows, kinds).select(column.alias("v")).collect()]


def exact_poisson_upper(k, mean):
    """Terms by logarithms to 40 digits, from the far side."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    m = Decimal(str(mean))
    log = -m + Decimal(k + 1) * m.ln()
    if k + 1 <= 3000:
        for i in range(2, k + 2):
            log -= Decimal(i).ln()
    else:
        n = Decimal(k + 1)
        pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")
        log -= n * n.ln() - n + (2 * pi * n).ln() / 2 + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)
    t = s = log.exp()
    i = k + 2
    while t > s * Decimal(10) ** -25:
        t = t * m / i
        s += t
        i += 1
    return float(s)


def test_poisson_tails_at_any_mean(spark):
    rows = [(k, m) for m in (0.1, 3.5, 40.0, 250.0, 1000.0, 12345.6, 1e5, 1e6) for k in {int(m), int(m + 3 * m**0.5), max(0, int(m - 3 * m**0.5)), int(m + 8 * m**0.5), max(0, int(m - 6 * m**0.5))}]
    got = values(spark, rows, "k long, m double", stats.poisson_upper(F.col("k"), F.col("m")))
    assert got == pytest.approx([exact_poisson_upper(k, m) for k, m in rows], rel=1e-9)
    assert values(spark, [(-1, 2.0), (3, 0.0)], "k long, m double", stats.poisson_upper(F.col("k"), F.col("m"))) == [1.0, 0.0]


def test_binomial_tails_on_both_sides(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, n + 1), n, p) for n in (1, 9, 60, 700, 3000) for p in (0.0, 0.01, 0.3, 0.5, 0.97, 1.0) for _ in range(3)]

    def upper(k, n, p):
        p = Fraction(p)
        return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1)))

    want = [upper(k, n, p) for k, n, p in rows if n <= 60]
    small = [r for r in rows if r[1] <= 60]
    kinds = "k long, n long, p double"
    assert values(spark, small, kinds, stats.binomial_upper(F.col("k"), F.col("n"), F.col("p"))) == pytest.approx(want, rel=1e-9, abs=1e-290)
    assert values(spark, small, kinds, stats.binomial_lower(F.col("k") - 1, F.col("n"), F.col("p"))) == pytest.approx([float(1 - Fraction(u)) for u in want], rel=1e-6, abs=1e-12)
    large = [r for r in rows if r[1] > 60]

    def side(k, n, p, above):
        if p in (0.0, 1.0):
            return float((k <= n * p) == above)
        at = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        return math.fsum(math.exp(at(i)) for i in (range(k, n + 1) if above else range(0, k)))

    assert values(spark, large, kinds, stats.binomial_upper(F.col("k"), F.col("n"), F.col("p"))) == pytest.approx([side(*r, True) for r in large], rel=1e-8, abs=1e-280)
    assert values(spark, large, kinds, stats.binomial_lower(F.col("k") - 1, F.col("n"), F.col("p"))) == pytest.approx([side(*r, False) for r in large], rel=1e-8, abs=1e-280)


def test_hypergeometric_tails_on_both_sides(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 12), rng.randint(0, 30), 60, rng.randint(0, 40)) for _ in range(60)] + [(40, 300, 2000, 200), (20, 300, 2000, 200), (0, 5, 10, 8)]

    def upper(k, good, total, draws):
        ways = [math.comb(good, i) * math.comb(total - good, draws - i) if 0 <= draws - i <= total - good else 0 for i in range(good + 1)]
        return float(Fraction(sum(ways[k:]), math.comb(total, draws))), float(Fraction(sum(ways[:k]), math.comb(total, draws)))

    of = [F.col(c) for c in "kgtd"]
    kinds = "k long, g long, t long, d long"
    assert values(spark, rows, kinds, stats.hypergeometric_upper(*of)) == pytest.approx([upper(*r)[0] for r in rows], rel=1e-8, abs=1e-280)
    assert values(spark, rows, kinds, stats.hypergeometric_lower(of[0] - 1, *of[1:])) == pytest.approx([upper(*r)[1] for r in rows], rel=1e-8, abs=1e-280)


def test_ranks_and_running_values_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc") if rng.random() < 0.9 else None, rng.randint(0, 40), i, rng.randint(-5, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, id int, v int")
    for by in ((), ("g",)):
        both = [sorted(map(tuple, along(df, [F.desc("k"), "id"], {"s": ("sum", "v"), "lo": ("min", "v")}, by=by, small=n).collect()), key=str) for n in (0, 1000)]
        assert both[0] == both[1]
        want, run = [], {}
        for r in sorted(rows, key=lambda r: (-r[1], r[2])):
            n, s, lo = run.get(r[0] if by else 0, (0, 0, 99))
            run[r[0] if by else 0] = (n + 1, s + r[3], min(lo, r[3]))
            want.append((*r, *run[r[0] if by else 0]))
        assert both[0] == sorted(want, key=str)
    assert along(df.limit(0), ["id"], small=0).count() == 0


def test_adjusted_p_values_over_ranges(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice("ab"), i, round(rng.random() ** 3, 2)) for i in range(300)], "g string, i int, p double")
    for by in ((), ("g",)):
        one, two = (sorted(map(tuple, stats.benjamini_hochberg(df, "p", "q", by=by, tie=("i",), small=n).collect())) for n in (0, 1000))
        assert [x[:3] for x in one] == [x[:3] for x in two] and [x[3] for x in one] == pytest.approx([x[3] for x in two])
        for g in "ab" if by else [None]:
            mine = sorted((x for x in two if g in (None, x[0])), key=lambda x: x[2])
            want = [min(1, min(y[2] * len(mine) / (j + 1) for j, y in enumerate(mine) if j >= i)) for i in range(len(mine))]
            assert [x[3] for x in mine] == pytest.approx(want)


@pytest.mark.parametrize("size", [1, 7, 1000, 1 << 20])
def test_running_values_over_ranges(spark, size):
    rng = random.Random(6)
    rows = [(k, p, rng.randint(-5, 5)) for k in ("a", None, "c") for p in rng.sample(range(-50, 4000), 90)] + [("one", 5, 3)]
    df = spark.createDataFrame(rows, "key string, at long, v int")
    out = ranks.over_ranges(df, ("key",), "at", sums={"total": "v", "n": F.lit(1)}, before={"prev": "at"}, after={"next": "v"}, size=size)
    got = {(r.key, r.at): (r.v, r.total, r.n, r.prev, r.next) for r in out.collect()}
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        mine = sorted((p, v) for k, p, v in rows if k == key)
        for i, (p, v) in enumerate(mine):
            assert got[key, p] == (v, sum(x for _, x in mine[: i + 1]), i + 1, mine[i - 1][0] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None)


@pytest.mark.parametrize("size", [1000, 37])
def test_peaks_in_small_ranges(spark, monkeypatch, size):
    """Islands and pileups across the borders of ranges are those of whole chromosomes."""
    from tessera.operators import peaks

    rng = random.Random(9)
    rows = [(g, "c", s, s + rng.randint(30, 300)) for g in (0, 1) for s in [rng.randint(0, 20_000) for _ in range(150)] + [rng.randint(7_000, 7_200) for _ in range(120)] + [rng.randint(900, 1_100) for _ in range(120)]]
    frags = spark.createDataFrame(rows, "group int, chrom string, start long, `end` long")
    run = lambda: (sorted(map(tuple, peaks.pileup(frags).collect())), sorted(map(str, peaks.call_peaks(frags, 1e6, peak_amp=100).collect())))
    whole = run()
    monkeypatch.setattr(ranks, "RANGE", size)
    assert run() == whole and len(whole[1]) >= 4
