"""Costs of peak calling that must not grow with the depth of coverage."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tessera.functions.stats import poisson_tails
from tessera.operators import peaks


def exact_upper(k, m):
    """Sums whole tails by the ratio of neighbours, from the chance at the end next to the mean."""
    up = k + 1 > m
    x = k + 1 if up else k
    term = part = 1.0
    at = x
    while term > 1e-20 * part and at >= 0:
        term *= m / (at + 1) if up else at / m
        at += 1 if up else -1
        part += term
    # Exact logarithms of the parts cancel, so they are summed as fractions.
    log = float(x * Fraction(math.log(m)) - Fraction(m) - Fraction(math.lgamma(x + 1.0)))
    side = part * math.exp(log)
    return side if up else 1 - side


@pytest.mark.parametrize("m", [1e-9, 0.3, 1.0, 2.5, 17.0, 60.2, 700.3, 15400.7, 250000.0])
def test_tails_of_any_mean(m):
    k = np.unique(np.clip(np.floor(m + np.array([-9, -4, -1, -0.1, 0, 0.1, 1, 4, 9, 20]) * math.sqrt(m + 1)), 0, None))
    want = [exact_upper(int(x), m) for x in k]
    assert poisson_tails(k, np.full(len(k), m)) == pytest.approx(want, rel=1e-8, abs=1e-290)


def test_no_terms_of_deep_runs(spark):
    """Runs are scored in place: no series over terms whose number grows with the rate, and no join with pairs."""
    runs = spark.createDataFrame([(1, "chr1", 0, 10, 15000, 770000), (1, "chr1", 10, 20, 0, 3)], "group int, chrom string, start long, end long, treat long, ctrl long")
    frags = spark.createDataFrame([(1, "chr1", 0, 10)], "group int, chrom string, start long, end long")
    scored = peaks.score_runs(runs, frags, 1e6)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and plan.count("Join") == 1
    got = {r.treat: r.p_score for r in scored.collect()}
    assert got[15000] == pytest.approx(-math.log10(exact_upper(15000, 15400.0)), rel=1e-9)
    assert got[0] == pytest.approx(-math.log10(exact_upper(0, 0.06)), rel=1e-9)
