"""Tail probabilities and multiple testing as column expressions.

Tails start from one probability in saddle-point form, which keeps its digits for means of any size.
Binomial and hypergeometric ones add neighbours by their ratio, away from the mean: so the smaller side
is summed, and as many terms as it takes for the rest to fall below double precision, which grows with
the deviation. Poisson ones are that probability times an integral over a fixed number of nodes, in
batches, so a tail costs the same for means of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .ranks import SMALL, along

TINY = 1e-300
#: Deviations from where a tail starts, and terms at least, beyond which nothing is left of it.
DEVIATIONS, LEAST_TERMS = 10.0, 60
#: Nodes of the integral of a Poisson tail, and minus the log of its integrand at which it ends.
NODES, DEPTH = 40, 38.0

_TABLE = 256


def ln_factorial(n: Column) -> Column:
    """``ln(n!)`` by a table below 256, by Stirling's series beyond."""
    x = F.greatest(n, F.lit(1)).cast("double")
    table = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(_TABLE)])
    return F.when(n < _TABLE, F.get(table, F.greatest(n, F.lit(0)).cast("int"))).otherwise(x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + _series(x))


def _series(x: Column) -> Column:
    return 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))


def _stirling_error(n: Column) -> Column:
    """What Stirling's formula lacks: ``ln(n!) - ln(sqrt(2 pi n) (n / e)^n)``."""
    exact = [0.0] + [math.lgamma(i + 1.0) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]
    small = F.get(F.array(*map(F.lit, exact)), F.greatest(n, F.lit(0)).cast("int"))
    return F.when(n < 16, small).otherwise(_series(F.greatest(n, F.lit(1)).cast("double")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and spelled out once, however often it is used."""
    return F.get(F.transform(F.array(value.cast("double")), lambda x: body(x)), F.lit(0))


def _deviance(x: Column, mean: Column) -> Column:
    """``x ln(x / mean) + mean - x`` without cancellation near the mean."""

    def near(x: Column, m: Column, v: Column) -> Column:
        even = _let(v * v, lambda w: _powers(w))
        return (x - m) * v + 2 * x * v * even

    def _powers(w: Column) -> Column:
        out = F.lit(1.0 / 21)
        for j in range(9, 0, -1):
            out = F.lit(1.0 / (2 * j + 1)) + w * out
        return w * out

    def far(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log(F.greatest(x, F.lit(TINY)) / m)).otherwise(0.0) + m - x

    def both(x: Column, m: Column) -> Column:
        return F.when(F.abs(x - m) < 0.1 * (x + m), _let((x - m) / (x + m), lambda v: near(x, m, v))).otherwise(far(x, m))

    return _let(x, lambda x: _let(F.greatest(mean.cast("double"), F.lit(TINY)), lambda m: both(x, m)))


def poisson(x: Column, mean: Column) -> Column:
    """``P(X = x)``."""
    root = F.sqrt(2 * math.pi * F.greatest(x, F.lit(1)).cast("double"))
    return F.when(x < 0, 0.0).when(x == 0, F.exp(-mean)).otherwise(F.exp(-_stirling_error(x) - _deviance(x, mean)) / root)


def binomial(x: Column, n: Column, p: Column) -> Column:
    """``P(X = x)`` of ``n`` draws."""
    q, rest = 1 - p, n - x
    ends = F.when(x == 0, F.exp(n * F.log1p(-p))).when(rest == 0, F.exp(n * F.log(p)))
    at = _stirling_error(n) - _stirling_error(x) - _stirling_error(rest) - _deviance(x, n * p) - _deviance(rest, n * q)
    inner = F.exp(at) * F.sqrt(n / (2 * math.pi * F.greatest(x, F.lit(1)).cast("double") * F.greatest(rest, F.lit(1))))
    return F.when((x < 0) | (rest < 0), 0.0).when(p <= 0, (x == 0).cast("double")).when(q <= 0, (rest == 0).cast("double")).otherwise(F.coalesce(ends, inner))


def hypergeometric(x: Column, good: Column, total: Column, draws: Column) -> Column:
    """``P(X = x)`` of hits in ``draws`` from ``total`` of which ``good`` hit."""
    p = draws / F.greatest(total, F.lit(1)).cast("double")
    whole = F.greatest(binomial(draws, total, p), F.lit(TINY))
    return binomial(x, good, p) * binomial(draws - x, total - good, p) / whole


def _tails(k: Column, mean: Column, variance: Column, chance: Callable[[Column], Column], up: Callable[[Column], Column], down: Callable[[Column], Column]) -> tuple[Column, Column]:
    """``P(X >= k)`` and ``P(X < k)``; ``up`` and ``down`` are the ratios of the next chances to that of x."""
    above = k > mean
    start = F.when(above, k).otherwise(k - 1).cast("double")
    first = _let(F.when(above, k).otherwise(k - 1), chance)
    terms = F.ceil(DEVIATIONS * F.sqrt(variance + 10) + LEAST_TERMS).cast("int")

    def step(a: Column, _: Column) -> Column:
        t = a["t"] * F.when(a["up"], up(a["x"])).otherwise(down(a["x"]))
        return F.struct((a["x"] + F.when(a["up"], 1.0).otherwise(-1.0)).alias("x"), t.alias("t"), (a["s"] + t).alias("s"), a["up"].alias("up"))

    begin = F.get(F.transform(F.array(first), lambda t: F.struct(start.alias("x"), t.alias("t"), t.alias("s"), above.alias("up"))), F.lit(0))
    side = F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(1), terms), begin, step)["s"])
    return _let(side, lambda s: F.when(above, s).otherwise(1 - s)), _let(side, lambda s: F.when(above, 1 - s).otherwise(s))


def _chances(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``P(X = x)`` of Poisson means, as in ``poisson``."""
    at = np.maximum(x, 1.0)
    exact = np.array([0.0] + [math.lgamma(i + 1.0) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)])
    lack = np.where(x < 16, exact[np.minimum(x, 15).astype(int)], 1 / (12 * at) - 1 / (360 * at**3) + 1 / (1260 * at**5) - 1 / (1680 * at**7))
    v = (at - m) / (at + m)
    even = 1.0 / 21
    for j in range(9, 0, -1):
        even = 1.0 / (2 * j + 1) + v * v * even
    deviance = np.where(np.abs(v) < 0.1, (at - m) * v + 2 * at * v * (v * v * even), at * np.log(at / m) + m - at)
    return np.where(x > 0, np.exp(-lack - deviance) / np.sqrt(2 * math.pi * at), np.exp(-m))


def poisson_tails(k: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``P(X > k)`` for ``k`` of at least 0 and positive means, each by the smaller side.

    With K = k + 1, ``P(X >= K)`` is ``P(X = K) K`` times the integral of ``(1 - u)^k e^(m u)`` from 0 to 1, and
    ``P(X < K)`` is ``P(X = k) m`` times that of ``(1 + u)^k e^(-m u)`` from 0 on. Both integrands fall like an
    exponential or a normal curve, and what lies beyond the place where they are below ``e^-DEPTH`` is nothing.
    """
    k, m = np.asarray(k, float), np.maximum(np.asarray(m, float), TINY)
    above = k + 1 > m
    sign, apart = np.where(above, -1.0, 1.0), np.where(above, k - m, m - k)
    # log(1 - u) <= -u - u^2 / 2, and log(1 + u) <= u - u^2 / (2 + 2 u).
    high = 2 * DEPTH / np.maximum(apart + np.sqrt(apart * apart + 2 * k * DEPTH), DEPTH * 2)
    far = np.maximum(apart, 1.0)
    low = (DEPTH - far + np.sqrt((DEPTH - far) ** 2 + 2 * DEPTH * (2 * far + k))) / (2 * far + k)
    end = np.where(above, high, low)
    whole = np.zeros_like(m)
    for y, weight in zip(*np.polynomial.legendre.leggauss(NODES), strict=True):
        u = sign * end * ((y + 1) / 2)
        whole += weight * np.exp(k * np.log1p(u) - m * u)
    whole *= end / 2
    side = np.minimum(1.0, np.where(above, _chances(k + 1, m) * (k + 1), _chances(k, m) * m) * whole)
    return np.where(above, side, 1 - side)


@F.pandas_udf(T.DoubleType())
def _poisson_upper(k: pd.Series, mean: pd.Series) -> pd.Series:
    fit = ((k >= 0) & (mean > 0)).to_numpy()
    out = np.zeros(len(fit))
    out[fit] = poisson_tails(k.to_numpy(float)[fit], mean.to_numpy(float)[fit])
    return pd.Series(out)


def poisson_upper(k: Column, mean: Column) -> Column:
    """``P(X > k)``."""
    tail = F.when(k.isNotNull() & mean.isNotNull(), _poisson_upper(k.cast("double"), mean.cast("double")))
    return F.when(k < 0, F.lit(1.0)).when(mean <= 0, F.lit(0.0)).otherwise(tail)


def _binomial_tails(k: Column, n: Column, p: Column) -> tuple[Column, Column]:
    p = p.cast("double")
    odds = F.greatest(p, F.lit(TINY)) / F.greatest(1 - p, F.lit(TINY))
    up = lambda x: F.greatest(n - x, F.lit(0.0)) / (x + 1) * odds
    down = lambda x: F.greatest(x, F.lit(0.0)) / F.greatest(n - x + 1, F.lit(TINY)) / odds
    upper, lower = _tails(k, n * p, n * p * (1 - p), lambda x: binomial(x, n, p), up, down)
    always, never = (k <= 0) | (p >= 1) & (k <= n), (k > n) | (p <= 0)
    return F.when(always, 1.0).when(never, 0.0).otherwise(upper), F.when(always, 0.0).when(never, 1.0).otherwise(lower)


def binomial_upper(k: Column, n: Column, p: Column) -> Column:
    """``P(X >= k)`` of ``n`` draws."""
    return _binomial_tails(k, n, p)[0]


def binomial_lower(k: Column, n: Column, p: Column) -> Column:
    """``P(X <= k)`` of ``n`` draws."""
    return _binomial_tails(k + 1, n, p)[1]


def _hypergeometric_tails(k: Column, good: Column, total: Column, draws: Column) -> tuple[Column, Column]:
    share = good / F.greatest(total, F.lit(1)).cast("double")
    bad = total - good
    up = lambda x: F.greatest(good - x, F.lit(0.0)) * F.greatest(draws - x, F.lit(0.0)) / (x + 1) / F.greatest(bad - draws + x + 1, F.lit(TINY))
    down = lambda x: F.greatest(x, F.lit(0.0)) * F.greatest(bad - draws + x, F.lit(0.0)) / F.greatest(good - x + 1, F.lit(TINY)) / F.greatest(draws - x + 1, F.lit(TINY))
    upper, lower = _tails(k, draws * share, draws * share * (1 - share), lambda x: hypergeometric(x, good, total, draws), up, down)
    always, never = k <= F.greatest(F.lit(0), draws - bad), k > F.least(good, draws)
    return F.when(always, 1.0).when(never, 0.0).otherwise(upper), F.when(always, 0.0).when(never, 1.0).otherwise(lower)


def hypergeometric_upper(k: Column, good: Column, total: Column, draws: Column) -> Column:
    """``P(X >= k)`` of hits in ``draws`` from ``total`` of which ``good`` hit."""
    return _hypergeometric_tails(k, good, total, draws)[0]


def hypergeometric_lower(k: Column, good: Column, total: Column, draws: Column) -> Column:
    """``P(X <= k)`` of hits in ``draws`` from ``total`` of which ``good`` hit."""
    return _hypergeometric_tails(k + 1, good, total, draws)[1]


def benjamini_hochberg(df: DataFrame, p: str, q: str, *, by: tuple[str, ...] = (), tie: tuple[str, ...] = (), small: int = SMALL) -> DataFrame:
    """``df`` with adjusted p-values in column ``q``; ties share theirs."""
    df = stored(df)
    if df.count() <= small:
        group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        ranked = df.withColumn("_rank", F.row_number().over(group.orderBy(p, *tie))).withColumn("_raw", F.col(p) * F.count(F.lit(1)).over(group) / F.col("_rank"))
        down = group.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
        return ranked.withColumn(q, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_rank", "_raw")
    ranked = along(df, [p, *tie], by=by, number="_rank", small=small)
    sizes = df.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_size"))
    if by:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        ranked = ranked.join(sizes, same).drop(*[f"_by_{c}" for c in by])
    else:
        ranked = ranked.crossJoin(F.broadcast(sizes))  # one row
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_size") / F.col("_rank"))
    least = along(raw, [F.desc("_rank")], {"_least": ("min", "_raw")}, by=by, number="_back", small=small)
    return least.withColumn(q, F.least(F.lit(1.0), F.col("_least"))).drop("_rank", "_raw", "_size", "_least", "_back")
