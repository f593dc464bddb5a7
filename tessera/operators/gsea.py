"""Enrichment of feature sets in a ranked list."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import along
from ..session import stored


def enrichment_scores(ranking: DataFrame, sets: DataFrame, weight: float = 1.0) -> DataFrame:
    """``term, size, es, leading``: ranking (feature, score), sets (term, feature).

    The running sum is taken at hits only: just before a hit it is at its lowest since the last one,
    and just after at its highest, so misses need no rows of their own.
    """
    ranked = along(ranking, [F.desc("score"), "feature"])
    n = ranking.agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.join(sets.distinct(), "feature").crossJoin(F.broadcast(n)).withColumn("r", F.pow(F.abs("score"), F.lit(weight)))
    w = Window.partitionBy("term").orderBy("rank")
    whole = Window.partitionBy("term")
    run = hits.withColumns({"size": F.count(F.lit(1)).over(whole), "k": F.row_number().over(w), "upto": F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("r").over(whole)})
    miss = F.when(F.col("n") > F.col("size"), (F.col("rank") - F.col("k")) / (F.col("n") - F.col("size"))).otherwise(0.0)
    run = run.withColumns({"high": F.col("upto") / F.col("all") - miss, "low": (F.col("upto") - F.col("r")) / F.col("all") - miss})
    top = run.groupBy("term").agg(F.max("size").alias("size"), F.max("high").alias("high"), F.least(F.min("low"), F.lit(0.0)).alias("low"), F.max_by("k", F.struct("high", -F.col("k"))).alias("leading_high"), F.min_by("k", F.struct("low", "k")).alias("leading_low"))
    up = F.col("high") > -F.col("low")
    return top.select("term", "size", F.when(up, F.col("high")).otherwise(F.col("low")).alias("es"), F.when(up, F.col("leading_high")).otherwise(F.col("size") - F.col("leading_low") + 1).alias("leading"))


#: The prime that draws are mixed by: products of smaller numbers fit 64 bits.
PRIME = (1 << 31) - 1


def mixed(place: Column, draw: Column, seed: int) -> Column:
    """A number below ``PRIME`` for a place of the ranking and a draw; whole numbers only, so any engine repeats it."""
    x = (place % PRIME * 1103515245 + draw * 69621 + (seed % PRIME) * 16807 + 12345) % PRIME
    y = (x * x + draw) % PRIME
    z = (y * 48271 + x) % PRIME
    return (z * z + y) % PRIME


def _nulls(sizes: list[int], n: int):
    """Scores of the first places of one draw, for each size."""

    def run(draw: pa.Table) -> pa.Table:
        draw = draw.sort_by("k")
        place, r = draw["place"].to_numpy(), draw["r"].to_numpy()
        es = np.zeros(len(sizes))
        for i, s in enumerate(sizes):
            order = np.argsort(place[:s])
            at, hit = place[:s][order], r[:s][order]
            upto = np.cumsum(hit)
            miss = (at - np.arange(s)) / max(n - s, 1)
            total = max(upto[-1], 1e-300)
            high, low = (upto / total - miss).max(), min(((upto - hit) / total - miss).min(), 0.0)
            es[i] = high if high > -low else low
        return pa.table([pa.array(sizes, pa.int64()), pa.array(es)], names=["size", "null"])

    return run


def null_scores(ranked: DataFrame, sizes: list[int], n: int, permutations: int, seed: int) -> DataFrame:
    """``size, null``: scores of random sets, drawn once for each permutation and shared by all sizes.

    A draw orders all places by a mixed number; its set of a size is the first places. Ranked rows
    (place, r) stay where they are: each makes its numbers, and those too high for the largest size
    are dropped at once.
    """
    most = max(sizes)
    share = most + 10 * math.sqrt(most) + 100
    while True:
        limit = PRIME if share >= n else int(PRIME * share / n)
        drawn = ranked.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(permutations - 1).cast("long")))).withColumn("h", mixed(F.col("place"), F.col("t"), seed)).filter(F.col("h") < limit)
        first = drawn.withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy("h", "place"))).filter(F.col("k") <= most)
        first = stored(first.select("t", "k", "place", "r"))
        whole = first.filter(F.col("k") == most).count()
        if whole == permutations or limit == PRIME:
            return first.groupBy("t").applyInArrow(_nulls(sizes, n), "size long, null double")
        share *= 2


def prerank(ranking: DataFrame, sets: DataFrame, *, permutations: int = 1000, min_size: int = 15, max_size: int = 2000, weight: float = 1.0, seed: int = 0) -> DataFrame:
    """``term, size, es, nes, p_value, fdr`` of the sets of ``min_size`` to ``max_size`` ranked features.

    Scores of sets come from the distributed ranking; null scores are those of ``null_scores``, equal
    for sets of one size. Null scores stay in a table, where false discovery rates follow from ranks,
    each counting once for each set of its size.
    """
    ranked = stored(along(ranking, [F.desc("score"), "feature"]).select((F.col("rank") - 1).alias("place"), F.pow(F.abs("score"), F.lit(weight)).cast("double").alias("r")))
    n = ranked.count()
    scores = stored(enrichment_scores(ranking, sets, weight).select("term", F.col("size").cast("long").alias("size"), "es").filter(F.col("size").between(min_size, max_size)))
    held = stored(scores.groupBy("size").agg(F.count(F.lit(1)).alias("w")))
    sizes = sorted(r["size"] for r in held.select("size").collect())  # as many as there are sizes between both limits
    if not sizes:
        return scores.select("term", "size", "es", *[F.lit(None).cast("double").alias(c) for c in ("nes", "p_value", "fdr")])
    nulls = stored(null_scores(ranked, sizes, n, permutations, seed))
    side = lambda c: F.when(F.col(c) >= 0, 1).otherwise(-1)
    means = F.broadcast(nulls.groupBy("size", side("null").alias("side")).agg(F.avg(F.abs("null")).alias("mean"), F.count(F.lit(1)).alias("m")))  # two rows a size
    near = scores.withColumn("side", side("es")).join(means, ["size", "side"], "left")
    beyond = near.join(nulls, "size").filter((side("null") == F.col("side")) & (F.abs("null") >= F.abs("es"))).groupBy("term").agg(F.count(F.lit(1)).alias("beyond"))
    p = F.when(F.col("m").isNull(), 1.0).otherwise(F.coalesce("beyond", F.lit(0)) / F.col("m"))
    nes = F.when(F.col("mean") > 0, F.try_divide("es", "mean")).otherwise(0.0)
    scored = stored(near.join(beyond, "term", "left").select("term", "size", "es", nes.alias("nes"), p.alias("p_value")))
    scaled = nulls.withColumn("side", side("null")).join(means, ["size", "side"]).join(F.broadcast(held), "size").filter("mean > 0")
    return _rates(scored, scaled.select((F.col("null") / F.col("mean")).alias("x"), "w"))


def _discovery_rates(scored: DataFrame) -> DataFrame:
    """The rates of ``scored`` sets that carry their null scores as arrays."""
    return _rates(scored.drop("null"), scored.select(F.explode("null").alias("x"), F.lit(1).cast("long").alias("w")))


def _rates(scored: DataFrame, nulls: DataFrame) -> DataFrame:
    """The share of null scores (x, w times) beyond each score over the share of observed ones, on the side of its sign, one at most."""
    told = lambda nes, kind, w: (F.when(nes >= 0, 1).otherwise(-1).alias("side"), F.abs(nes).alias("far"), F.lit(kind).alias("seen"), w.alias("w"))
    none = F.lit(None).cast(dict(scored.dtypes)["term"]).alias("term")
    both = nulls.select(none, *told(F.col("x"), 0, F.col("w"))).unionByName(scored.select("term", *told(F.col("nes"), 1, F.lit(0).cast("long"))))
    # Null scores come before equal observed ones, so that they count as beyond them.
    run = along(both, [F.desc("far"), "seen", "term"], {"observed": ("sum", "seen"), "beyond": ("sum", "w")}, by=("side",), number="place")
    sizes = both.groupBy("side").agg(F.sum("w").alias("n_null"), F.sum("seen").alias("n_seen"))
    run = run.filter("seen = 1").join(F.broadcast(sizes), "side")  # two rows
    equal = Window.partitionBy("side", "far")
    run = run.withColumn("observed", F.max("observed").over(equal))
    ratio = (F.col("beyond") / F.greatest(F.col("n_null"), F.lit(1))) / (F.col("observed") / F.col("n_seen"))
    return scored.join(run.select("term", F.least(F.lit(1.0), ratio).alias("fdr")), "term").orderBy(F.desc("nes"), "term")


def motif_gsea(ranking: DataFrame, hits: DataFrame, **options: float) -> DataFrame:
    """``prerank`` with the regions of each motif as sets: hits (region, motif)."""
    return prerank(ranking, hits.select(F.col("motif").alias("term"), F.col("region").alias("feature")), **options)
