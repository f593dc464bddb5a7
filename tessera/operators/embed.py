"""Spectral embedding and topics of a cell-by-feature matrix in coordinate form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import along
from ..session import bucketed, remove, shared_dir, stored
from . import krylov

#: Up to so many features, their sums are broadcast to the cells; beyond, a copy of X by feature meets them.
FEW_FEATURES = 1 << 16


def idf_weights(x: DataFrame) -> DataFrame:
    """``feature, idf``: ln(cells / cells with it), 0 cells counting as 1 and all cells as one less; all equal gives 1."""
    n = x.agg(F.countDistinct("cell").alias("n"))
    df = x.filter("value <> 0").groupBy("feature").agg(F.countDistinct("cell").alias("df")).crossJoin(F.broadcast(n))
    held = F.when(F.col("df") >= F.col("n"), F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.col("df"))
    raw = df.withColumn("raw", F.log(F.col("n") / held))
    span = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return raw.crossJoin(F.broadcast(span)).select("feature", F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(F.col("raw")).alias("idf"))


def normalized(x: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``cell, feature, v``: values times idf, or times given weights (feature, weight), rows of length one."""
    # Stored, so that the planner knows its size.
    weights = stored(idf_weights(x)) if weights is None else weights.select("feature", F.col("weight").alias("idf"))
    weighted = x.join(weights, "feature").withColumn("w", F.col("value") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("cell")))
    return weighted.withColumn("_n", norm).filter("_n > 0").select("cell", "feature", (F.col("w") / F.col("_n")).alias("v"))


def degrees(rows: DataFrame) -> DataFrame:
    """``cell, degree``: the row's product with the sum of all rows, less its own part."""
    sums = stored(rows.groupBy("feature").agg(F.sum("v").alias("s")))
    return rows.join(sums, "feature").groupBy("cell").agg((F.sum(F.col("v") * F.col("s")) - 1).alias("degree"))


def spectral(x: DataFrame, n_comps: int = 30, *, seed: int = 0, weighted: bool = True, feature_weights: DataFrame | None = None, steps: int | None = None) -> DataFrame:
    """``cell, embedding``: leading eigenvectors of D^-1/2 X X' D^-1/2 - D^-1, times the root of positive eigenvalues.

    Vectors are tables by cell (see ``krylov``). A product with X is two joins with sums, by feature and
    by cell. X is dealt out by cell once, and all that follows goes by its buckets; with many features a
    copy in buckets of feature is made for the second join.
    ``feature_weights`` (feature, weight) take the place of the inverse document frequencies; ``steps``
    ends the iteration after so many blocks.
    """
    spark = x.sparkSession
    home = f"{shared_dir(spark)}/spectral-{uuid.uuid4().hex}"
    tables = []
    try:
        held = bucketed(x.select("cell", "feature", "value"), "cell", tables)
        rows = bucketed(normalized(held, feature_weights), "cell", tables)
        deg = stored(degrees(rows), f"{home}/degrees")
        if not deg.filter("degree <= 0").isEmpty():
            raise ValueError("a cell has no neighbours: its degree is not positive")
        n, m = deg.count(), rows.select("feature").distinct().count()
        by_feature = bucketed(rows, "feature", tables) if m > FEW_FEATURES else None
        basis, values, weights = krylov.leading(deg, "cell", n, min(n_comps, min(n, m) - 1), _affinity(rows, by_feature), f"{home}/basis", seed=seed, steps=steps)
        if weighted:
            weights, values = weights[:, values > 0], values[values > 0]
            weights = weights * np.sqrt(values)
        return krylov.combined(basis, "cell", weights, "embedding")
    finally:
        for name in tables:
            spark.sql(f"drop table if exists {name}")
        remove(spark, home)


def _affinity(by_cell: DataFrame, by_feature: DataFrame | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """The product of D^-1/2 X X' D^-1/2 - D^-1 with a block of vectors (cell, degree, q).

    Sums by feature meet X in ``by_feature``; without it they are few and broadcast, and no entry is moved.
    """

    def product(last: DataFrame, width: int) -> DataFrame:
        names = [f"s{i}" for i in range(width)]
        half = last.select("cell", *[(F.get("q", F.lit(i)) / F.sqrt("degree")).alias(c) for i, c in enumerate(names)])
        sums = [F.sum(F.col("v") * F.col(c)).alias(c) for c in names]
        down = by_cell.join(half.hint("shuffle_hash"), "cell").groupBy("feature").agg(*sums)
        met = by_cell.join(F.broadcast(down), "feature") if by_feature is None else by_feature.join(down, "feature")
        across = met.groupBy("cell").agg(*sums)
        w = [F.col(c) / F.sqrt("degree") - F.get("q", F.lit(i)) / F.col("degree") for i, c in enumerate(names)]
        return last.join(across, "cell").select("cell", F.array(*w).alias("w"))

    return product


class Topics:
    """Topics of a cell-by-feature matrix by online variational Bayes with priors 1/K.

    The model that Spark fits is a table of topics by features, which driver and tasks hold.
    """

    def __init__(self, n_topics: int = 20, *, max_iter: int = 20, offset: float = 10.0, decay: float = 0.7, seed: int = 0) -> None:
        self.estimator = LDA(k=n_topics, maxIter=max_iter, optimizer="online", learningOffset=offset, learningDecay=decay, docConcentration=[1 / n_topics], topicConcentration=1 / n_topics, seed=seed)
        self.model = self.features = None

    def _vectors(self, x: DataFrame) -> DataFrame:
        """``cell, features`` as sparse vectors: the vector type's own columns, written and read as that type."""
        m = self.features.count()
        pairs = F.array_sort(F.collect_list(F.struct(F.col("j").cast("int").alias("j"), F.col("value").cast("double").alias("v"))))
        rows = x.filter("value <> 0").join(self.features, "feature").groupBy("cell").agg(pairs.alias("p"))
        part = lambda c: F.transform("p", lambda p: p[c])
        vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(m).alias("size"), part("j").alias("indices"), part("v").alias("values"))
        path = f"{shared_dir(x.sparkSession)}/vectors-{uuid.uuid4().hex}"
        stored(rows.select("cell", vector.alias("features")), path)
        schema = T.StructType([rows.schema["cell"], T.StructField("features", VectorUDT())])
        return x.sparkSession.read.schema(schema).parquet(path)

    def fit(self, x: DataFrame) -> Topics:
        self.features = stored(along(x.select("feature").distinct(), ["feature"], number="j").withColumn("j", F.col("j") - 1))
        self.model = self.estimator.fit(self._vectors(x))
        return self

    def transform(self, x: DataFrame) -> DataFrame:
        """``cell, topics``; features that the model has not seen are left out."""
        if self.model is None:
            raise ValueError("the model is not fitted")
        return self.model.transform(self._vectors(x)).select("cell", vector_to_array("topicDistribution").alias("topics"))

    def fit_transform(self, x: DataFrame) -> DataFrame:
        return self.fit(x).transform(x)

    def weights(self, n: int | None = None) -> DataFrame:
        """``topic, feature, weight`` of all features, or the n first of each topic."""
        if self.model is None:
            raise ValueError("the model is not fitted")
        listed = self.model.describeTopics(n or self.features.count())
        described = listed.select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t")).select("topic", F.col("t.termIndices").alias("j"), F.col("t.termWeights").alias("weight"))
        return described.join(self.features, "j").select("topic", "feature", "weight")

    def top_peaks(self, n: int = 10) -> DataFrame:
        return top_peaks(self.weights(n), n)


def lda(x: DataFrame, n_topics: int = 20, **options: float) -> tuple[DataFrame, DataFrame]:
    """``(cell, topics)`` and ``(topic, feature, weight)``."""
    model = Topics(n_topics, **options).fit(x)
    return model.transform(x), model.weights()


def top_peaks(topics: DataFrame, n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "feature"))
    return topics.withColumn("rank", rank).filter(F.col("rank") <= n)
