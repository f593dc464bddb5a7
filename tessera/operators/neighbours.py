"""Exact nearest neighbours of a table of queries in a table of points.

Equal points become one place with their first keys, and equal queries one question, so copies cost
nothing. Space is cut into cells by quantiles: a tree of half-spaces from a bounded sample of places,
each cut across the widest side. Every cell has the box of its places.

1. Each question is answered within its own cell, which bounds its k-th distance.
2. It goes to the cells whose boxes are not beyond that bound, and the answers are merged.

Cells of many places are dealt in blocks and cells of many questions in shares, so a task never holds
more than about ``SIZE`` of either; what goes to the driver are the sample and the boxes, both bounded.
The sample decides where work is done, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Places and questions of one task, numbers in all boxes, and places of the sample.
SIZE, BOX_NUMBERS, SAMPLE = 4096, 1 << 20, 1 << 17
#: Distances that a task holds at once.
PAIRS = 1 << 20


@dataclass
class Tree:
    """Half-spaces by node, the root first: axis and cut; the children of node i are 2i + 1 and 2i + 2."""

    axis: np.ndarray
    cut: np.ndarray
    depth: int

    @classmethod
    def grown(cls, sample: np.ndarray, depth: int) -> Tree:
        axis, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = [sample]
        for level in range(depth):
            below = []
            for i, part in enumerate(parts):
                node = (1 << level) - 1 + i
                if len(part):
                    axis[node] = np.argmax(np.ptp(part, axis=0))
                    cut[node] = np.median(part[:, axis[node]])
                side = part[:, axis[node]] <= cut[node]
                below += [part[side], part[~side]]
            parts = below
        return cls(axis, cut, depth)

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - len(self.axis)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _in_cells(df: DataFrame, tree: Tree, dim: int, schema: str) -> DataFrame:
    """The table (x, ...) with a column ``cell`` in front."""
    shared = df.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shared.value.cells(_matrix(batch.column(0), dim)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", *batch.schema.names])

    return df.mapInArrow(run, f"cell int, x array<double>, {schema}")


def _answers(x: np.ndarray, bound: np.ndarray, p: np.ndarray, at: np.ndarray, codes: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each question the distances and places in ``codes`` of its first ``k`` keys within its bound.

    Keys of place i are ``codes[at[i] : at[i + 1]]``; smaller codes come first at equal distances.
    """
    step = max(1, PAIRS // max(1, len(p)))
    for a in range(0, len(x), step):
        d = np.zeros((len(x[a : a + step]), len(p)))
        for j in range(x.shape[1]):
            d += (x[a : a + step, j, None] - p[None, :, j]) ** 2
        d = np.sqrt(d)
        for i in range(len(d)):
            far = min(bound[a + i], np.partition(d[i], k - 1)[k - 1] if len(p) > k else np.inf)
            near = np.flatnonzero(d[i] <= far)
            keys = np.concatenate([np.arange(at[n], at[n + 1]) for n in near]) if len(near) else np.zeros(0, np.int64)
            dist = np.repeat(d[i, near], at[near + 1] - at[near])
            order = np.lexsort((codes[keys], dist))[:k]
            yield dist[order], keys[order]


def _probe(k: int, dim: int, key_type: pa.DataType, boxes: object | None):
    """Answers of a share of a cell's questions in a block of its places, and the cells that may hold better ones."""

    def run(asked: pa.Table, places: pa.Table) -> pa.Table:
        x = _matrix(asked["x"], dim) if len(asked) else np.zeros((0, dim))
        p = _matrix(places["x"], dim) if len(places) else np.zeros((0, dim))
        lists = places["keys"].combine_chunks() if len(places) else pa.array([], pa.list_(key_type))
        at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]) if len(lists) else np.zeros(1, np.int64)
        keys = lists.flatten()
        codes = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1] if len(keys) else np.zeros(0, np.int64)
        bound = asked["far"].to_numpy() if len(asked) else np.zeros(0)
        found = list(_answers(x, bound, p, at, codes, k))
        ends = pa.array(np.concatenate([[0], np.cumsum([len(d) for d, _ in found])]).astype(np.int32))
        which = np.concatenate([j for _, j in found]) if found else np.zeros(0, np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([d for d, _ in found]) if found else np.zeros(0)), keys.take(pa.array(which))], ["distance", "key"])
        out = [asked["qid"], pa.ListArray.from_arrays(ends, pairs)]
        if boxes is None:
            return pa.table(out, names=["qid", "near"])
        far = np.array([d[k - 1] if len(d) == k else np.inf for d, _ in found])
        cells, low, high = boxes.value
        more = []
        if len(x):
            # Boxes within reach of any of these questions, then those of each.
            gap = np.maximum(0, np.maximum(low - x.max(0), x.min(0) - high))
            some = np.flatnonzero(np.sqrt((gap**2).sum(1)) <= far.max() * (1 + 1e-9))
            own = asked["cell"][0].as_py()
            for i in range(len(x)):
                gap = np.maximum(0, np.maximum(low[some] - x[i], x[i] - high[some]))
                reach = cells[some[np.sqrt((gap**2).sum(1)) <= far[i] * (1 + 1e-9)]]
                more.append(reach[reach != own])
        ends = pa.array(np.concatenate([[0], np.cumsum([len(m) for m in more])]).astype(np.int32))
        cells_ = pa.array(np.concatenate(more).astype(np.int32) if more else np.zeros(0, np.int32))
        return pa.table([*out, pa.array(far), pa.ListArray.from_arrays(ends, cells_)], names=["qid", "near", "far", "more"])

    return run


def _met(asked: DataFrame, places: DataFrame, cells: DataFrame, k: int, dim: int, kind: str, boxes: object | None) -> DataFrame:
    """``asked`` (qid, x, cell, far) against the places of its cells."""
    shares = stored(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SIZE).cast("int").alias("shares")))
    deal = cells.select("cell", "blocks").join(shares, "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(F.broadcast(deal), "cell").withColumn("share", F.pmod(F.xxhash64("qid", "cell"), F.col("shares")).cast("int")).withColumn("block", every("blocks"))
    right = places.join(F.broadcast(deal), "cell").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")).withColumn("share", every("shares"))
    group = ("cell", "share", "block")
    schema = f"qid long, near array<struct<distance: double, key: {kind}>>" + ("" if boxes is None else ", far double, more array<int>")
    key_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    return left.select(*group, "qid", "x", "far").groupBy(*group).cogroup(right.select(*group, "x", "keys").groupBy(*group)).applyInArrow(_probe(k, dim, key_type, boxes), schema)


def nearest(points: DataFrame, queries: DataFrame, columns: tuple[str, ...], k: int = 50, key: str = "feature") -> DataFrame:
    """``query, <key>, distance, rank``: the exact ``k`` nearest others of each query, ties by key.

    Keys are unique in either table; a point with a query's key is the query itself. Rows with a null
    or NaN coordinate are left out. Fewer points give fewer neighbours.
    """
    dim, kind = len(columns), dict(points.dtypes)[key]
    x: Column = F.array(*[F.col(c).cast("double") + 0.0 for c in columns])
    usable = lambda df: df.filter(sum(((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in columns), F.lit(0)) == 0)
    first = Window.partitionBy("x").orderBy("key")
    keyed = usable(points).select(x.alias("x"), F.col(key).alias("key")).distinct()
    places = stored(keyed.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= k + 1).groupBy("x").agg(F.array_sort(F.collect_list("key")).alias("keys")))
    asking = stored(usable(queries).select(x.alias("x"), F.col(key).alias("query")))
    questions = stored(asking.select("x").distinct().withColumn("qid", F.monotonically_increasing_id()))

    n = places.count()
    depth = max(0, min(int(np.ceil(np.log2(max(1.0, n / SIZE)))), int(np.log2(BOX_NUMBERS / dim))))
    sample = places.select("x").sample(min(1.0, SAMPLE / max(1, n)), seed=7) if n > SAMPLE else places.select("x")
    rows = sample.collect() if depth else []  # about SAMPLE places at most
    tree = Tree.grown(np.array([r.x for r in rows], float).reshape(-1, dim), depth)
    placed = stored(_in_cells(places.select("x", "keys"), tree, dim, f"keys array<{kind}>"))
    ends = [f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(dim) for n, f in (("low", F.min), ("high", F.max))]
    cells = stored(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SIZE).cast("int").alias("blocks"), *ends))
    held = cells.orderBy("cell").toPandas()  # BOX_NUMBERS at most
    boxes = points.sparkSession.sparkContext.broadcast((held["cell"].to_numpy(), *(held[[f"{s}{i}" for i in range(dim)]].to_numpy(float) for s in ("low", "high"))))

    # A cell that the sample missed has no places: its questions start in the first cell that has some.
    home = _in_cells(questions.select("x", "qid"), tree, dim, "qid long").withColumn("far", F.lit(float("inf")))
    some = int(held["cell"].iloc[0]) if len(held) else 0
    known = cells.select("cell", F.lit(True).alias("_has"))
    home = home.join(F.broadcast(known), "cell", "left").withColumn("cell", F.when(F.col("_has"), F.col("cell")).otherwise(F.lit(some))).drop("_has")
    at_home = stored(_met(home, placed, cells, k + 1, dim, kind, boxes))
    best = at_home.groupBy("qid").agg(F.min("far").alias("far"), F.min_by("more", F.struct("far", F.size("more"))).alias("more"))
    beyond = questions.join(best, "qid").select("qid", "x", "far", F.explode("more").alias("cell"))
    abroad = _met(stored(beyond), placed, cells, k + 1, dim, kind, None)
    merged = at_home.select("qid", "near").unionByName(abroad).groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    answers = asking.join(questions.join(merged, "qid").select("x", "near"), "x")
    others = F.slice(F.filter("near", lambda p: p["key"] != F.col("query")), 1, k)
    out = answers.select("query", F.posexplode(others).alias("_at", "_p"))
    return out.select("query", F.col("_p.key").alias(key), F.col("_p.distance").alias("distance"), (F.col("_at") + 1).alias("rank"))
