"""Nearest vectors by inner product, found by counting collisions in sorted single projections.

The largest inner products are made the smallest distances: in a block of vectors with norms up to
``M`` each ``x / M`` gets one more component that lifts it to length one, and a query is scaled to
length one. Everything is turned by one random orthonormal basis; each of its directions gives a
sorted array of projections. A query opens a window around its own projection in every array and
widens all of them step by step (virtual rehashing: the arrays stay, the width changes). A vector
collides where it lies in a window; those that collide in at least ``THRESHOLD`` of all directions
are verified by their inner product.

A direction in which a vector has not collided at width ``w`` adds at least ``w^2`` to its squared
distance, so the collision counts of all widths bound it from below. The classic search ends once the
k-th verified vector is nearer than the width answers for. By default widening goes on until each
vector is verified or its bound is beyond the k-th verified one; what is left when few are open is
verified as well. The result is then exactly the k nearest, whatever the blocks and the basis.

Vectors are dealt to blocks by hash within classes of like norms, so that ``M`` fits all of them. The
index has one row for each block: ids, vectors, sorted projections and the place of each vector in
each array. Queries are packed in chunks; each (block, chunk) is one group that reads one row of
either, and returns at most k rows a query, which are ranked in Spark.

Defined results: vectors that are null or empty, hold null or non-finite components, have no length
or another dimension than the first one (by id, then components), take no part; rows of one id are
vectors and queries of their own, and only the query's own row is left out; equal scores go by
smaller id, rows without an id last; queries without an id have a null one; with fewer candidates
than k all are returned; an empty table gives no rows; scores add products from the first component
to the last in double precision, and components beyond 1e150 may overflow it. Only the named columns
are read, so no other column clashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .codes import is_vector

#: Numbers in a block, and vectors at most.
BLOCK_NUMBERS, BLOCK_VECTORS = 1 << 20, 1 << 14
#: Queries of one group.
CHUNK = 1024
#: The share of directions in which a vector must collide, that of a normal law within ``WIDTH`` deviations.
WIDTH, THRESHOLD = 1.5, 0.866
#: The step from one width to the next.
STEP = 1.25
#: Open vectors that are verified at once, as a share of the block.
REST = 0.15
#: Cells of a direction, at whose ends windows end.
CELLS = 1 << 13
#: Rings with more than this share of the arrays are counted by places instead of slices.
DENSE = 0.08
_SLACK = 1e-6


@lru_cache(maxsize=4)
def _basis(n: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(11).standard_normal((n, n)))[0]


def _lifted(x: np.ndarray, norms: np.ndarray, top: float) -> np.ndarray:
    """Projections of vectors lifted to length one."""
    up = np.sqrt(np.maximum(0.0, 1.0 - (norms / top) ** 2))
    return np.concatenate([x / top, up[:, None]], axis=1) @ _basis(x.shape[1] + 1)


@dataclass
class Index:
    """Packed blocks, and the vectors that they hold."""

    blocks: DataFrame
    points: DataFrame
    dim: int
    n_blocks: int


BLOCK_ROW = "block int, top double, rows array<long>, ids array<long>, vectors binary, sorted binary, places binary"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _pack(dim: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        x = _matrix(group["e"], dim)
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        top = float(norms.max())
        p = _lifted(x, norms, top).T.astype(np.float32)
        order = np.argsort(p, axis=1, kind="stable")
        places = np.empty(p.shape, np.uint16)
        np.put_along_axis(places, order, np.arange(len(x), dtype=np.uint16)[None, :], 1)
        lists = [pa.array([group[c].to_pylist()], pa.list_(pa.int64())) for c in ("row", "id")]
        blobs = [pa.array([v.tobytes()], pa.binary()) for v in (x, np.take_along_axis(p, order, 1), places)]
        return pa.table([group["block"].slice(0, 1), pa.array([top]), *lists, *blobs], names=["block", "top", "rows", "ids", "vectors", "sorted", "places"])

    return run


def _pack_queries(dim: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        lists = [pa.array([group[c].to_pylist()], pa.list_(pa.int64())) for c in ("row", "id")]
        return pa.table([group["chunk"].slice(0, 1), *lists, pa.array([_matrix(group["e"], dim).tobytes()], pa.binary())], names=["chunk", "rows", "ids", "vectors"])

    return run


class Block:
    """One row of the index, ready for queries."""

    def __init__(self, dim: int, top: float, rows: np.ndarray, vectors: bytes, values: bytes, places: bytes):
        self.n, self.m, self.top, self.rows = len(rows), dim + 1, top, rows
        self.x = np.frombuffer(vectors).reshape(self.n, dim)
        self.places = np.frombuffer(places, np.uint16).reshape(self.m, self.n)
        self.order = np.empty(self.m * self.n, np.int64)
        self.base = np.arange(self.m) * self.n
        np.put_along_axis(self.order.reshape(self.m, self.n), self.places.astype(np.int64), np.arange(self.n)[None, :], 1)
        # Windows end where cells do: the place of each cell's first projection in its array serves all widths.
        ends = (np.arange(CELLS + 1) * (2.0 / CELLS) - 1.0).astype(np.float32)
        ends[0], ends[-1] = -np.inf, np.inf
        self.ends = np.concatenate([np.searchsorted(v, ends) + b for v, b in zip(np.frombuffer(values, np.float32).reshape(self.m, self.n), self.base, strict=True)])
        self.first = np.arange(self.m) * (CELLS + 1)
        self._diff, self._hit = np.empty((self.m, self.n), np.uint16), np.empty((self.m, self.n), bool)

    def window(self, at: np.ndarray, w: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in the cells that ``at`` plus and minus ``w`` reach, which are those of the window and a few more."""
        lo = np.clip(np.floor((at - w + 1.0) * (CELLS / 2)), 0, CELLS - 1).astype(np.int64)
        hi = np.clip(np.floor((at + w + 1.0) * (CELLS / 2)), 0, CELLS - 1).astype(np.int64)
        return self.ends[self.first + lo], self.ends[self.first + hi + 1]

    def _slices(self, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        return [self.order[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]

    def counted(self, lo: np.ndarray, hi: np.ndarray, old: tuple[np.ndarray, np.ndarray] | None, counts: np.ndarray | None) -> np.ndarray:
        """Collisions of each vector in windows that widen ``old`` ones with known counts."""
        ring = int((hi - lo).sum() - ((old[1] - old[0]).sum() if old else 0))
        if ring <= DENSE * self.n * self.m:
            parts = self._slices(lo, old[0]) + self._slices(old[1], hi) if old else self._slices(lo, hi)
            more = np.bincount(np.concatenate(parts), minlength=self.n) if parts else 0
            return (counts if counts is not None else np.zeros(self.n, np.int64)) + more
        np.subtract(self.places, (lo - self.base).astype(np.uint16)[:, None], out=self._diff)
        wide = hi - lo
        np.less(self._diff, np.minimum(wide, 65535).astype(np.uint16)[:, None], out=self._hit)
        out = np.zeros(self.n, np.int64)
        for a in range(0, self.m, 255):
            out += np.add.reduce(self._hit[a : a + 255].view(np.uint8), axis=0, dtype=np.uint8)
        return out

    def near(self, q: np.ndarray, q_row: int, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Verified vectors that may be among the k nearest, their rounded scores, and how many were verified."""
        length = float(np.sqrt(q @ q))
        seen = self.rows == q_row
        if self.n <= 8 * k:
            rest = np.flatnonzero(~seen)
            return rest, self.x[rest] @ q, len(rest)
        at = np.append(q / length, 0.0) @ _basis(self.m)
        need = int(np.ceil(THRESHOLD * self.m))
        found, scores, far = [], np.zeros(0), np.inf

        def verify(new: np.ndarray) -> None:
            nonlocal scores, far
            seen[new] = True
            found.append(new)
            scores = np.concatenate([scores, self.x[new] @ q])
            if len(scores) >= k:
                far = 2.0 - 2.0 * float(np.partition(scores, len(scores) - k)[len(scores) - k]) / (length * self.top)

        # The first windows hold enough for k vectors; those that collide most give a first bound.
        w = 2.0**-12
        lo, hi = self.window(at, w)
        while (hi - lo).sum() < 4 * k * need and w < 2.0:
            w *= 2.0
            lo, hi = self.window(at, w)
        counts = self.counted(lo, hi, None, None)
        verify(np.flatnonzero(~seen)[np.argpartition(-counts[~seen], k)[:k]])
        low = (self.m - counts) * (w - _SLACK) ** 2
        guess = WIDTH * np.sqrt(max(far, 0.0) / self.m)
        done = w
        w = max(STEP * w, guess / 4)
        while True:
            a, b = self.window(at, w)
            counts = self.counted(a, b, (lo, hi), counts)
            lo, hi = a, b
            low += (self.m - counts) * ((w - _SLACK) ** 2 - (done - _SLACK) ** 2)
            done = w
            alive = ~seen & (low <= far + 1e-9)
            left = int(np.count_nonzero(alive))
            # The width at which vectors as near as the k-th collide in a share THRESHOLD of all directions.
            answered = (w / WIDTH) ** 2 * self.m >= far
            if left <= REST * self.n or w > 2.0:
                verify(np.flatnonzero(alive))
                break
            new = np.flatnonzero(alive & (counts >= need)) if not answered else ()
            if len(new):
                verify(new)
            elif answered and not exact:
                break
            w *= STEP
        return np.concatenate(found), scores, len(scores)


def _cell(dim: int, k: int, exact: bool):
    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        if not len(block) or not len(chunk):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=FOUND)
        rows, q_rows = (np.array(t["rows"][0].as_py(), np.int64) for t in (block, chunk))
        held = Block(dim, block["top"][0].as_py(), rows, *(block[c][0].as_buffer() for c in ("vectors", "sorted", "places")))
        q = np.frombuffer(chunk["vectors"][0].as_buffer()).reshape(len(q_rows), dim)
        which, what = [], []
        for i in range(len(q)):
            at, scores, _ = held.near(q[i], int(q_rows[i]), k, exact)
            if len(at) > k:  # all that rounding could bring among the first k
                least = np.partition(scores, len(at) - k)[len(at) - k] - 8 * dim * 2.3e-16 * held.top * float(np.sqrt(q[i] @ q[i]))
                at = at[scores >= least]
            which.append(np.full(len(at), i))
            what.append(at)
        i, j = np.concatenate(which), np.concatenate(what)
        score = np.zeros(len(i))
        for c in range(dim):
            score += q[i, c] * held.x[j, c]
        ids = block["ids"][0].values
        null = np.asarray(ids.is_null())
        number = np.asarray(ids.fill_null(0))
        order = np.lexsort((rows[j], number[j], null[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        start = np.flatnonzero(np.diff(i, prepend=-1))
        place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        i, j, score = i[place < k], j[place < k], score[place < k]
        return pa.table([pa.array(q_rows[i]), chunk["ids"][0].values.take(pa.array(i)), pa.array(rows[j]), ids.take(pa.array(j)), pa.array(score)], names=FOUND)

    return run


FOUND = ["q_row", "query_id", "c_row", "vec_id", "score"]


def build_index(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> Index:
    """All usable vectors in packed blocks."""
    square = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)
    e = F.transform(F.col(vector), lambda x: x.cast("double")).alias("e")
    points = df.filter(is_vector(F.col(vector))).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), e)
    points = stored(points.withColumn("kind", F.floor(F.log2(square)).cast("int")).filter(square > 0))
    first = points.orderBy(F.col("id").asc_nulls_last(), "e").select("e").limit(1).collect()
    dim = len(first[0].e) if first else 1
    points = points.filter(F.size("e") == dim)
    size = max(256, min(BLOCK_VECTORS, BLOCK_NUMBERS // dim))
    kinds, n = [], 0
    for r in points.groupBy("kind").count().orderBy("kind").collect():  # a row for each power of two
        blocks = -(-r["count"] // size)
        kinds.append((r.kind, n, blocks))
        n += blocks
    deal = F.broadcast(df.sparkSession.createDataFrame(kinds, "kind int, first int, blocks int"))
    dealt = points.join(deal, "kind").select((F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).cast("int").alias("block"), "row", "id", "e")
    return Index(stored(dealt.groupBy("block").applyInArrow(_pack(dim), BLOCK_ROW)), points, dim, n)


def search(index: Index, is_query: Column, k: int = 20, exact: bool = True) -> DataFrame:
    """The k nearest vectors of each indexed row that ``is_query`` picks by ``id``: query_id, rank, vec_id, score.

    Without ``exact`` the search ends at the classic stop, where a few of the nearest may be missing.
    """
    queries = index.points.filter(is_query)
    chunks = max(1, -(-queries.count() // CHUNK))
    packed = queries.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int"))
    packed = packed.groupBy("chunk").applyInArrow(_pack_queries(index.dim), "chunk int, rows array<long>, ids array<long>, vectors binary")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    left = index.blocks.withColumn("chunk", every(chunks)).groupBy("block", "chunk")
    right = packed.withColumn("block", every(index.n_blocks)).groupBy("block", "chunk")
    found = left.cogroup(right).applyInArrow(_cell(index.dim, k, exact), "q_row long, query_id long, c_row long, vec_id long, score double")
    best = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "c_row")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
