"""Leading eigenpairs of a symmetric operator whose vectors are tables.

A block of vectors is a table with a row for each key and an array of components. The basis of a block
Krylov space grows by one block a step: the operator is applied to the last block, what lies in the
basis is taken away twice, and the rest is made orthonormal by a tall-skinny QR, in which each task
factors its own rows and triangles are factored again in groups. Only sums of outer products and
triangles, basis by block in size, come to the driver, whatever the number of rows.

With all coefficients kept, the residual of a Ritz pair is the last triangle times the end of its
vector; the space grows until those of all wanted pairs are small.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import remove, stored

#: Vectors in a block beside the wanted ones, and residuals as a share of the largest value at which the iteration ends.
EXTRA, TOLERANCE = 8, 1e-7
#: Directions shorter than this share of the longest one are left out of a new block.
RANK = 1e-10
#: Groups in which the triangles of tasks are factored again.
GROUPS = 16

Rows = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _moved(q: np.ndarray, w: np.ndarray, parts: list[np.ndarray], turn: np.ndarray | None) -> np.ndarray:
    """``w`` without its parts along ``q``, then turned."""
    for c in parts:
        w = w - q @ c
    return w if turn is None else w @ turn


def summed(df: DataFrame, shape: tuple[int, int], of: Rows) -> np.ndarray:
    """The sum over all rows of a small matrix ``of`` (basis rows, block rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += of(_array(batch, "q").reshape(len(batch), -1), _array(batch, "w"))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "s"])

    out = np.zeros(shape[0] * shape[1])
    for r in df.select("q", "w").mapInArrow(run, "place long, s double").groupBy("place").agg(F.sum("s").alias("s")).collect():
        out[r.place] = r.s
    return out.reshape(shape)


def triangle(df: DataFrame, width: int, of: Rows) -> np.ndarray:
    """R of the QR factorization of a tall table of ``width`` columns, by rows ``of`` each batch."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if len(batch):
                r = np.linalg.qr(np.vstack([r, of(_array(batch, "q").reshape(len(batch), -1), _array(batch, "w"))]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int % GROUPS], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def again(group: pa.Table) -> pa.Table:
        rows = np.vstack([np.frombuffer(x.as_buffer()).reshape(-1, width) for x in group["r"]])
        return pa.table([pa.array([np.linalg.qr(rows, mode="r").tobytes()], pa.binary())], names=["r"])

    each = df.select("q", "w").mapInArrow(factor, "part int, r binary").groupBy("part").applyInArrow(again, "r binary")
    rows = np.vstack([np.frombuffer(x.r).reshape(-1, width) for x in each.collect()] or [np.zeros((0, width))])
    return np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, width))


def joined(df: DataFrame, key: str, parts: list[np.ndarray], turn: np.ndarray) -> DataFrame:
    """The table with its block moved, turned and put behind the basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q = _array(batch, "q").reshape(len(batch), -1)
                q = np.hstack([q, _moved(q, _array(batch, "w"), parts, turn)])
                at = pa.array(np.arange(len(q) + 1, dtype=np.int32) * q.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(q.ravel()))], [key, "degree", "q"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(key, "degree", "q", "w").mapInArrow(run, f"`{key}` {kinds[key]}, degree double, q array<double>")


def normal(key: str, place: int, seed: int) -> Column:
    """A standard normal number that depends on the row's key alone."""
    uniform = lambda i: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(place), F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * np.pi * uniform(1))


def leading(rows: DataFrame, key: str, n: int, k: int, product: Callable[[DataFrame, int], DataFrame], home: str, *, seed: int = 0, steps: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Basis table (key, degree, q), the ``k`` eigenvalues largest in size in falling order, and their vectors in the basis.

    ``rows`` has ``n`` rows (key, degree). ``product`` takes a block (key, degree, q) and its width and gives (key, w).
    Tables are kept in the shared folder ``home``, the newest two of them.
    """
    spark, width = rows.sparkSession, min(n, k + EXTRA)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        """Written once; all but the newest tables go."""
        kept.append(f"{home}/{len(kept)}")
        out = stored(df, kept[-1])
        if len(kept) > 2:
            remove(spark, kept[-3])
        return out

    empty = F.array().cast("array<double>")
    table = keep(rows.select(key, "degree", empty.alias("q"), F.array(*[normal(key, i, seed) for i in range(width)]).alias("w")))
    h, size, last = np.zeros((0, 0)), 0, 0
    values, vectors = np.zeros(0), np.zeros((0, 0))
    while True:
        outer = lambda parts, turn: lambda q, w: q.T @ _moved(q, w, parts, turn)
        parts = []
        for _ in range(2 if size else 0):
            parts.append(summed(table, (size, width), outer(list(parts), None)))
        r = triangle(table, width, lambda q, w, p=tuple(parts): _moved(q, w, list(p), None))
        if size:
            c = sum(parts)
            grown = np.zeros((size, size))
            grown[: len(h), : len(h)] = h
            grown[:, size - last :] = c
            grown[size - last :, :] = c.T
            h = grown
            values, vectors = np.linalg.eigh((h + h.T) / 2)
            lead = np.argsort(-np.abs(values))[:k]
            lead = lead[np.argsort(-values[lead])]
            rest = np.linalg.norm(r @ vectors[size - last :, lead], axis=0)
            done = len(lead) == k and rest.max(initial=0.0) <= TOLERANCE * np.abs(values).max(initial=1e-300)
            if done or size >= n or steps is not None and size >= steps * (k + EXTRA):
                break
        _, long, turn = np.linalg.svd(r)
        used = long > RANK * max(long.max(initial=0.0), np.abs(values).max(initial=0.0))
        used[n - size :] = False
        if not used.any():
            break
        turn = turn[: len(long)][used].T / long[used]
        # Once more what rounding has left along the basis and between the new vectors.
        if size:
            gram = summed(table, (size + turn.shape[1], turn.shape[1]), lambda q, w, p=tuple(parts), t=turn: (lambda u: np.vstack([q.T @ u, u.T @ u]))(_moved(q, w, list(p), t)))
            turn2 = np.linalg.inv(np.linalg.cholesky(gram[size:] - gram[:size].T @ gram[:size])).T
            parts.append(gram[:size] @ np.linalg.pinv(turn))
            turn = turn @ turn2
        last = turn.shape[1]
        basis = keep(joined(table, key, parts, turn))
        size, width = size + last, last
        block = product(basis.select(key, "degree", F.slice("q", F.lit(size - last + 1), F.lit(last)).alias("q")), last)
        table = keep(basis.join(block, key))
    return table.select(key, "degree", "q"), values[lead], vectors[:, lead]


def combined(basis: DataFrame, key: str, weights: np.ndarray, name: str) -> DataFrame:
    """``key`` and the basis times ``weights``; each column's component largest in size is positive."""
    k = weights.shape[1]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        for batch in batches:
            if len(batch):
                e = _array(batch, "q") @ weights
                low, high = np.minimum(low, e.min(0)), np.maximum(high, e.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(low), pa.array(high)], ["place", "low", "high"])

    found = basis.select("q").mapInArrow(ends, "place long, low double, high double").groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    sign = np.ones(k)
    for r in found:
        sign[r.place] = 1.0 if r.high >= -r.low else -1.0
    turned = weights * sign

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                e = _array(batch, "q") @ turned
                at = pa.array(np.arange(len(e) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(e.ravel()))], [key, name])

    kind = dict(basis.dtypes)[key]
    return stored(basis.select(key, "q").mapInArrow(run, f"`{key}` {kind}, {name} array<double>"))
