"""Product codes of integer vectors: each part of a vector is replaced by its nearest codebook entry.

Components become ``floor(scale * x)`` and vectors are cut into equal parts, each with a codebook of
its own, trained by rounds of assignment and integer means. Nearest entries are found by segment
means: the squared distance of two stretches of ``s`` numbers is at least ``(sum_x - sum_e)^2 / s +
(r_x - r_e)^2`` with ``r`` the norm of what is left without the mean. Bounds over stretches of half
the length are never lower, so entries are dropped from coarse to fine as soon as a bound is above a
distance already known; only those left get exact integer distances. Sums are exact and means are
taken once per round over the whole table, so results don't depend on how rows are dealt.

A round reads the stored integers once, adds up in each task, and sends one number per entry and
component; the driver holds the codebooks, entries times dimension, whatever the rows.

Defined results: vectors that are null or empty, or hold null, NaN or infinite components, are left
out, as are those of another length than the first kept one (by id, then components); a length that
``parts`` doesn't divide is filled up with zeros; integers beyond 2^24 either way are held there; of
equal distances the lower entry wins; of rows with one id each is encoded; rows without an id come
last when the first codebooks are taken; fewer rows than entries give fewer entries; an entry that
gets no part stays; null labels are one label; an empty table gives no rows. Only the named columns
are read, so no other column clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .bounded import small_side

#: Integers are held within this, so that distances of 4,096 components fit 64 bits.
LIMIT = 1 << 24
#: The longest stretch with one mean, for which sums of squares are exact.
STRETCH = 64
#: Labels are broadcast up to so many.
BROADCAST_LABELS = 1_000_000


def is_vector(e: Column) -> Column:
    """Whether an array is there and holds finite numbers only."""
    return F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


@dataclass
class Codebooks:
    """Entries of all parts, ``[part, entry, position]``."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _levels(length: int) -> list[int]:
    """Lengths of stretches, coarse to fine; the last is over one number, where bounds are distances."""
    out, s = [], min(length, STRETCH)
    while s > 1:
        out.append(s)
        s = (s + 1) // 2
    return out


def _segments(x: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of stretches of ``s`` numbers, norms of what is left without their means, and their lengths."""
    starts = np.arange(0, x.shape[1], s)
    sizes = np.diff(np.append(starts, x.shape[1]))
    sums = np.add.reduceat(x, starts, axis=1)
    rest = sizes * np.add.reduceat(x * x, starts, axis=1) - sums * sums
    return sums.astype(np.float64), np.sqrt(rest / sizes), sizes.astype(np.float64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of integers its nearest entry, ties to the lower one, the squared distance, and how many distances were taken."""
    n, k = len(x), len(entries)
    row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    best, taken = None, 0
    scale = np.einsum("ij,ij->i", x, x).astype(np.float64)[:, None] + np.einsum("ij,ij->i", entries, entries)[None, :]
    for s in _levels(x.shape[1]):
        (sx, rx, size), (se, re, _) = _segments(x, s), _segments(entries, s)
        low = np.zeros(len(row))
        for j in range(len(size)):
            low += (sx[row, j] - se[entry, j]) ** 2 / size[j] + (rx[row, j] - re[entry, j]) ** 2
        low -= 1e-12 * scale[row, entry]  # more than rounding can add
        if best is None:  # one entry for each row, the most promising one, gets its distance at once
            first = np.argmin(low.reshape(n, k), axis=1)
            d = x - entries[first]
            best, taken = np.einsum("ij,ij->i", d, d), n
        keep = low <= best[row]
        row, entry = row[keep], entry[keep]
    d = x[row] - entries[entry]
    exact = np.einsum("ij,ij->i", d, d)
    order = np.lexsort((entry, exact, row))
    row, entry, exact = row[order], entry[order], exact[order]
    at = np.flatnonzero(np.diff(row, prepend=-1))
    return entry[at], exact[at], taken + len(row)


def _blocks(column: pa.Array, dim: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Integer vectors as ``[row, part, position]``, some thousand rows at a time, with the first row's place."""
    step = max(1, (1 << 20) // max(1, dim))
    for a in range(0, len(column), step):
        part = column.slice(a, step)
        x = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), dim)
        width = -(-dim // parts)
        yield a, np.pad(x, ((0, 0), (0, width * parts - dim))).reshape(len(part), parts, width)


def _sums(dim: int, books: np.ndarray):
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            for _, x in _blocks(batch.column(0), dim, parts):
                for p in range(parts):
                    slot = p * k + nearest(x[:, p], books[p])[0]
                    np.add.at(total, slot, x[:, p])
                    count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        columns = [np.repeat(used, width), np.tile(np.arange(width), len(used)), np.repeat(count[used], width), total[used].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "place", "n", "total"])

    return run


def _encode(dim: int, books: np.ndarray):
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in _blocks(batch.column(0), dim, parts):
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
                code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                rest = [c.slice(a, len(x)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in code], pa.binary()), pa.array(sum(f[1] for f in found)), *rest], ["code", "error", *batch.schema.names[1:]])

    return run


def integers(df: DataFrame, vector: str, scale: float, *columns: str) -> DataFrame:
    """The usable vectors as integers in column ``x``, with other columns beside them."""
    held = lambda v: F.greatest(F.least(F.floor(v), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    wide = lambda v: F.greatest(F.least(v.cast("double") * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    e = F.col(vector)
    return df.filter(is_vector(e)).select(F.transform(e, lambda v: held(wide(v))).alias("x"), *columns)


def train(points: DataFrame, id_col: str, parts: int, entries: int, rounds: int) -> tuple[int, Codebooks]:
    """The dimension and the codebooks after ``rounds`` over stored integers."""
    first = points.orderBy(F.col(id_col).asc_nulls_last(), "x").limit(entries).collect()
    dim = len(first[0].x) if first else 0
    if any(len(r.x) != dim for r in first):
        first = points.filter(F.size("x") == dim).orderBy(F.col(id_col).asc_nulls_last(), "x").limit(entries).collect()
    width = -(-dim // parts)
    start = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        start[i, :dim] = r.x
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    vectors = points.select("x").filter(F.size("x") == dim)
    for _ in range(rounds if len(first) else 0):
        sums = vectors.mapInArrow(_sums(dim, books), "slot long, place long, n long, total long").groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = books.copy()
        for r in sums.collect():  # entries x dimension at most
            books[r.slot // len(first), r.slot % len(first), r.place] = r.total // r.n
    return dim, Codebooks(books)


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable vectors, one byte a part, with their squared errors and those of their label; and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    points = stored(integers(df, vector, scale, F.col(id_col).alias("id"), F.col(label).alias("label")))
    dim, books = train(points, "id", parts, entries, rounds)
    if dim:
        kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
        coded = points.filter(F.size("x") == dim).select("x", "id", "label").mapInArrow(_encode(dim, books.entries), f"code binary, error long, id {kinds['id']}, label {kinds['label']}")
    else:
        coded = points.select(F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), "id", "label").filter("false")
    coded = stored(coded)
    labels = small_side(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), BROADCAST_LABELS)
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label), "code", "error", "label_error"), books


def decompress(coded: DataFrame, books: Codebooks, scale: float = 4096.0) -> DataFrame:
    """The rows of ``compress`` with the vector that each code stands for, in column ``decoded``.

    The stored integers are floors, so half a unit is added back.
    """
    parts = books.entries.shape[0]
    table = F.array(*(F.array(*(F.array(*(F.lit((v + 0.5) / scale) for v in e.tolist())) for e in book)) for book in books.entries))
    place = lambda p: F.conv(F.substring(F.hex("code"), 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn("decoded", F.flatten(F.array(*(F.get(F.get(table, F.lit(p)), place(p)) for p in range(parts)))))
