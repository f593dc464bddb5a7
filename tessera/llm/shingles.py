"""Word shingles of Arrow text batches as 64-bit hashes, in numpy.

Texts are UTF-8 bytes with A-Z lower-cased; words are runs of anything but ASCII blanks. A word's
hash is a polynomial over its bytes, mixed; a shingle's hash folds the hashes of its words. A text
of fewer words than a shingle has, but one at least, is one shingle of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are tokenized at once, which bounds memory for texts of any length.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(256)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null as empty, and where each begins."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _hash_piece(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of some bytes; words also end at ``edges``."""
    data = _LOWER[data]
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = edges[(edges > 0) & (edges < len(data))]
    first[at] = inside[at]
    places = np.flatnonzero(inside)
    if not len(places):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    heads = np.flatnonzero(first[places])
    starts = places[heads]
    lens = np.diff(np.append(heads, len(places)))
    pos = np.arange(len(places)) - np.repeat(heads, lens)
    powers = _POWERS if lens.max() <= len(_POWERS) else _powers(int(lens.max()))
    sums = np.add.reduceat(powers[pos] * (data[places].astype(np.uint64) + np.uint64(1)), heads)
    return mix(sums + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _hash_long(data: np.ndarray) -> Iterator[np.ndarray]:
    """Word hashes of one long text, piece by piece, cut at blanks."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data) and not _BLANK[data[end]]:
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1])
            else:  # a word longer than a piece
                total, scale, n = np.uint64(0), np.uint64(1), 0
                step = _powers(PIECE + 1)
                while True:
                    part = data[at : at + PIECE]
                    stop = np.flatnonzero(_BLANK[part])
                    part = part[: stop[0]] if len(stop) else part
                    with np.errstate(over="ignore"):
                        total = total + scale * (step[: len(part)] * (_LOWER[part].astype(np.uint64) + np.uint64(1))).sum(dtype=np.uint64)
                        scale = scale * step[len(part)]
                    n, at = n + len(part), at + len(part)
                    if len(stop) or at >= len(data):
                        break
                with np.errstate(over="ignore"):
                    yield mix(np.array([total + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93)], dtype=np.uint64))
                continue
        yield _hash_piece(data[at:end], np.empty(0, np.int64))[0]
        at = end


def _fold(h: np.ndarray, n: int) -> np.ndarray:
    out = h[: len(h) - n + 1]
    for j in range(1, n):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + h[j : len(h) - n + 1 + j])
    return mix(out + np.uint64(n))


def _sets(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each set begins."""
    counts = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    if len(h) >= k:
        whole = doc[: len(h) - k + 1] == doc[k - 1 :]
        hashes, owner = _fold(h, k)[whole], doc[: len(h) - k + 1][whole]
    else:
        hashes, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.searchsorted(doc, short)
        more = np.concatenate([_fold(h[b : b + counts[d]], int(counts[d])) for b, d in zip(begin, short, strict=True)])
        hashes, owner = np.concatenate([hashes, more]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    at = np.searchsorted(owner, np.arange(n_docs + 1))
    hashes = hashes.copy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.searchsorted(owner[fresh], np.arange(n_docs + 1))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: number of the first, all set members, where each set begins (and the end)."""
    data, at = text_bytes(column)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
            part = data[at[i] : at[j]]
            if len(part) > 2 * PIECE:
                pieces = list(_hash_long(part))
                h = np.concatenate(pieces) if pieces else np.empty(0, np.uint64)
                doc = np.zeros(len(h), np.int64)
            else:
                h, starts = _hash_piece(part, at[i : j + 1] - at[i])
                doc = np.searchsorted(at[i : j + 1] - at[i], starts, side="right") - 1
            yield i, *_sets(h, doc, j - i, k)
            i = j
