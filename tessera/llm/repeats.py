"""Removal of byte strings that begin in an earlier document, over all documents.

A suffix array of the whole corpus would move every byte position many times over, so it is built in
shards that cannot separate equal strings:

1. Every window of ``WINDOW`` bytes has an anchor: the least hash of its ``ANCHOR``-byte strings.
   Windows with one anchor in a row form a run. Equal windows have equal anchors, so all their
   occurrences meet in the shard of the anchor. A shared window also holds the ``SIDE`` bytes left
   of its anchor, or those right of it; runs that share neither with another document are done.
2. The bytes of the other runs go to their shard. There equal runs become one, and an enhanced suffix
   array of the unlike ones is scanned by the stack of its common-prefix intervals. Intervals whose
   occurrences differ on their left are the maximal repeats; all occurrences of a repeat outside of
   its earliest document are cut, and all of them are listed by ``repeat_groups``.
3. The cuts meet the texts.

Nothing is removed by hash alone: hashes say which bytes to compare. Texts that equal an earlier
document's (by SHA-256) are removed whole before. Strings that are frequent in all texts are anchors
only of windows that hold nothing else, so that what borders on a common passage is dealt by its own
strings; equal runs are told within a task before they are sent. Every string of every text is counted,
by a bucket of its hash, so a bucket's number is never below that of its strings, and anchors depend on
the rows alone, however they are stored. Shards and places grow with the number of bytes.

Defined results: null text is empty; texts below the window lose nothing; texts of one id, equal or
not, are rows each and don't remove each other's bytes; rows without an id are returned whole and
remove nothing; an empty table gives no rows; columns of the input don't clash, as only id and text
are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir, stored
from .bounded import small_side
from .shingles import mix
from .suffix import LongSuffixes, maximal_repeats, repeats_of_earlier

WINDOW, ANCHOR, SIDE = 50, 20, 15
#: Bytes hashed at once, and bytes of text before a task passes its findings on.
PIECE, FLUSH = 1 << 19, 16 << 20
#: Bytes hashed at once where strings are only counted.
COUNT_PIECE = 1 << 17
#: Bytes of text for each shard and place, and for each task of a shuffle.
PLACE_BYTES, TASK_BYTES = 32 << 20, 256 << 20
#: Bytes of unlike runs in one suffix array; runs of one anchor stay together.
ARRAY_BYTES = 4 << 20
#: Buckets in which strings are counted by their hash, and how many of them make a row.
BUCKETS, SLICE = 1 << 24, 1 << 16
#: A string is frequent in so many documents, in so large a share, and so many times the bytes a bucket has,
#: so that unlike strings of a bucket seldom add up.
FREQUENT_DOCS, FREQUENT_SHARE, FREQUENT_MEAN = 16, 0.0005, 4
#: Ids are broadcast up to so many.
BROADCAST_IDS = 1_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_LOW6 = np.uint64(63)
_MASK40 = np.uint64((1 << 40) - 1)
_BUCKET = np.uint64(BUCKETS - 1)
_NONE, _ANY = 0, 65535
_RUN, _CUT, _ASK, _BYTES, _TEXT, _COUNT = range(6)
_ROUTED = "place int, kind int, id long, tag int, blob binary"
_FIELDS = ["place", "kind", "id", "tag", "blob"]
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
#: Columns of packed entries: anchors in two parts, documents by id and tag, places and sizes in bytes.
_DTYPES = {
    _RUN: ("u4", "u1", "u2", "u2", "i8", "u2", "u4", "u4"),
    _CUT: ("i8", "u2", "u4", "u4"),
    _ASK: ("u4", "u1", "u4", "i8", "u2", "u4", "u4"),
    _BYTES: ("u4", "u1", "i8", "u2", "u4", "u4"),
}


def _pack(columns: list[np.ndarray], kind: int) -> bytes:
    """Columns by byte plane, which lets the shuffle's compression drop the empty planes."""
    n = len(columns[0])
    parts = [np.ascontiguousarray(c.astype(f"<{t}")).view(np.uint8).reshape(n, np.dtype(t).itemsize).T.tobytes() for c, t in zip(columns, _DTYPES[kind], strict=True)]
    return n.to_bytes(4, "little") + b"".join(parts)


def _unpack(blob: bytes, kind: int) -> tuple[list[np.ndarray], int]:
    n, at, out = int.from_bytes(blob[:4], "little"), 4, []
    for t in _DTYPES[kind]:
        width = np.dtype(t).itemsize
        planes = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<{t}").ravel())
        at += n * width
    return out, at


def _gather(blobs: list[bytes], kind: int) -> list[np.ndarray]:
    if not blobs:
        return [np.empty(0, t) for t in _DTYPES[kind]]
    return [np.concatenate(c) for c in zip(*(_unpack(b, kind)[0] for b in blobs), strict=True)]


def _long(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [c.astype(np.int64) for c in columns]


def _split(columns: list[np.ndarray], place: np.ndarray, kind: int) -> Iterator[tuple]:
    """One row for each place with the entries that go there."""
    if not len(place):
        return
    order = np.argsort(place, kind="stable")
    place, columns = place[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(place)), strict=True):
        yield int(place[a]), kind, None, None, _pack([c[a:b] for c in columns], kind)


def _emit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"")
        if size > 1 << 20 or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], _FIELDS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], _FIELDS)


def _flat(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``begin[i] .. begin[i] + size[i]`` of all i in a row."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


def _column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a binary column, and where each begins (and the end)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from each place on."""
    h, step = data.astype(np.uint64) + np.uint64(1), 1
    parts = {}
    while step <= ANCHOR:
        parts[step] = h
        if 2 * step > ANCHOR:
            break
        h = h[: len(h) - step] * (_MULT + np.uint64(2 * step)) + h[step:]
        step *= 2
    rest, at = ANCHOR - step, step
    while rest:
        size = 1 << (rest.bit_length() - 1)
        m = len(data) - at - size + 1
        h = h[:m] * (_MULT ^ np.uint64(size << 8)) + parts[size][at : at + m]
        at, rest = at + size, rest - size
    return mix(h)


class Frequent:
    """The buckets of frequent strings, as bits."""

    def __init__(self, buckets: np.ndarray) -> None:
        table = np.zeros(BUCKETS, bool)
        table[buckets] = True
        self.some, self.bits = len(buckets) > 0, np.packbits(table, bitorder="little")

    def mark(self, h: np.ndarray) -> np.ndarray:
        if not self.some:
            return np.zeros(len(h), bool)
        at = (h & _BUCKET).astype(np.uint32)
        return (self.bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _least(x: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` neighbours."""
    have = 1
    while have < wide:
        shift = min(have, wide - have)
        x = np.minimum(x[: len(x) - shift], x[shift:])
        have += shift
    return x


def _runs(data: np.ndarray, ends: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, ...]:
    """Starts, sizes in bytes, anchors and both side hashes of the runs of texts that end at ``ends``.

    A side is ``_NONE`` if no window of the run reaches so far, and ``_ANY`` on both sides if the run
    holds its anchor more than once. The low six bits of hashes make room for places modulo 64.
    """
    n, wide = len(data) - WINDOW + 1, WINDOW - ANCHOR + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    h = _hashes(data)
    key = (h >> np.uint64(1)) & ~_LOW6 | frequent.mark(h).astype(np.uint64) << np.uint64(63)
    place = np.arange(len(key), dtype=np.uint64) & _LOW6
    least, other = _least(key | place, wide), _least(key | (_LOW6 - place), wide)
    anchor = least & ~_LOW6
    valid = np.ones(n, dtype=bool)
    begins = np.append(0, ends[:-1])
    for e in ends:
        valid[max(0, e - WINDOW + 1) : e] = False
    change = np.ones(n, dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    change[begins[begins < n]] = True
    starts = np.flatnonzero(change & valid)
    stops = np.flatnonzero(np.append(change | ~valid, True))
    count = stops[np.searchsorted(stops, starts, side="right")] - starts
    size = count + WINDOW - 1

    last = starts + count - 1
    at = lambda i: i + ((least[i] & _LOW6).astype(np.int64) - i & 63)
    once = lambda i: (least[i] & _LOW6) + (other[i] & _LOW6) == _LOW6
    where = at(starts)
    wild = ~once(starts) | ~once(last) | (where != at(last)) | (count > wide)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    word = lambda i: np.ascontiguousarray(eight[i]).view("<u8").ravel()

    def side(ok: np.ndarray, a: np.ndarray) -> np.ndarray:
        a = np.where(ok, a, starts)
        told = mix(mix(word(a)) + word(a + SIDE - 8)) % np.uint64(_ANY - 1)
        return np.where(wild, _ANY, np.where(ok, told.astype(np.int64) + 1, _NONE))

    left = side(where - SIDE >= starts, where - SIDE)
    right = side(where + ANCHOR + SIDE <= starts + size, where + ANCHOR)
    return starts, size, anchor[starts], left, right


def _pieces(at: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Parts of texts that begin at ``at``: first and last text, first and last byte; long texts overlap by a window."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        long = j == i + 1
        for a in range(int(at[i]), int(at[j]), size if long else 1 << 62):
            yield i, j, a, min(int(at[j]), a + size + WINDOW - 1) if long else int(at[j])
        i = j


def _width(least: int) -> str:
    """The type of numbers up to ``least``."""
    return next(t for t in ("<u1", "<u2", "<u4", "<u8") if least <= np.iinfo(t).max)


def _count(least: int):
    """All texts to the number of them with a string of each bucket, by slice of buckets; ``least`` stands for it and more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        # No number goes beyond ``least``, so it is held as narrow as it is sent.
        count = np.zeros(BUCKETS, _width(least))
        for batch in batches:
            data, at = _column_bytes(batch.column(0))
            long, seen = -1, np.empty(0, bool)
            for i, j, a, b in _pieces(at, min(PIECE, COUNT_PIECE)):
                if b - a < ANCHOR:
                    continue
                ends = np.minimum(at[i + 1 : j + 1], b) - a
                with np.errstate(over="ignore"):
                    h = _hashes(data[a:b])
                text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(h)]
                inside = ends[text] - np.arange(len(h)) >= ANCHOR
                key = np.sort(((h & _BUCKET) << np.uint64(32) | text.astype(np.uint64))[inside])
                # A text counts once in a bucket.
                bucket = (key[np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])] >> np.uint64(32)).astype(np.int64)
                if b - a < at[j] - at[i]:
                    long, seen = (long, seen) if long == i else (i, np.zeros(BUCKETS, bool))
                    bucket = bucket[~seen[bucket]]
                    seen[bucket] = True
                heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
                several = np.diff(np.append(heads, len(bucket)))
                count[bucket[heads]] = np.minimum(count[bucket[heads]].astype(np.int64) + several, least)
        for k in range(0, BUCKETS, SLICE):
            part = count[k : k + SLICE]
            if part.any():
                yield k // SLICE, _COUNT, None, None, pa.compress(part.tobytes(), "zstd", asbytes=True)

    return lambda batches: _emit(rows(batches))


def _often(least: int):
    """Per slice: the buckets with ``least`` texts, as bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        counts = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(4), strict=True))
        for place, group in groupby(counts, lambda row: row[0]):
            total = np.zeros(SLICE, np.int64)
            for _, blob in group:
                total += np.frombuffer(pa.decompress(blob.as_py(), SLICE * np.dtype(_width(least)).itemsize, "zstd"), _width(least))
            if (total >= least).any():
                yield place, _COUNT, None, None, np.packbits(total >= least).tobytes()

    return lambda batches: _emit(rows(batches))


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``a`` on equal those from ``b`` on."""
    out = np.empty(len(a), bool)
    for part in np.array_split(np.arange(len(a)), max(1, int(size.sum()) >> 22)):
        if len(part):
            same = data[_flat(a[part], size[part])] == data[_flat(b[part], size[part])]
            out[part] = np.logical_and.reduceat(same, np.cumsum(size[part]) - size[part])
    return out


def _scan(shards: int, places: int, frequent: Frequent, tell: bool):
    """Texts (id, tag, text) to runs, by the shard of their anchor; with ``tell``, runs repeated within the task to cuts, by document."""

    def flush(held: list[tuple], texts: list[np.ndarray]) -> Iterator[tuple]:
        doc, tag, start, place, size, anchor, left, right = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((start, doc, size, right, left, anchor))
        doc, tag, start, place, size, anchor, left, right = (c[order] for c in (doc, tag, start, place, size, anchor, left, right))
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (size[1:] != size[:-1])
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        again = np.flatnonzero(doc > doc[first]) if tell else np.empty(0, np.int64)
        if len(again):
            again = again[_same_bytes(np.concatenate(texts), place[again], place[first[again]], size[again])]
            yield from _split([doc[again], tag[again], start[again], size[again]], doc[again] % places, _CUT)
        new = np.ones(len(doc), bool)
        new[again] = False
        new = np.flatnonzero(new)
        new = new[np.lexsort((start[new], doc[new]))]
        low = anchor[new] & _MASK40
        columns = [low >> np.uint64(8), low & np.uint64(255), left[new], right[new], doc[new], tag[new], start[new], size[new]]
        yield from _split(columns, ((anchor[new] >> np.uint64(40)) % np.uint64(shards)).astype(np.int64), _RUN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        texts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, at = _column_bytes(batch.column(2))
            for i, j, a, b in _pieces(at, PIECE):
                ends = np.minimum(at[i + 1 : j + 1], b) - a
                with np.errstate(over="ignore"):
                    starts, sizes, anchor, left, right = _runs(data[a:b], ends, frequent)
                doc = np.searchsorted(ends, starts, side="right") + i
                held.append((ids[doc], tags[doc].astype(np.int64), starts + a - at[doc], starts + size, sizes, anchor, left, right))
                texts.append(data[a:b].copy())
                size += b - a
                if size > FLUSH:
                    yield from flush(held, texts)
                    held, texts, size = [], [], 0
        if held:
            yield from flush(held, texts)

    return lambda batches: _emit(rows(batches))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with equal place; cuts are yielded alone, as they come."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[1] == _CUT:
                yield [row]
                continue
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _met(doc: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Whether another document has an entry with the same key."""
    if not len(doc):
        return np.zeros(0, bool)
    order = np.lexsort(key)
    heads = np.zeros(len(doc), bool)
    heads[0] = True
    for k in key:
        heads[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(heads)
    several = np.minimum.reduceat(doc[order], at) != np.maximum.reduceat(doc[order], at)
    out = np.empty(len(doc), bool)
    out[order] = several[np.cumsum(heads) - 1]
    return out


def _resolve(places: int):
    """Per anchor shard: questions for the bytes of runs that share a side of their anchor with another document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in _groups(batches):
            if group[0][1] == _CUT:
                yield group[0]
                continue
            columns = _gather([r[4] for r in group], _RUN)
            keep = np.flatnonzero(_met(columns[4], columns[0].astype(np.int64) << 8 | columns[1]))
            hi, lo, left, right, doc, tag, start, size = _long([c[keep] for c in columns])
            anchor = hi << 8 | lo
            ask = _met(doc, left, anchor) & (left != _NONE) | _met(doc, right, anchor) & (right != _NONE)
            # Runs that hold their anchor more than once may match any other.
            ask |= np.isin(anchor, anchor[left == _ANY])
            anchor = [hi[ask], lo[ask]]
            columns = [*anchor, np.full(int(ask.sum()), group[0][0]), doc[ask], tag[ask], start[ask], size[ask]]
            yield from _split(columns, doc[ask] % places, _ASK)

    return lambda batches: _emit(rows(batches))


class _Told:
    """Entries about documents, sorted by document."""

    def __init__(self, blobs: list[bytes], kind: int, key: int) -> None:
        columns = _long(_gather(blobs, kind))
        order = np.argsort(columns[key], kind="stable")
        self.columns, self.key = [c[order] for c in columns], key
        doc = self.columns[key]
        heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
        self.where = {int(doc[a]): (int(a), int(b)) for a, b in zip(heads, np.append(heads[1:], len(doc)), strict=True)}

    def of(self, doc: int, tag: int) -> list[np.ndarray]:
        a, b = self.where.get(doc, (0, 0))
        mine = self.columns[self.key + 1][a:b] == tag
        return [c[a:b][mine] for c in self.columns]


def _with_texts(batches: Iterator[pa.RecordBatch], kind: int, key: int) -> Iterator[tuple[int, int, bytes, list[np.ndarray]]]:
    """The texts of each place with the entries about them, which come first."""
    place, blobs, told = None, [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != place:
                place, blobs, told = row[0], [], None
            if row[1] == kind:
                blobs.append(row[4])
                continue
            if told is None:
                told = _Told(blobs, kind, key)
                blobs = []
            yield row[2], row[3], row[4], told.of(row[2], row[3])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that were asked for, by the shard that asks."""

    def flush(held: list[list[np.ndarray]], parts: list[np.ndarray]) -> Iterator[tuple]:
        hi, lo, shard, doc, tag, start, size = (np.concatenate(c) for c in zip(*held, strict=True))
        data, begin = np.concatenate(parts), np.cumsum(size) - size
        order = np.argsort(shard, kind="stable")
        heads = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1]))
        for a, b in zip(heads, np.append(heads[1:], len(order)), strict=True):
            o = order[a:b]
            head = _pack([c[o] for c in (hi, lo, doc, tag, start, size)], _BYTES)
            yield int(shard[o[0]]), _BYTES, None, None, head + data[_flat(begin[o], size[o])].tobytes()

    def rows() -> Iterator[tuple]:
        held, parts, size = [], [], 0
        for _, _, text, asks in _with_texts(batches, _ASK, 3):
            if not len(asks[0]):
                continue
            held.append(asks)
            parts.append(np.frombuffer(text, np.uint8)[_flat(asks[5], asks[6])])
            size += len(parts[-1])
            if size > FLUSH:
                yield from flush(held, parts)
                held, parts, size = [], [], 0
        if held:
            yield from flush(held, parts)

    return _emit(rows())


class _Shard:
    """The runs of a shard: unlike ones with the documents that hold them."""

    def __init__(self, group: list[tuple]) -> None:
        heads, texts = [], []
        for r in group:
            columns, at = _unpack(r[4], _BYTES)
            heads.append(columns)
            texts.append(np.frombuffer(r[4], np.uint8, offset=at))
        hi, lo, doc, tag, start, size = _long([np.concatenate(c) for c in zip(*heads, strict=True)])
        offsets = np.append(0, np.cumsum(size))
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(texts))])
        told = runs.dictionary_encode()
        code = told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((start, doc, code))
        self.code, self.doc, self.tag, self.start, self.size = (c[order] for c in (code, doc, tag, start, size))
        self.heads = np.flatnonzero(np.append(True, self.code[1:] != self.code[:-1]))
        self.runs, self.first = told.dictionary, self.doc[self.heads]
        self.later = self.doc > self.first[self.code]
        self.anchor = (hi << 8 | lo)[order][self.heads]

    def arrays(self) -> Iterator[tuple[np.ndarray, LongSuffixes]]:
        """Suffix arrays of the unlike runs of each anchor, where they are of several documents."""
        unlike = np.flatnonzero(_met(self.first, self.anchor))
        unlike = unlike[np.argsort(self.anchor[unlike], kind="stable")]
        size = self.size[self.heads[unlike]]
        fresh = np.append(True, self.anchor[unlike][1:] != self.anchor[unlike][:-1])
        room, a = np.cumsum(size), 0
        while a < len(unlike):
            b = int(np.searchsorted(room, (room[a - 1] if a else 0) + ARRAY_BYTES, side="right"))
            b = max(b, a + 1)
            while b < len(unlike) and not fresh[b]:
                b += 1
            codes = unlike[a:b]
            data, _ = _column_bytes(self.runs.take(pa.array(codes)))
            yield codes, LongSuffixes(data, size[a:b], WINDOW)
            a = b

    def holders(self, code: np.ndarray, first_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """For runs by code: index into ``code`` and entry of each document that holds it, or of the first."""
        count = np.diff(np.append(self.heads, len(self.code)))
        if first_only:
            count = np.add.reduceat((~self.later).astype(np.int64), self.heads) if len(self.heads) else count
        n = count[code]
        return np.repeat(np.arange(len(code)), n), _flat(self.heads[code], n)


def _cuts(places: int):
    """Per shard: the occurrences of maximal repeats outside of their earliest document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in _groups(batches):
            s = _Shard(group)
            doc, tag, start, size = ([c[s.later]] for c in (s.doc, s.tag, s.start, s.size))
            for codes, sa in s.arrays():
                place, length = repeats_of_earlier(sa, s.first[codes[sa.owner[sa.order]]], WINDOW)
                of, entry = s.holders(codes[sa.owner[place]], True)
                doc.append(s.doc[entry])
                tag.append(s.tag[entry])
                start.append(s.start[entry] + sa.inside[place][of])
                size.append(length[of])
            doc = np.concatenate(doc)
            yield from _split([doc, *(np.concatenate(c) for c in (tag, start, size))], doc % places, _CUT)

    return lambda batches: _emit(rows(batches))


GROUP = "repeat string, length long, doc_id long, start long"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard: every maximal repeat with all its occurrences."""
    import hashlib

    names = ["repeat", "length", "doc_id", "start"]

    def batch(name: list[str], length: list[int], doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(length, pa.int64()), pa.array(doc), pa.array(start)], names)

    for group in _groups(batches):
        s = _Shard(group)
        several = np.unique(s.code[s.later])
        for c in several.tolist():
            _, entry = s.holders(np.array([c]), False)
            told, n = hashlib.sha256(s.runs[c].as_py()).hexdigest(), int(s.size[entry[0]])
            yield batch([told] * len(entry), [n] * len(entry), s.doc[entry], s.start[entry])
        for codes, sa in s.arrays():
            for length, a, b in maximal_repeats(sa, WINDOW):
                place = sa.order[a : b + 1]
                of, entry = s.holders(codes[sa.owner[place]], False)
                told = hashlib.sha256(sa.data[place[0] : place[0] + length].tobytes()).hexdigest()
                yield batch([told] * len(entry), [length] * len(entry), s.doc[entry], s.start[entry] + sa.inside[place][of])


KEPT = "doc_id long, tag int, n_bytes long, begins array<long>, ends array<long>, kept binary"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their cuts, and the places of what is removed."""
    names = ["doc_id", "tag", "n_bytes", "begins", "ends", "kept"]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    held, size = [], 0
    for doc, tag, text, (_, _, begin, length) in _with_texts(batches, _CUT, 0):
        end = begin + length
        kept = text
        if len(begin):
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            fresh = np.append(True, begin[1:] > end[:-1])
            begin, end = begin[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]
            kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True))
        held.append((doc, tag, len(text), begin.tolist(), end.tolist(), kept))
        size += len(kept) + 200
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _ids(kind: int, key: int):
    """The distinct documents that packed entries are about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(4).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_unpack(blob, kind)[0][key]))], ["wanted"])

    return run


def _prime(n: int) -> int:
    """The first prime from ``n`` on: documents are dealt by remainder, and ids may share a factor."""
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


class _Job:
    """The steps up to the bytes of runs, and what the later ones need."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, tell: bool = True) -> None:
        self.spark = docs.sparkSession
        self.base = f"{shared_dir(self.spark)}/repeats-{uuid.uuid4().hex}"
        text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        told = F.xxhash64("text")
        digests = self.rows.filter("doc_id is not null").select("doc_id", told.alias("told"), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
        digests = stored(digests, f"{self.base}/digests")
        firsts = digests.filter(F.col("n_bytes") >= WINDOW).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
        copies = digests.join(small_side(firsts, BROADCAST_IDS), "digest").filter("doc_id > first").select("doc_id", "told", "n_bytes")
        self.copies = stored(copies, f"{self.base}/copies")
        named = self.rows.filter("doc_id is not null").withColumn("told", told)
        named = named.join(small_side(self.copies.select("doc_id", "told").distinct(), BROADCAST_IDS), ["doc_id", "told"], "left_anti")
        # Texts of one id are told apart by a number.
        several = digests.groupBy("doc_id").agg(F.min("told").alias("lo"), F.max("told").alias("hi")).filter("lo <> hi").select("doc_id")
        several = stored(several, f"{self.base}/several")
        if several.isEmpty():
            units = named.select("doc_id", F.lit(0).alias("tag"), "text")
        else:
            tags = digests.join(several, "doc_id").select("doc_id", "told").distinct().withColumn("tag", F.row_number().over(Window.partitionBy("doc_id").orderBy("told")))
            units = named.join(small_side(tags, BROADCAST_IDS), ["doc_id", "told"], "left").select("doc_id", F.coalesce("tag", F.lit(0)).alias("tag"), "text")
        # Every later step reads the texts, so what is left of them is told once.
        self.units = stored(units, f"{self.base}/units")
        total, n = digests.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
        self.tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
        self.places = _prime(max(self.tasks, -(-total // PLACE_BYTES)))
        least = math.ceil(max(FREQUENT_DOCS, FREQUENT_SHARE * n, FREQUENT_MEAN * total / BUCKETS))
        often = self.dealt(self.units.select("text").mapInArrow(_count(least), _ROUTED)).mapInArrow(_often(least), _ROUTED)
        often = stored(often, f"{self.base}/often").select("place", "blob").collect()
        bits = [r.place * SLICE + np.flatnonzero(np.unpackbits(np.frombuffer(r.blob, np.uint8))) for r in often]
        frequent = Frequent(np.concatenate([np.empty(0, np.int64), *bits]))
        runs = self.units.mapInArrow(_scan(self.places, self.places, frequent, tell), _ROUTED)
        self.found = stored(self.dealt(runs).mapInArrow(_resolve(self.places), _ROUTED), f"{self.base}/found")
        asks = self.found.filter(F.col("kind") == _ASK)
        wanted = self.wanted(asks, _ASK, 3)
        self.bytes = self.dealt(self.dealt(asks.unionByName(self.texts(wanted))).mapInArrow(_answer, _ROUTED))

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.repartitionById(self.tasks, F.col("place") % self.tasks).sortWithinPartitions("place", "kind")

    def wanted(self, entries: DataFrame, kind: int, key: int) -> DataFrame | None:
        """The documents that entries are about, if few enough to be broadcast."""
        ids = stored(entries.mapInArrow(_ids(kind, key), "wanted long").distinct(), f"{self.base}/wanted-{kind}")
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else None

    def texts(self, wanted: DataFrame | None) -> DataFrame:
        """The texts as routed rows; all of them where ``wanted`` is none, which gives the same results."""
        units = self.units if wanted is None else self.units.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
        return units.select(F.pmod("doc_id", F.lit(self.places)).cast("int").alias("place"), F.lit(_TEXT).alias("kind"), F.col("doc_id").alias("id"), "tag", F.col("text").alias("blob"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_bytes, spans`` (what is removed, in bytes, ends exclusive) and ``kept``, the rest."""
    job = _Job(docs, id_col, text_col)
    more = stored(job.bytes.mapInArrow(_cuts(job.places), _ROUTED), f"{job.base}/cuts")
    cuts = job.found.filter(F.col("kind") == _CUT).unionByName(more)
    wanted = job.wanted(cuts, _CUT, 0)
    cut = job.dealt(cuts.unionByName(job.texts(wanted))).mapInArrow(_remove, KEPT)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    size = F.octet_length("text").cast("long")
    spans = F.zip_with("begins", "ends", lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    out = cut.select("doc_id", "n_bytes", spans.alias("spans"), "kept")
    if wanted is not None:
        whole = job.units.join(wanted, F.col("doc_id") == F.col("wanted"), "left_anti")
        out = out.unionByName(whole.select("doc_id", size.alias("n_bytes"), none.alias("spans"), F.col("text").alias("kept")))
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    gone = job.copies.select("doc_id", "n_bytes", all_of.alias("spans"), F.lit("").cast("binary").alias("kept"))
    nameless = job.rows.filter("doc_id is null").select("doc_id", size.alias("n_bytes"), none.alias("spans"), F.col("text").alias("kept"))
    return out.unionByName(gone).unionByName(nameless)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every maximal repeat with all its occurrences: ``repeat`` (its SHA-256), ``length, doc_id, start``.

    Whole copies of a document are left out. Repeats are maximal within the stretch of text that has
    one anchor, so a longer one is listed as several that overlap by less than ``WINDOW`` bytes.
    """
    return _Job(docs, id_col, text_col, tell=False).bytes.mapInArrow(_listed, GROUP).distinct()
