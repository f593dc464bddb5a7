"""Repeated byte strings: an enhanced suffix array and its common-prefix intervals.

``SuffixArray`` sorts the suffixes of many short strings by prefix doubling; the ranks of all rounds
give the common prefixes of neighbours. ``maximal_repeats`` scans the stack of common-prefix
intervals and returns those whose occurrences differ on their left: the maximal repeats, each with
all of its occurrences. Matches never reach beyond the end of a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class SuffixArray:
    """Suffixes of the strings that ``lengths`` cuts ``data`` into, sorted; ends differ from each other.

    With a ``depth``, a power of two, only so many bytes are compared, and common prefixes end there;
    this bounds memory and nesting for strings that repeat themselves.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray, depth: int = 0) -> None:
        n = len(data)
        self.data, self.n = data, n
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths)
        self.left = ends[self.owner] - np.arange(n) if n else np.empty(0, np.int64)
        rank = data.astype(np.int64)
        self.ranks = [data.astype(np.int32)]
        step = 1
        order = np.argsort(rank, kind="stable")
        longest = int(lengths.max()) if len(lengths) else 0
        while step < (min(longest, depth) if depth else longest):
            # A suffix that ends within the next step sorts before all others, by its string.
            after = np.full(n, -1, np.int64)
            inside = self.left > step
            after[inside] = rank[np.flatnonzero(inside) + step]
            after[~inside] = -1 - self.owner[~inside]
            order = np.lexsort((after, rank))
            fresh = np.ones(n, dtype=bool)
            fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh) - 1
            self.ranks.append(rank.astype(np.int32))
            step *= 2
            if fresh.all():
                break
        self.order, self.depth = order, depth
        self.lcp = self._common(order)

    def _common(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix with the one before it; 0 for the first."""
        lcp = np.zeros(self.n, np.int64)
        if self.n < 2:
            return lcp
        a, b = order[:-1].copy(), order[1:].copy()
        room = np.minimum(self.left[a], self.left[b])
        if self.depth:
            room = np.minimum(room, self.depth)
        got = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            for _ in range(2 if level == len(self.ranks) - 1 else 1):
                step = 1 << level
                ok = got + step <= room
                at = np.flatnonzero(ok)
                same = at[self.ranks[level][a[at]] == self.ranks[level][b[at]]]
                got[same] += step
                a[same] = np.minimum(a[same] + step, self.n - 1)
                b[same] = np.minimum(b[same] + step, self.n - 1)
        lcp[1:] = got
        return lcp


class LongSuffixes:
    """The suffixes of at least ``least`` bytes alone, sorted by up to ``MAX_WORDS`` words of eight bytes.

    For matches of ``least`` bytes no shorter suffix counts, which leaves out most where strings are
    short. Has the attributes of ``SuffixArray``; common prefixes end at ``depth`` or the end of a
    string, and ``depth`` covers all strings that are not longer than the words.
    """

    MAX_WORDS = 16

    def __init__(self, data: np.ndarray, lengths: np.ndarray, least: int) -> None:
        n = len(data)
        n_words = min(self.MAX_WORDS, -(-int(lengths.max()) // 8)) if n else 1
        self.data, self.n, self.depth = data, n, 8 * n_words
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths)
        self.left = ends[self.owner] - np.arange(n) if n else np.empty(0, np.int64)
        self.inside = np.repeat(lengths, lengths) - self.left
        places = np.flatnonzero(self.left >= least)
        padded = np.concatenate([data, np.zeros(8 * n_words + 8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        words = []
        for k in range(n_words):
            word = np.ascontiguousarray(eight[places + 8 * k]).view(">u8").ravel().astype(np.uint64)
            short = np.flatnonzero(self.left[places] < 8 * k + 8)
            drop = (8 * np.minimum(8, 8 * k + 8 - self.left[places[short]])).astype(np.uint64)
            cut = np.where(drop < 64, (word[short] >> np.minimum(drop, np.uint64(63))) << np.minimum(drop, np.uint64(63)), np.uint64(0))
            word[short] = cut
            words.append(word)
        by = np.lexsort(words[::-1])
        self.order = places[by]
        self.lcp = np.zeros(len(by), np.int64)
        if len(by) > 1:
            got, going = np.zeros(len(by) - 1, np.int64), np.arange(len(by) - 1)
            for word in words:
                w = word[by]
                apart = w[going] ^ w[going + 1]
                # Leading bytes that agree, which all eight do where the words do.
                got[going] += np.where(apart == 0, 8, (apart[:, None] >> np.arange(56, -8, -8, dtype=np.uint64)[None] == 0).sum(1))
                going = going[apart == 0]
            self.lcp[1:] = np.minimum(got, np.minimum(self.left[self.order[:-1]], self.left[self.order[1:]]))


def _left_bytes(sa: SuffixArray | LongSuffixes) -> np.ndarray:
    """The byte on the left of each suffix in order, or a number of its own for the beginning of a string."""
    first = np.ones(sa.n, dtype=bool)
    first[1:] = sa.owner[1:] != sa.owner[:-1]
    return np.where(first[sa.order], 256 + sa.order, sa.data[np.maximum(sa.order - 1, 0)].astype(np.int64))


def _stretches(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """First and last place of the runs in which neighbours share ``least`` bytes."""
    runs = np.flatnonzero(lcp >= least)
    if len(runs):
        cut = np.flatnonzero(np.diff(runs) > 1)
        yield from zip((runs[np.append(0, cut + 1)] - 1).tolist(), runs[np.append(cut, len(runs) - 1)].tolist(), strict=True)


def maximal_repeats(sa: SuffixArray | LongSuffixes, least: int) -> Iterator[tuple[int, int, int]]:
    """``(length, first, last)``: repeats of at least ``least`` bytes with their range in ``sa.order``.

    Left diversity: not all occurrences follow the same byte; beginnings of strings differ from all.
    Intervals are closed from the inside, so an outer one sees the left bytes of all inner ones.
    """
    left = _left_bytes(sa)
    for a, b in _stretches(sa.lcp, least):
        stack: list[list[int]] = []  # length, first suffix, left byte or -1 if they differ
        lefts = left[a : b + 1].tolist()
        for i, h in enumerate([*sa.lcp[a + 1 : b + 1].tolist(), 0]):
            first, seen = i, lefts[i]
            while stack and stack[-1][0] > h:
                length, first, mark = stack.pop()
                mark = mark if mark == seen else -1
                if mark == -1:
                    yield length, a + first, a + i
                seen = mark
            if h == 0:
                break
            if stack and stack[-1][0] == h:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else -1
            else:
                stack.append([h, first, seen])


def repeats_of_earlier(sa: SuffixArray | LongSuffixes, source: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of the occurrences of maximal repeats outside of their smallest source.

    ``source`` is given for each suffix in ``sa.order``. The scan closes common-prefix intervals from
    the inside. An interval that is left-diverse is a maximal repeat, and the suffixes of all sources
    but its smallest are given its length; in one that is not, all occurrences follow the same byte,
    and the interval of the string with that byte covers them (but for those that end at ``depth``).
    Only suffixes of the smallest source are handed on, as the others have had their longest repeat,
    which keeps the work in proportion to the suffixes however deep intervals nest.
    """
    found = np.zeros(len(sa.order), np.int64)
    lefts_of = _left_bytes(sa)
    depth = sa.depth or sa.n + 1
    for a, b in _stretches(sa.lcp, least):
        sources = source[a : b + 1].tolist()
        if min(sources) == max(sources):
            continue
        lefts = lefts_of[a : b + 1].tolist()
        # Of each open interval: length, left byte or -1, smallest source, its suffixes, those of others.
        stack: list[list] = []
        for i, h in enumerate([*sa.lcp[a + 1 : b + 1].tolist(), 0]):
            seen, low, held = lefts[i], sources[i], [a + i]
            while stack and stack[-1][0] > h:
                top = stack.pop()
                _join(top, seen, low, held)
                if top[4] and (top[1] == -1 or top[0] >= depth):
                    found[top[4]] = top[0]
                seen, low, held = top[1], top[2], top[3]
            if h == 0:
                break
            if stack and stack[-1][0] == h:
                _join(stack[-1], seen, low, held)
            else:
                stack.append([h, seen, low, held, []])
    at = np.flatnonzero(found)
    return sa.order[at], found[at]


def _join(top: list, seen: int, low: int, held: list[int]) -> None:
    """Adds suffixes of the source ``low`` with the left byte ``seen`` to an open interval."""
    if top[1] != seen:
        top[1] = -1
    mine = top[3]
    if low == top[2]:
        top[3], held = (mine, held) if len(mine) >= len(held) else (held, mine)
        top[3].extend(held)
    elif low < top[2]:
        top[2], top[3] = low, held
        top[4].extend(mine)
    else:
        top[4].extend(held)
