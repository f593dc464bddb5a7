"""Alignment of two tokenizations of each text, and corpus-wide counts of linked token ids.

Text is encoded by a byte-level BPE (A) and a piece model with byte fallback (B). A transducer walks
both token sequences: its state is the side that leads and the bytes that the other side has not
matched yet. From the empty residual it takes A's next token; while A leads it takes B's next token,
and the other way round. A group closes when the residual is empty again, which is exactly where
tokens of both sides end. Transitions are kept by (state, next token), so bytes are compared once for
each such pair in a worker.

Both tokenizers always break at a single blank between other characters (A's pattern binds a blank to
what follows, no piece of B holds a blank after another character, which is checked). The walk is
therefore at the empty residual there, and what it does between two such places is kept by the
stretch of text: a repeated word costs one look-up. A worker that holds too many forgets those met
least.

Every document lists its distinct linked id pairs with their number. Document counts of pairs are
added up in each task and then by Spark. The pairs found in most documents, at most ``HEAVY``, are
broadcast to sum over documents where they are; the others are joined by pair.

Defined results: null and empty texts and those whose joined A or B bytes differ from a blank and the
text have no tokens, so numbers are zero and the digest is empty; strings of special tokens are plain
text; texts are encoded whole, whatever their length; rows of one id, or without one, are documents
of their own and each counts; of pairs with the same count each is the best; an empty table gives no
rows; only id and text are read, so no other column clashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs whose counts are broadcast, at most.
HEAVY = 1 << 18
#: Stretches, and transitions, that a worker keeps.
KEPT = 200_000
#: Characters of stretches that are encoded together.
JOINED = 4096
#: Links of a group up to which they are written one by one.
WIDE = 1024
#: Characters of text taken at once.
TAKEN = 1 << 20
#: Distinct pairs that a task counts before it sends them.
COUNTED = 1 << 20
_BREAK = re.compile(r"(?<=\S) (?=\S)")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Groups of two token sequences that spell the same bytes."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes_of = (a_bytes, b_bytes)
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.lead, self.rest = [1], [b""]  # nothing is open: A's token comes next, as if B led
        self.moves: dict[int, int] = {}

    def _state(self, side: int, rest: bytes) -> int:
        key = (side, rest) if rest else (0, b"")
        if key not in self.states:
            self.states[key] = len(self.lead)
            self.lead.append(side)
            self.rest.append(rest)
        return self.states[key]

    def _move(self, state: int, token: int) -> int:
        side, rest = self.lead[state], self.rest[state]
        new = self.bytes_of[1 - side][token]
        if rest.startswith(new):
            return self._state(side, rest[len(new) :])
        if new.startswith(rest):
            return self._state(1 - side, new[len(rest) :])
        raise ValueError("the sequences spell different bytes")

    def groups(self, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the groups in both sequences, which spell the same bytes."""
        if len(self.moves) > KEPT:
            self.clear()
        moves, lead, next_a, next_b = self.moves, self.lead, iter(a).__next__, iter(b).__next__
        # The state before each token, in the order in which tokens of both sides are taken.
        states, state = [0], 0
        then = states.append
        for _ in range(len(a) + len(b)):
            key = state << 32 | (next_a() if lead[state] else next_b())
            try:
                state = moves[key]
            except KeyError:
                state = moves[key] = self._move(key >> 32, key & 0xFFFFFFFF)
            then(state)
        before = np.array(states, np.int64)
        taken = np.cumsum(np.array(lead, np.int64)[before[:-1]])
        closed = np.flatnonzero(before[1:] == 0)
        return taken[closed], closed + 1 - taken[closed]


class Tokenizers:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        letters = _byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        ids = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]
        #: Whether no piece holds a blank after another character, so that stretches are encoded alike alone.
        self.breaks = not any(re.search("[^▁]▁", p) for p in pieces)
        self.transducer = Transducer(a_bytes, b_bytes)
        self.lengths = tuple(np.array([len(x) for x in side], np.int64) for side in (a_bytes, b_bytes))
        #: How a token is written: A's before a comma or a bar, then B's before a comma or a semicolon.
        self.written = [f"{i}{end}" for side, end_of_side in ((a_bytes, "|"), (b_bytes, ";")) for i in range(len(side)) for end in (",", end_of_side)]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Tokens of a blank and each text; None where the joined bytes differ from it."""
        a_bytes, b_bytes = self.transducer.bytes_of
        left = self.a.encode_batch_fast([" " + s for s in texts], add_special_tokens=False)
        right = self.b.encode(texts, num_threads=1)
        for s, x, y in zip(texts, left, right, strict=True):
            x, want = x.ids, (" " + s).encode()
            same = b"".join([a_bytes[i] for i in x]) == want == b"".join([b_bytes[i] for i in y])
            yield (x, y) if same else None


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]])


def _links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, id pairs and numbers of links; a large group gives each of its pairs once."""
    from_a, from_b = _starts(ends_a), _starts(ends_b)
    wide = ends_b - from_b
    n = (ends_a - from_a) * wide
    large = np.flatnonzero(n > WIDE)
    n[large] = 0
    group = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    pairs = a[from_a[group] + place // wide[group]] << 32 | b[from_b[group] + place % wide[group]]
    times = np.ones(len(pairs), np.int64)
    for g in large.tolist():
        (x, m), (y, k) = (np.unique(v, return_counts=True) for v in (a[from_a[g] : ends_a[g]], b[from_b[g] : ends_b[g]]))
        pairs = np.append(pairs, (x[:, None] << 32 | y).ravel())
        times = np.append(times, (m[:, None] * k).ravel())
        group = np.append(group, np.full(len(x) * len(y), g))
    if len(large):
        order = np.argsort(group, kind="stable")
        group, pairs, times = group[order], pairs[order], times[order]
    return group, pairs, times


class Stretches:
    """What the walk gives for each stretch of text that this worker has met.

    Column ``numbers``: tokens of A (-1 where bytes differ) and B, groups, links. The pairs of a
    stretch are ``sizes`` many from ``begins`` on.
    """

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.place: dict[str, int] = {}
        self.said: list[str] = []
        self.numbers, self.begins, self.sizes, self.uses = np.zeros((0, 4), np.int64), *(np.zeros(0, np.int64) for _ in range(3))
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the stretches that were met in most places, up to half of what a worker keeps."""
        if len(self.said) <= KEPT and len(self.pairs) <= 16 * KEPT:
            return
        by_use = np.argsort(-self.uses, kind="stable")
        fits = np.cumsum(self.sizes[by_use]) <= 8 * KEPT
        keep = np.sort(by_use[fits & (self.uses[by_use] > 1)][: KEPT // 2])
        names = list(self.place)
        self.place = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.said = [self.said[k] for k in keep.tolist()]
        take = _ragged(self.begins[keep], self.sizes[keep])
        self.pairs, self.times = self.pairs[take], self.times[take]
        self.numbers, self.sizes, self.uses = self.numbers[keep], self.sizes[keep], self.uses[keep] // 2
        self.begins = np.cumsum(self.sizes) - self.sizes

    def learn(self, new: list[str]) -> None:
        """Adds stretches, which are encoded some at a time with their blanks between them."""
        runs, size = [], JOINED
        for s in new:
            alone = not s or s[0].isspace() or s[-1].isspace()
            if alone or size + len(s) > JOINED:
                runs.append([])
                size = JOINED if alone else 0
            runs[-1].append(s)
            size += len(s)
        good, failed = [], []
        for run, found in zip(runs, self.tok.encode([" ".join(r) for r in runs]), strict=True):
            if found is not None:
                good.append((run, found))
            elif len(run) == 1:
                failed += run
            else:
                for s, each in zip(run, self.tok.encode(run), strict=True):
                    if each is None:
                        failed.append(s)
                    else:
                        good.append(([s], each))
        if good:
            self._add([s for run, _ in good for s in run], [t for _, (x, _) in good for t in x], [t for _, (_, y) in good for t in y])
        if failed:
            self._extend(failed, [""] * len(failed), np.tile([-1, 0, 0, 0], (len(failed), 1)), np.zeros(len(failed), np.int64), *(np.zeros(0, np.int64),) * 2)

    def _add(self, names: list[str], left: list[int], right: list[int]) -> None:
        ends_a, ends_b = self.tok.transducer.groups(left, right)
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        spelt = np.cumsum(self.tok.lengths[0][a])
        ends = np.cumsum([1 + len(s.encode()) for s in names])
        # The last group, A token and B token of each stretch.
        last = np.searchsorted(spelt[ends_a - 1], ends) + 1
        groups = np.diff(last, prepend=0)
        owner = np.repeat(np.arange(len(names)), groups)
        group, pairs, times = _links(a, b, ends_a, ends_b)
        sizes = np.bincount(owner[group], minlength=len(names))
        n_links = np.add.reduceat(times, np.cumsum(sizes) - sizes)
        numbers = np.stack([np.diff(ends_a[last - 1], prepend=0), np.diff(ends_b[last - 1], prepend=0), groups, n_links], axis=1)
        # Tokens as they are written, group by group.
        codes = np.empty(len(a) + len(b), np.int64)
        final_a, final_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        final_a[ends_a - 1] = final_b[ends_b - 1] = 1
        codes[np.arange(len(a)) + np.repeat(_starts(ends_b), np.diff(ends_a, prepend=0))] = 2 * a + final_a
        codes[np.arange(len(b)) + np.repeat(ends_a, np.diff(ends_b, prepend=0))] = 2 * len(self.tok.lengths[0]) + 2 * b + final_b
        written = list(map(self.tok.written.__getitem__, codes.tolist()))
        to = (ends_a + ends_b)[last - 1].tolist()
        said = ["".join(written[i:j]) for i, j in zip([0, *to], to, strict=False)]
        self._extend(names, said, numbers, sizes, pairs, times)

    def _extend(self, names: list[str], said: list[str], numbers: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        at = len(self.said)
        self.place.update(zip(names, range(at, at + len(names)), strict=True))
        self.said += said
        self.numbers = np.concatenate([self.numbers, numbers])
        self.begins = np.concatenate([self.begins, len(self.pairs) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(names), np.int64)])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])

    def places(self, texts: list[str]) -> list[list[int]]:
        """Places of the stretches of each text."""
        get, out, new = self.place.get, [], {}
        for text in texts:
            parts = text.split(" ") if self.tok.breaks else [text]
            found = list(map(get, parts, repeat(-1)))
            if -1 in found:
                unknown = [s for s, f in zip(parts, found, strict=True) if f < 0]
                if self.tok.breaks and ("" in unknown or list(map(str.strip, unknown)) != unknown):
                    # Blanks beside other white space: stretches end at single blanks between other characters only.
                    parts = _BREAK.split(text)
                    found = list(map(get, parts, repeat(-1)))
                    unknown = [s for s, f in zip(parts, found, strict=True) if f < 0]
                new.update(dict.fromkeys(unknown))
                out.append(parts)
            else:
                out.append(found)
        if new:
            self.learn(list(new))
        known = self.place.__getitem__
        return [list(map(known, f)) if isinstance(f[0], str) else f for f in out]


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches of a flat array, one after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@lru_cache(maxsize=1)
def _worker(byte_bpe: str, piece_bpe: str) -> Stretches:
    return Stretches(Tokenizers(byte_bpe, piece_bpe))


def _align(known: Stretches, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per text its numbers and digest; and the distinct (text, pair) with their links."""
    at = [k for k, t in enumerate(texts) if t]
    numbers, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    if not at:
        return numbers, digests, *(np.zeros(0, np.int64),) * 3
    known.forget()
    found = known.places([texts[k] for k in at])
    lengths = np.array([len(p) for p in found])
    flat = np.fromiter(chain.from_iterable(found), np.int64, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    sums = np.add.reduceat(known.numbers[flat], starts)
    failed = np.minimum.reduceat(known.numbers[flat, 0], starts) < 0
    numbers[at] = np.where(failed[:, None], 0, sums)
    said = known.said.__getitem__
    for k, places, bad in zip(at, found, failed.tolist(), strict=True):
        if not bad:
            digests[k] = hashlib.sha256("".join(map(said, places))[:-1].encode()).hexdigest()
    # Distinct stretches of each text, then their pairs.
    doc = np.repeat(np.arange(len(at)), lengths)
    keys, n = np.unique((doc * len(known.said) + flat)[~failed[doc]], return_counts=True)
    doc, which = keys // len(known.said), keys % len(known.said)
    known.uses += np.bincount(which, minlength=len(known.said))
    used, local = np.unique(which, return_inverse=True)
    pairs, dense = np.unique(known.pairs[_ragged(known.begins[used], known.sizes[used])], return_inverse=True)
    size = known.sizes[used]
    take = _ragged((np.cumsum(size) - size)[local], size[local])
    times = known.times[_ragged(known.begins[which], known.sizes[which])]
    key, links = np.repeat(doc, size[local]) * max(1, len(pairs)) + dense[take], np.repeat(n, size[local]) * times
    order = np.argsort(key)
    key, links = key[order], links[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    links = np.add.reduceat(links, first) if len(first) else links
    return numbers, digests, np.array(at)[key[first] // max(1, len(pairs))], pairs[key[first] % max(1, len(pairs))], links


ALIGNED = "row long, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _aligner(byte_bpe: str, piece_bpe: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or _worker(byte_bpe, piece_bpe)
            texts = batch.column(2)
            size = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])) if len(texts) else []
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + TAKEN)))
                numbers, digests, doc, pairs, links = _align(known, texts.slice(a, b - a).to_pylist())
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (pairs, links)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(numbers[:, c]) for c in range(4)), pa.array(digests, pa.string()), *lists],
                    ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                a = b

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that hold each pair, added up over a task as far as memory allows."""
    pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        more, m = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        both, place = np.unique(np.concatenate([pairs, more]), return_inverse=True)
        n = np.bincount(place, np.concatenate([n, m]), len(both)).astype(np.int64)
        pairs = both
        if len(pairs) > COUNTED:
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
            pairs, n = pairs[:0], n[:0]
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])


def _looked_up(heavy):
    """Sums over the broadcast pairs of each row, and its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = heavy.value
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in (1, 2))
            row = np.repeat(np.arange(len(batch)), np.asarray(pc.list_value_length(batch.column(1))))
            place = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            hit = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
            place, w, r = place[hit], times[hit], row[hit]
            total, top = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(total, r, w * counts[place])
            np.add.at(top, r, w * best[place])
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(batch)))]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(at, pa.array(v[~hit])) for v in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top), pa.array(total), *rest], ["row", "n_best", "count_sum", "pairs", "times"])

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Each linked pair, the documents that hold it, and whether no pair of its A id is in more."""
    counts = aligned.select("pairs").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", 32)))
    top = counts.groupBy("a").agg(F.max("n").alias("most"))
    return stored(counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _heavy_pairs(counts: DataFrame, most: int) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The least count, a power of two, that at most ``most`` pairs reach, and those pairs."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r.power: r.pairs for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("pairs")).collect()}  # 63 rows at most
    reach, held = 63, 0
    while reach > 0 and held + sizes.get(reach - 1, 0) <= most:
        reach -= 1
        held += sizes.get(reach, 0)
    rows = counts.filter(F.col("n") >= F.lit(1 << reach)).orderBy("pair").toPandas() if held else None  # at most ``most`` rows
    if rows is None:
        return 1 << reach, tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64))
    return 1 << reach, (rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(np.int64))


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> tuple[DataFrame, DataFrame]:
    """Aligned documents with their digests and linked pairs (``a << 32 | b``), and the counts of all pairs."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    aligned = stored(rows.mapInArrow(_aligner(byte_bpe, piece_bpe), ALIGNED.format(id=kind)))
    return aligned, pair_counts(aligned)


def score(aligned: DataFrame, counts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Per aligned document its links whose count is the highest of their A id, and the sum of counts over links."""
    least, table = _heavy_pairs(counts, heavy)
    shared = aligned.sparkSession.sparkContext.broadcast(table)
    found = stored(aligned.select("row", "pairs", "times").mapInArrow(_looked_up(shared), "row long, n_best long, count_sum long, pairs array<long>, times array<long>"))
    rest = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rest = rest.join(counts.filter(F.col("n") < F.lit(least)), "pair")
    rest = rest.select("row", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = found.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(sums, "row").drop("row", "pairs", "times")


def aligned_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Per document the numbers of its tokens, groups and links, the digest of its groups, and its links against the corpus."""
    return score(*align(docs, id_col, text, byte_bpe, piece_bpe)).withColumnRenamed("id", id_col)


def links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each document and linked pair: A and B ids, links in the document and documents of the pair."""
    each = aligned.select("id", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("id", F.col("p.pairs").alias("pair"), F.col("p.times").alias("links"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return each.join(counts, "pair").select("id", F.shiftright("pair", 32).alias("a_id"), b.alias("b_id"), "links", F.col("n").alias("documents"), "best")
