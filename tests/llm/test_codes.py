"""Product codes against plain integer arithmetic."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import codes


def plain(rows, parts=8, k=16, rounds=6):
    """rows: (id, vector, label) of one length that parts divides."""
    ints = [(i, [int(np.floor(4096 * float(x))) for x in v], lab) for i, v, lab in rows]
    width = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(ints, key=lambda r: (r[0] is None, r[0], r[1]))[:k]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in ints:
                members.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if j in members else e for j, e in enumerate(books[p])]
    out, by_label = [], {}
    for i, v, lab in ints:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append([i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), lab])
        by_label[lab] = by_label.get(lab, 0) + out[-1][2]
    said = ",".join(str(x) for b in books for e in b for x in e)
    return [(*r[:3], by_label[r[3]]) for r in out], hashlib.sha256(said.encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def taken(df):
    out, books = codes.compress(df)
    return in_order((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in out.collect()), books


def test_against_plain_arithmetic(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(16)], rng.choice([1, 2, None])) for k in range(300)]
    # Ties, repeated rows, a third of one vector, an id twice, no id.
    rows += [(1000 + k, [0.5] * 16, 7) for k in range(150)] + rows[:5] + [(3, [0.25] * 16, 1), (None, [-0.1] * 16, None)]
    bad = [(9, None, 1), (10, [], 1), (11, [float("nan")] * 16, 1), (12, [None] + [0.1] * 15, 1), (13, [float("-inf")] * 16, 1), (14, [0.1] * 15, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as x", "2 as id", "3 as error", "4 as of")
    got, books = taken(df)
    want, digest = plain(rows)
    assert got == in_order(want) and books.sha256() == digest
    shift, _ = taken(df.repartition(7))
    assert shift == got


@pytest.mark.parametrize("width", [1, 2, 3, 8, 70, 130])
def test_bounds_never_lose_the_nearest(width):
    rng = np.random.default_rng(width)
    for spread in (2, 50, codes.LIMIT):
        x, e = (rng.integers(-spread, spread + 1, (n, width)) for n in (200, 16))
        x[:20] = e[3]
        x[20:40] = (e[3] + e[5]) // 2
        entry, d, taken_ = codes.nearest(x, e)
        all_d = ((x[:, None] - e[None]) ** 2).sum(2)
        assert (d == all_d.min(1)).all() and (entry == all_d.argmin(1)).all() and taken_ >= len(x)


def test_far_entries_are_dropped_by_their_means():
    rng = np.random.default_rng(1)
    e = rng.integers(-3, 4, (16, 32)) + 1000 * np.arange(16)[:, None]
    x = np.repeat(e, 50, axis=0) + rng.integers(-3, 4, (800, 32))
    entry, _, taken_ = codes.nearest(x, e)
    assert (entry == np.repeat(np.arange(16), 50)).all() and taken_ == 2 * len(x)


def test_few_rows_odd_lengths_and_decoding(spark):
    df = spark.createDataFrame([(2, [0.5, -0.25, 0.125], None), (1, [1e30, 0.0, -1e30], None)], "vec_id long, embedding array<float>, label int")
    out, books = codes.compress(df, parts=2)
    rows = {r.vec_id: r for r in codes.decompress(out, books).collect()}
    assert books.entries.shape == (2, 2, 2) and rows[1].error == rows[2].error == rows[2].label_error == 0
    assert rows[2].decoded[:3] == pytest.approx([0.5, -0.25, 0.125], abs=1 / 4096) and rows[1].decoded[0] == pytest.approx(4096, abs=1)
    empty, none = codes.compress(df.limit(0))
    assert empty.count() == 0 and none.sha256() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        codes.compress(df, entries=300)


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(k, [k / 7.0] * 8, k % 3 if k % 5 else None) for k in range(60)], "vec_id long, embedding array<double>, label int")
    near, _ = taken(df)
    monkeypatch.setattr(codes, "BROADCAST_LABELS", -1)
    assert taken(df)[0] == near
