"""Nearest vectors against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collisions


def plain(rows, k, every=20):
    """rows: (id, vector); each row whose id is divisible by ``every`` asks, all other rows answer."""
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    first = min(ok, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))[1] if ok else []
    ok = [r for r in ok if len(r[1]) == len(first)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % every == 0:
            scores = []
            for b, (j, v) in enumerate(ok):
                if a != b:
                    s = 0.0
                    for x, y in zip(q.tolist(), v.tolist(), strict=True):
                        s += x * y
                    scores.append((-s, j is None, j or 0))
            out += [(i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(sorted(scores)[:k])]
    return out


def found(spark, rows, k, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as row", "2 as id", "3 as e", "4 as kind")
    return [tuple(r) for r in collisions.search(collisions.build_index(df), F.col("id") % 20 == 0, k, **options).collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3]))


def cases(seed):
    rng = np.random.default_rng(seed)
    noise = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 12)))]
    near = rng.normal(size=(8, 12))
    grouped = [(1000 + i, (near[i % 8] + 0.05 * rng.normal(size=12)).tolist()) for i in range(600)]
    lengths = [(2000 + i, (v * 10.0 ** rng.integers(-3, 4)).tolist()) for i, v in enumerate(rng.normal(size=(300, 12)))]
    lattice = [(3000 + i, v.tolist()) for i, v in enumerate(rng.integers(-1, 2, (300, 12)).astype(float))]
    hot = [(4000 + i, near[0].tolist()) for i in range(900)]
    odd = [(20, None), (40, []), (60, [None] + [1.0] * 11), (80, [float("nan")] * 12), (100, [float("inf")] * 12), (120, [0.0] * 12), (140, [1.0] * 11), (None, near[1].tolist()), (4000, near[2].tolist()), (0, noise[0][1])]
    return {"noise": noise, "grouped": grouped, "lengths": lengths, "lattice": lattice, "hot": hot[:400] + grouped, "all": noise + grouped + lengths + lattice + hot + odd}


@pytest.mark.parametrize("size", [256, 1 << 14])
@pytest.mark.parametrize("case", ["noise", "grouped", "lengths", "lattice", "hot", "all"])
def test_exactly_the_nearest(spark, monkeypatch, case, size):
    monkeypatch.setattr(collisions, "BLOCK_VECTORS", size)
    monkeypatch.setattr(collisions, "CHUNK", 7 if size == 256 else 1024)
    rows = cases(1)[case]
    got, want = in_order(found(spark, rows, 5)), in_order(plain(rows, 5))
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("n,k", [(3, 20), (1, 5), (170, 20)])
def test_few_vectors(spark, n, k):
    rows = [(20 * i, v.tolist()) for i, v in enumerate(np.random.default_rng(n).normal(size=(n, 3)))]
    assert in_order(found(spark, rows, k)) == in_order(plain(rows, k))


def test_empty_tables(spark):
    assert found(spark, [], 5) == [] and found(spark, [(20, None)], 5) == [] and found(spark, [(1, [1.0]), (2, [2.0])], 5) == []


def test_classic_stop_and_work_done():
    """On grouped vectors the counts single out few vectors, and the classic stop misses next to none."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=(300, 32))
    x = (near[np.arange(6000) % 300] + 0.15 * rng.normal(size=(6000, 32)))
    import pyarrow as pa

    group = pa.table({"block": pa.array([0] * len(x), pa.int32()), "row": np.arange(len(x)), "id": np.arange(len(x)), "e": pa.array(list(x), pa.list_(pa.float64()))})
    packed = collisions._pack(32)(group)
    block = collisions.Block(32, packed["top"][0].as_py(), np.arange(len(x)), *(packed[c][0].as_buffer() for c in ("vectors", "sorted", "places")))
    verified = {True: 0, False: 0}
    hit = 0
    for q in range(0, 600, 20):
        want = x @ x[q]
        want[q] = -np.inf
        want = set(np.argsort(-want)[:10].tolist())
        for exact in (True, False):
            at, scores, n = block.near(x[q], q, 10, exact)
            verified[exact] += n
            best = set(at[np.argsort(-scores)[:10]].tolist())
            assert not exact or best == want
            hit += 0 if exact else len(best & want)
    assert hit >= 0.9 * 300 and verified[True] < 0.15 * 30 * len(x) and verified[False] < 0.1 * 30 * len(x)


def test_windows_are_looked_up_and_hold_all_within_them(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    norms = np.sqrt((x * x).sum(1))
    p = collisions._lifted(x, norms, norms.max()).T.astype(np.float32)
    order = np.argsort(p, axis=1, kind="stable")
    places = np.empty(p.shape, np.uint16)
    np.put_along_axis(places, order, np.arange(3000, dtype=np.uint16)[None, :], 1)
    block = collisions.Block(16, float(norms.max()), np.arange(3000), x.tobytes(), np.take_along_axis(p, order, 1).tobytes(), places.tobytes())

    def searched(*_):
        raise AssertionError("an array is searched")

    monkeypatch.setattr(collisions.np, "searchsorted", searched)
    for q in x[:5]:
        at = np.append(q / np.sqrt(q @ q), 0.0) @ collisions._basis(17)
        for w in (1e-4, 0.05, 0.3, 1.9):
            lo, hi = block.window(at, w)
            inside = np.abs(p - at[:, None]) <= w
            held = (places >= (lo - block.base)[:, None]) & (places < (hi - block.base)[:, None])
            assert not (inside & ~held).any() and not (held & (np.abs(p - at[:, None]) > w + 2.01 / collisions.CELLS)).any()
        found, _, _ = block.near(q, -1, 10, True)
        assert set(np.argsort(-(x @ q))[:10]) <= set(found.tolist())
