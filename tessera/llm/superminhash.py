"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

1. Every document gets its shingle set, a SuperMinHash signature and the hashes of its bands.
2. Documents with equal sets form a class; one representative (smallest id) goes on.
3. The smallest representative of each bucket of equal band hashes is its hub. Each other one is
   compared on full sets with the hub that it shares most buckets with, so there is one pair for
   each at most; the members of a hub are dealt over several tasks, each with the hub's set. Links
   are grouped by union-find.
4. In buckets that still hold several groups all members of different groups are compared on full
   sets, in blocks; a bucket of two only if the pair was not compared in step 3. A block joins its
   groups as it goes and reports only the links that join any, so neither step writes all pairs of a
   bucket. Grouped again.

Every pair that shares a bucket is therefore linked, found to be in one group already, or refused.
With ``BANDS`` of ``ROWS`` a pair at similarity 0.8 shares no bucket with probability 3e-6.

Defined results: null or wordless text has an empty set and links with nothing; rows of one id are
one document, which is linked where any of its texts is, and its own texts are linked with each
other; texts of any length are read whole, in pieces; of equal sets the smallest id leads; rows
without an id are never linked and have a null component; an empty table gives no rows; only id and
text are read, so no other column clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, stored
from .bounded import small_side
from .shingles import mix, shingle_sets

BANDS, ROWS = 42, 6
SLOTS = BANDS * ROWS
#: Members of a bucket in one block of the last step.
BLOCK = 1024
#: Members of a hub that one task compares with it.
HUB_MEMBERS = 512
#: Ids are broadcast up to so many.
BROADCAST_IDS = 1_000_000
_GOLDEN = 0x9E3779B97F4A7C15


def _draw(e: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The element's fraction and its place among the slots not yet drawn, in step j."""
    r = mix(e + np.uint64((2 * j + 1) * _GOLDEN & (1 << 64) - 1))
    k = mix(e + np.uint64((2 * j + 2) * _GOLDEN & (1 << 64) - 1)) >> np.uint64(32)
    return (r >> np.uint64(11)).astype(np.float64) * 2.0**-53, j + (k * np.uint64(SLOTS - j) >> np.uint64(32)).astype(np.int64)


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set: slot s holds the least of (rank of s in an element's permutation, fraction).

    An element's permutation is drawn one slot a step; all elements of a set make step j before any
    makes step j + 1. Step j only gives values from j to j + 1, so a set stops once its slots are full.
    """
    n = len(at) - 1
    sizes = np.diff(at)
    table = np.full(n * SLOTS, np.inf)
    owner = np.repeat(np.arange(n), sizes)
    for a in range(0, len(hashes), 1 << 18):
        part = slice(a, a + (1 << 18))
        r, k = _draw(hashes[part], 0)
        np.minimum.at(table, owner[part] * SLOTS + k, r)
    open_sets = (sizes > 0) & np.isinf(table.reshape(n, SLOTS)).any(1)
    for group in np.array_split(np.flatnonzero(open_sets), max(1, int(sizes[open_sets].sum()) >> 17)):
        left = np.zeros(n, dtype=bool)
        left[group] = True
        rows = np.flatnonzero(left[owner])
        e, doc = hashes[rows], owner[rows]
        perm = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(e), 1))
        line = np.arange(len(e))
        for j in range(SLOTS):
            r, k = _draw(e, j)
            slot = perm[line, k]
            perm[line, k] = perm[line, j]
            perm[line, j] = slot
            if j:
                np.minimum.at(table, doc * SLOTS + slot, r + j)
                done = ~np.isinf(table.reshape(n, SLOTS)[group]).any(1)
                if done.all():
                    break
                if done.any():
                    left[group[done]] = False
                    stay = left[doc]
                    e, doc, perm, group = e[stay], doc[stay], perm[stay], group[~done]
                    line = np.arange(len(e))
    return table.reshape(n, SLOTS)


def _profile(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, hashes, at in shingle_sets(batch.column(1), k):
                n = len(at) - 1
                with np.errstate(over="ignore"):
                    sign = signatures(hashes, at).view(np.uint64)
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(c)), dtype=np.uint64)]) for c in (1, 2)]
                    keys = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                    band = np.zeros((n, BANDS), np.uint64)
                    parts = sign.reshape(n, BANDS, ROWS)
                    for i in range(ROWS):
                        band = mix(band * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, i])
                    band = mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(_GOLDEN))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(np.diff(at).astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), bands], schema=schema)

    return run


PROFILE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, at in shingle_sets(batch.column(1), k):
                n = len(at) - 1
                blobs = pa.array([hashes[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), blobs], ["id", "members"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                both = 0
                if 100 * len(small) >= percent * len(large):
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[place] == small).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(percent: int):
    """Links between different groups within each run of equal keys, on full sets.

    Rows are sorted by key; columns: bucket, lower, upper (blocks), block, rep, label, members. Each
    member's set is counted against those of all others that are not yet joined with it.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: list[tuple]) -> pa.RecordBatch:
        parent = {r[5]: r[5] for r in rows}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        sizes = np.array([len(x) for x in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        begins = np.append(0, np.cumsum(sizes))
        mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
        block = np.array([r[3] for r in rows])
        one = rows[0][1] == rows[0][2]
        root = np.array([r[5] for r in rows], np.int64)
        out: list[tuple[int, int]] = []
        for i in range(len(rows) - 1):
            others = np.arange(i + 1, len(rows))
            if not one:
                others = others[block[others] != block[i]]
            near = (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])) & (root[others] != root[i])
            others = others[near]
            for part in np.array_split(others, max(1, int(sizes[others].sum()) >> 20)) if len(others) else ():
                mark[flat[begins[i] : begins[i + 1]]] = 1
                ends = np.cumsum(sizes[part])
                at = np.arange(ends[-1]) + np.repeat(begins[part] - ends + sizes[part], sizes[part])
                both = np.add.reduceat(mark[flat[at]], ends - sizes[part])
                mark[flat[begins[i] : begins[i + 1]]] = 0
                for j in part[100 * both >= percent * (sizes[part] + sizes[i] - both)].tolist():
                    x, y = find(rows[i][5]), find(rows[j][5])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        root[root == max(x, y)] = min(x, y)
                        out.append((min(rows[i][4], rows[j][4]), max(rows[i][4], rows[j][4])))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    return run


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a partition by one from each node to the smallest it is joined with."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for the ends of ``links`` (columns a, b); label is the smallest node of the group.

    Union-find within partitions, then large-star and small-star steps across them: each node's
    larger neighbours, then its smaller ones, are hung on the smallest neighbour, until stable.
    """
    edges = materialize(links.select("a", "b").mapInArrow(_union_find, "a long, b long"))
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").filter("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
        seen = state


def _sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``id, members``: the shingle sets of some documents, several if texts of one id differ."""
    texts = docs.join(small_side(ids.toDF("wanted"), BROADCAST_IDS), docs["doc_id"] == F.col("wanted"), "left_semi")
    sets = texts.select("doc_id", "text").mapInArrow(_set_rows(k), "id long, members binary")
    return sets.groupBy("id").agg(F.collect_set("members").alias("m")).select("id", F.explode("m").alias("members"))


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; a may be in very many pairs."""
    sets = stored(_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, k))
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(small_side(parts, BROADCAST_IDS), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets.toDF("a", "x"), "a")
    full = dealt.join(sets.toDF("b", "y"), "b").join(hubs, ["a", "part"])
    return full.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``; groups are linked at ``percent`` Jaccard similarity."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = stored(docs.mapInArrow(_profile(k), PROFILE))
    classes = (
        profile.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    )
    classes = stored(classes)
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(banded.join(hubs, "bucket").select("bucket", "rep", "hub", "n"))
    met = shared.filter("rep <> hub").groupBy("hub", "rep").agg(F.count(F.lit(1)).alias("buckets"))
    best = F.max_by("hub", F.struct("buckets", -F.col("hub")))
    stars = stored(met.groupBy("rep").agg(best.alias("a")).select("a", F.col("rep").alias("b")))
    links = materialize(_confirmed(stars, docs, k, percent).unionByName(_same_document(profile, classes)))
    labels = materialize(components(links))

    named = shared.join(labels, shared["rep"] == labels["node"], "left").select("bucket", "rep", "hub", "n", F.coalesce("label", "rep").alias("label"))
    split = named.groupBy("bucket", "hub", "n").agg(F.max("rep").alias("last"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    split = materialize(split.select("bucket", "hub", "n", "last"))
    # Two members are one pair: compared once however many buckets they share, and not if they were above.
    twos = split.filter("n = 2").join(stars, (F.col("hub") == F.col("a")) & (F.col("last") == F.col("b")), "left_anti")
    twos = twos.groupBy("hub", "last").agg(F.min("bucket").alias("bucket"))
    rest = stored(named.drop("hub").join(split.filter("n > 2").select("bucket").union(twos.select("bucket")), "bucket"))
    rest = rest.join(_sets(rest.select("rep").distinct(), docs, k), F.col("rep") == F.col("id"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select("bucket", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "block", "rep", "label", "members")
    rest = rest.repartition("bucket", "lower", "upper").sortWithinPartitions("bucket", "lower", "upper")
    more = stored(rest.mapInArrow(_block_links(percent), "a long, b long").distinct())
    if not more.isEmpty():
        labels = materialize(components(links.union(more)))

    groups = classes.join(labels, classes["rep"] == labels["node"], "left").filter("copies > 1 or label is not null")
    groups = groups.select("set_a", "set_b", F.coalesce("label", "rep").alias("group"))
    out = profile.select("doc_id", "n_shingles", "set_a", "set_b").join(groups, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("group", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_document(profile: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of unlike texts of one id."""
    rows = profile.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "set_a", "set_b")
    several = rows.groupBy("doc_id").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi")).filter("lo <> hi").select("doc_id")
    rows = rows.join(small_side(several, BROADCAST_IDS), "doc_id", "left_semi")
    reps = rows.join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select("doc_id", "rep").distinct()
    ends = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return reps.join(ends, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are in a group with a document of smaller id."""
    gone = near_duplicates(docs, id_col, text_col, k, percent).filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(small_side(gone, BROADCAST_IDS), docs[id_col] == F.col("gone"), "left_anti")
