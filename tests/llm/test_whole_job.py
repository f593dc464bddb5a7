"""Cases in which an operator once did less than the whole job."""

import random
import re

from tessera.llm import decontam, superminhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], DOC)


def linked_by_brute_force(rows, k=2):
    """Smallest id reachable, by all pairs that share a shingle; texts of one id are one document."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(n)
    for a, (i, s) in enumerate(sets):
        for b in {b for x in s for b in at[x] if b > a}:
            j, t = sets[b]
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_chains_through_one_text_at_any_place_of_the_order(spark):
    """2,000 triads A-C and B-C linked at 0.80 to 0.85, A-B not, with ids in random order."""
    rng, rows = random.Random(3), []
    ids = rng.sample(range(1_000_000), 6000)
    for t in range(2000):
        size = rng.randint(60, 200)
        base = [f"w{t}x{i}" for i in range(size)]
        cut = lambda: rng.randint(size * 15 // 185, size * 18 // 182)  # noqa: B023, E731
        edit = lambda at, n, mark: " ".join(base[:at] + [f"{mark}{t}x{i}" for i in range(n)] + base[at + n :])  # noqa: B023, E731
        m, n = cut(), cut()
        rows += zip(ids[3 * t : 3 * t + 3], (edit(2, m, "a"), edit(size // 2 + 2, n, "b"), " ".join(base)), strict=True)
    out = {r.doc_id: r.component_id for r in superminhash.near_duplicates(docs(spark, rows), k=2).collect()}
    want = linked_by_brute_force(rows)
    assert out == want and sum(want[i] != i for i in want) > 3500


def test_hot_hubs_and_unlike_texts_of_one_id(spark, monkeypatch):
    """A crowd near one text, dealt over several tasks, and ids with several texts that link groups."""
    monkeypatch.setattr(superminhash, "HUB_MEMBERS", 8)
    rng, base = random.Random(4), [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    other = [[f"o{t}w{i}" for i in range(40)] for t in range(4)]
    rows += [(200, " ".join(other[0])), (201, " ".join(other[0])), (201, " ".join(other[1])), (202, " ".join(other[1][:39])), (203, " ".join(other[2])), (203, " ".join(other[3])), (203, ""), (150, " ".join(other[3])), (7, " ".join(other[2][:38]))]
    got = {(r.doc_id, r.component_id) for r in superminhash.near_duplicates(docs(spark, rows), k=2).collect() if r.n_shingles}
    assert got == set(linked_by_brute_force([r for r in rows if r[1]]).items())


def test_copies_of_short_and_number_heavy_items(spark):
    numbers = "Sums: 3 4 5 6 7 8 9 10 11 12 13 14 15 16"
    late = "Please read the table below and add its rows in order until done now " + " ".join(str(7 * i) for i in range(12, 32))
    items = [(1, "What is the capital of France today?"), (2, "Compute 17 * 23 + 5"), (3, numbers), (4, "How many apples does the boy have left after lunch now?"), (5, late)]
    items = spark.createDataFrame(items, "item_id int, text string")
    rows = [
        (1, "he asked What is the capital of France today?"), (2, "please Compute 17 * 23 + 5 soon"), (3, f"and {numbers} end"),
        (4, "they say How many apples does the boy have left after lunch now? and go"), (5, "he asked What is the capital of Spain today?"),
        (6, "he asked Where is the capital of Spain today?"), (7, "please Compute 17 * 24 + 5 soon"), (8, "rows " + " ".join(str(7 * i) for i in range(14, 32))),
        (9, "What is the capital of France today?"),
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.leaks(docs(spark, rows), items).collect()}
    assert got == {(1, 1): "exact", (2, 2): "exact", (3, 3): "exact", (4, 4): "exact", (5, 1): "reparameterised", (8, 5): "exact", (9, 1): "exact"}


def test_leaks_in_other_case_and_with_names_of_several_words(spark):
    one = "A train leaves London at 9 am and reaches New York after 12 hours, while Mary Ann waits there with 3 friends."
    items = spark.createDataFrame([(1, one), (2, None), (3, "")], "item_id int, text string")
    other = one.replace("London", "Buenos Aires").replace("New York", "Rome").replace("Mary Ann", "Bob").replace("9 am", "8 am").replace("12", "1,200")
    clash = one.replace("London", "Paris").replace("New York", "Rome").replace("Mary Ann waits", "Mary Ann waits for Mary Ann")
    rows = [
        (1, one.lower()), (2, one.upper()), (3, f"So: {other}"), (4, None), (5, ""), (None, one), (None, "a clean text of which nothing is taken"), (7, one), (7, "clean"), (7, one),
        (8, "A train leaves London at 9 am and reaches New York"), (8, "12 hours, while Mary Ann waits there with 3 friends."),
    ]
    frame = docs(spark, rows).withColumn("h", __import__("pyspark").sql.functions.lit(1)).withColumnRenamed("lang", "tokens")
    got = sorted(((r.doc_id, r.kind, r.n_windows) for r in decontam.leaks(frame, items).collect()), key=str)
    n = len(re.findall(r"\w+", one)) - 7
    assert [g[:2] for g in got] == [(1, "exact"), (2, "exact"), (3, "reparameterised"), (7, "exact"), (8, "exact"), (None, "exact")] and got[0][2] == n
    left = sorted((r.doc_id or 0, r.text or "") for r in decontam.drop_leaks(frame, items).collect())
    assert left == [(0, rows[6][1]), (4, ""), (5, ""), (7, "clean"), (8, rows[11][1])]
    assert decontam.drop_leaks(frame, items).columns == frame.columns
    del clash


def templates_by_brute_force(rows, items):
    """(document, item): exact or reparameterised, by all windows of all alignments."""
    cap, end = "[A-Z][a-z]+", r"(?![A-Za-z0-9_])"

    def values(t):
        t = re.sub(r"(?<=[0-9])(?=[A-Za-z])", " ", re.sub(r"(?<=[0-9])[.,](?=[0-9])", "_", t))
        return re.sub(rf"(?<![A-Za-z0-9_])({cap}) (?={cap}{end})", r"\1_", t)

    def template(t):
        t = re.sub(rf"(?<=<num> )(?i:{decontam.UNITS}){end}", "<unit>", re.sub(r"(?<![A-Za-z_])[0-9][0-9_]*", "<num>", t))
        return re.sub(rf"(?<=[A-Za-z,;] ){cap}(?:_{cap})*{end}|(?<![A-Za-z0-9_]){cap}(?:_{cap})+{end}", "<name>", t).lower()

    split = lambda t: [x for x in re.split("[^A-Za-z0-9_<>]+", t) if x]
    own = lambda t: re.findall("[a-z0-9]+", t.lower())
    slot = {"<num>", "<unit>", "<name>"}
    out = {}

    def aligned(a, b, n, at_of, fit):
        found = {}
        for at in at_of:
            for p in range(len(b) - n + 1):
                if fit(at, p, b[p : p + n]):
                    found.setdefault(p - at, []).append((at, p))
        return found.values()

    for i, t in rows:
        for j, q in items:
            a, b = own(q), own(t)
            n = min(8, len(a))
            if n >= 4 and any(len(m) >= min(4, len(a) - n + 1) for m in aligned(a, b, n, range(len(a) - n + 1), lambda at, p, x: x == a[at : at + n])):  # noqa: B023
                out[i, j] = "exact"
            va, vb, ta, tb = split(values(q)), split(values(t)), split(template(values(q))), split(template(values(t)))
            n = min(8, len(ta))
            if n < 4:
                continue
            kept = [k for k in range(len(ta) - n + 1) if sum(x not in slot for x in ta[k : k + n]) >= n / 2]
            first = re.fullmatch(cap, va[0]) and ta[0] not in slot
            fit = lambda at, p, x: x == ta[at : at + n] or (first and at == 0 and x == ["<name>", *ta[1:n]] and va[0].lower() == vb[p].lower())  # noqa: B023, E731
            for m in aligned(ta, tb, n, kept, fit):
                pairs = {(ta[at + k], va[at + k].lower(), vb[p + k].lower()) for at, p in m for k in range(n) if tb[p + k] in slot and (ta[at + k] in slot)}
                if len(m) >= min(4, len(kept)) and len(pairs) == len({x[:2] for x in pairs}):
                    out.setdefault((i, j), "exact" if all(x[1] == x[2] for x in pairs) else "reparameterised")
                    if all(x[1] == x[2] for x in pairs):
                        out[i, j] = "exact"
    return out


def test_templates_and_slots_by_brute_force(spark):
    rng = random.Random(11)
    names, filler = ["Ann", "Bob", "New York", "Rome", "Mary Jane", "Lima"], "the a of walks with from near slowly , ; . to and buys sells".split()
    unit = lambda: rng.choice(["km", "hours", "apples", "dollars", "kg"])

    def sentence():
        return [rng.choice([lambda: rng.choice(filler), lambda: rng.choice(filler), lambda: "{n%d}" % rng.randint(0, 2), lambda: "{k%d}" % rng.randint(0, 2) + rng.choice([" ", ""]) + unit()])() for _ in range(rng.randint(5, 22))]

    def said(parts, whole):
        some = {f"n{i}": rng.choice(names) for i in range(3)} | {f"k{i}": rng.choice(["7", "1,200", "3.5", "42"]) for i in range(3)}
        text = " ".join(parts).format(**some)
        if not whole and rng.random() < 0.3:
            text = text.replace("7", "8", 1)
        return text[:1].upper() + text[1:]

    sentences = [sentence() for _ in range(14)]
    items = [(j, said(s, True)) for j, s in enumerate(sentences)]
    rows = []
    for i in range(160):
        s = rng.choice(sentences)
        text = rng.choice([said(s, False), rng.choice(items)[1], said(s, False).lower(), said(s[:-2], False)])
        rows.append((i, f"{said(sentence(), True)} {rng.choice(['', 'and '])}{text} {said(sentence(), True)}"))
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id int, text string")).collect()}
    want = templates_by_brute_force(rows, items)
    assert got == want and {"exact", "reparameterised"} <= set(want.values())


def test_strings_are_counted_in_little_memory():
    """Buckets take a byte each while a byte holds the limit, however many texts hold a string."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tessera.llm import repeats

    rng = np.random.default_rng(5)
    own = [rng.integers(97, 123, 400, dtype=np.uint8).tobytes() for _ in range(300)]
    common = rng.integers(97, 123, 100, dtype=np.uint8).tobytes()
    long = rng.integers(97, 123, 3 * repeats.COUNT_PIECE, dtype=np.uint8).tobytes()
    texts = [t + common + common for t in own] + [common + long + common, b"", b"short"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    tracemalloc.start()
    rows = [r for out in repeats._count(16)(iter([batch])) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    got = np.zeros(repeats.BUCKETS, np.int64)
    for r in rows:
        got[r["place"] * repeats.SLICE :][: repeats.SLICE] = np.frombuffer(pa.decompress(r["blob"], repeats.SLICE, "zstd"), np.uint8)
    want = np.zeros(repeats.BUCKETS, np.int64)
    with np.errstate(over="ignore"):
        for t in texts:
            if len(t) >= repeats.ANCHOR:
                want[np.unique((repeats._hashes(np.frombuffer(t, np.uint8)) & repeats._BUCKET).astype(np.int64))] += 1
    assert (got == np.minimum(want, 16)).all()


def test_copies_are_dropped_once(spark):
    """Later steps read what is left of the texts and don't join them with the copies anew."""
    from tessera.llm import repeats

    docs = spark.createDataFrame([(i, "same text of more than fifty bytes, the same in all of them" if i % 2 else f"text {i} " * 12) for i in range(20)], "doc_id long, text string")
    job = repeats._Job(docs, "doc_id", "text")
    assert "Join" not in job.units._jdf.queryExecution().optimizedPlan().toString()
    assert job.units.count() == 11
