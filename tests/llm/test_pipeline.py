"""The pipeline against a brute-force version of each stage on the small tables."""

import re

import corpus_pipeline
from tessera.session import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = ({r.doc_id: r for r in before.collect()}, docs.collect())

    before, after = seen["quality_rules"]
    kept = {r.doc_id: r for r in after}
    assert all(kept[i] == before[i] for i in kept)
    assert not [i for i in kept if len(WORD.findall(before[i].text)) < 50]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    clean = [i for i, q in labels.items() if q and len(WORD.findall(before[i].text)) >= 50]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)

    before, after = seen["line_dedup"]
    pages, lines = {}, {}
    for r in before.values():
        pages.setdefault(r.source, set()).add(r.text)
    for s, texts in pages.items():
        for t in texts:
            for x in {x for x in t.split("\n") if WORD.search(x)}:
                lines[s, x] = lines.get((s, x), 0) + 1
    gone = {k for k, n in lines.items() if n >= 4 and n > 0.08 * len(pages[k[0]])}
    assert {r.doc_id: r.text for r in after} == {i: "\n".join(x for x in r.text.split("\n") if (r.source, x) not in gone) for i, r in before.items()}

    before, after = seen["near_dedup"]
    sets = {}
    for i, r in before.items():
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(r.text)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in after} == {i for i in ids if find(i) == i}

    before, after = seen["decontaminate"]
    words = lambda t: re.findall(r"\w+", t.lower())
    grams = {}
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(r.item_id)

    def leaks(t):
        w, n = words(t), {}
        for k in range(len(w) - 7):
            for item in grams.get(tuple(w[k : k + 8]), ()):
                n[item] = n.get(item, 0) + 1
        return any(v >= 4 for v in n.values())

    assert {r.doc_id for r in after} == {i for i, r in before.items() if not leaks(r.text)}

    before, after = seen["mix_sources"]
    size, target, taken = {}, {}, {}
    for r in before.values():
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text))
    for r in after:
        words_here = WORD.findall(r.text)
        assert words_here == WORD.findall(before[r.doc_id].text)[: r.copy_words]
        taken[r.source] = taken.get(r.source, 0) + len(words_here)
        target[r.source] = r.target
    assert all(taken[s] == int(target[s]) <= 2 * size[s] for s in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size) + 1


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "text", "taken"} <= set(out.columns)


def test_odd_rows_through_all_stages(spark, tmp_path):
    own = lambda i, stem: stem + "".join(chr(97 + (i // 26**k) % 26) for k in range(3))
    said = lambda stem, small: " ".join(f"{small[i % 5]} {own(i, stem)}" for i in range(100))
    prose, other = said("river", "the of and in a".split()), said("hill", "to is with from by".split())
    leak = "How many stones are there in the river when the water has gone down and the birds have left for the winter?"
    rows = [
        (1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (2, prose + " end", "en", "s", 1), (None, prose, "en", None, 1), (None, f"{other} {leak}", "en", "s", 1),
        (3, None, None, None, None), (4, "", "en", "s", 0), (5, other, None, None, 1), (6, f"{other} {other[::-1]} {leak}", "en", "t", 1), (7, other * 400, "xx", "t", 1), (8, "# $ % " * 200, "en", "s", 1),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as size", "1 as taken", "'y' as bucket")
    frame.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    frame.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    for d in "ab":
        spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / d / "benchmark.parquet"))
    kept, docs = {}, frame
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path / "a"))
        kept[name] = sorted((r.doc_id or 0 for r in docs.collect()))
    assert kept["quality_rules"] == [0, 0, 1, 1, 2, 5, 6] + ([7] if 7 in kept["quality_rules"] else [])
    assert [i for i in kept["near_dedup"] if i != 7] == [0, 0, 1, 1, 5, 6] and [i for i in kept["decontaminate"] if i != 7] == [0, 1, 1, 5]
    assert set(kept["mix_sources"]) <= {0, 1, 5, 7} and corpus_pipeline.run(spark, str(tmp_path / "a")).count() == len(kept["mix_sources"])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
