"""Token alignment against a plain reading by byte offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """All offsets, all links and all counts, in lists."""
    left = Tokenizer.from_file(alignment.BYTE_BPE)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in codes} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in codes)}

    def ends(tokens):
        out, at = {}, 0
        for k, t in enumerate(tokens):
            at += len(t)
            out[at] = k + 1
        return out

    docs = []
    for i, text in rows:
        a, b, groups = [], [], []
        if text:
            a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
            spelt = [bytes(letters[c] for c in left.id_to_token(k)) for k in a]
            pieces = [bytes([int(right.id_to_piece(k)[3:5], 16)]) if right.is_byte(k) else right.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if b"".join(spelt) == b"".join(pieces) == (" " + text).encode():
                x, y, at = ends(spelt), ends(pieces), (0, 0)
                for e in sorted(set(x) & set(y)):
                    groups.append((a[at[0] : x[e]], b[at[1] : y[e]]))
                    at = x[e], y[e]
            else:
                a, b = [], []
        docs.append((i, len(a), len(b), groups))
    held, most = Counter(), defaultdict(int)
    for *_, groups in docs:
        held.update({(p, q) for x, y in groups for p in x for q in y})
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    out = []
    for i, n_a, n_b, groups in docs:
        pairs = [(p, q) for x, y in groups for p in x for q in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(pairs), sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs), digest))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def taken(frame):
    return in_order(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_op12_against_offsets(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert taken(QUERIES["op12_align_tokens"](spark, SF)) == in_order(plain(rows))


@pytest.fixture(scope="module")
def hard():
    texts = [
        "", None, " ", "   ", "a  b ", "\na", "a \n b", " a\t b  c", "<|endoftext|> x", "<s> </s><unk> <0x0A>", "▁a b", "ﬁ① x", "a\0b \0", "é é x", "  a 　b", "x" * 5000, "= " * 300 + "=" * 777,
        "日本語 テキスト", "नमस्ते दुनिया", "🙂🙃 👩‍👩‍👧 a", "it's don't  I'LL", "a\x1c b \x85 c", "​ ᠎ x", " trailing   ", "tab\tsep\r\nnext", "aaaaaaa" * 999, "a b", "xxx" + " " * 40 + "y", "﻿bom x", "１２３ ４５", "the same", "the same",
    ]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab  \n\t.'1é日🙂  \x1c\u0107S") for _ in range(rng.randrange(60))) for _ in range(500)]
    # Rows without an id, rows of one id.
    return [(k // 2 if k % 9 else None, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 5, 0])
def test_odd_texts_and_any_share_of_broadcast_pairs(spark, hard, heavy):
    df = spark.createDataFrame(hard, "doc_id long, text string").selectExpr("*", "1 as row", "2 as pairs", "3 as n_a", "'x' as id")
    aligned, counts = alignment.align(df)
    got = alignment.score(aligned, counts, heavy=heavy).withColumnRenamed("id", "doc_id")
    assert taken(got) == in_order(plain(hard))


def test_small_batches_and_memories_change_nothing(spark, hard, monkeypatch):
    known = alignment.Stretches(alignment.Tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE))
    texts = [t for _, t in hard]
    whole = alignment._align(known, texts)
    monkeypatch.setattr(alignment, "KEPT", 3)
    for k, t in enumerate(texts):
        numbers, digests, *_ = alignment._align(known, [t])
        assert numbers[0].tolist() == whole[0][k].tolist() and digests == [whole[1][k]]


def test_links_and_empty_table(spark):
    df = spark.createDataFrame([(1, "unbelievable words"), (2, "words")], "doc_id long, text string")
    aligned, counts = alignment.align(df)
    rows = alignment.links(aligned, counts).collect()
    by_doc = {i: sum(r.links for r in rows if r.id == i) for i in (1, 2)}
    assert by_doc == {r.id: r.n_links for r in aligned.collect()} and max(r.documents for r in rows) == 2
    assert alignment.aligned_documents(df.limit(0)).count() == 0


def test_transducer_refuses_other_bytes():
    t = alignment.Transducer([b"ab", b"c"], [b"a", b"bc", b"d"])
    assert [e.tolist() for e in t.groups([0, 1], [0, 1])] == [[2], [2]]
    assert t.groups([], [])[0].tolist() == []
    with pytest.raises(ValueError):
        t.groups([0, 1], [0, 2])
