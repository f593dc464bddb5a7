"""Block-gzip files in ranges: each line once, wherever ranges, members and lines are cut."""

import gzip
import random

import pytest
from pyspark.errors import PySparkException

from tessera.sources import blockgzip, formats


def ranges(path, split):
    reader = blockgzip.LineReader({"path": str(path), "splitbytes": str(split)})
    out = []
    for part in reader.partitions():
        out.append([x.as_py() for batch in reader.read(part) for x in batch.column(0)])
    return out


def texts():
    rng = random.Random(2)
    yield b"", b"one", b"one\n", b"\n", b"\n\n\n", b"a\r\nb\r\n", "é\nü".encode(), b"\xff\xfe\nok\n"
    yield (b"x" * 200_000 + b"\n",) * 2, (b"y" * 100 + b"\n") * 3000
    for _ in range(4):
        yield (b"".join(bytes(rng.choice(b"abc\n") for _ in range(rng.choice([0, 1, 10, 300]))) + b"\n" * rng.randrange(3) for _ in range(200)),)


@pytest.mark.parametrize("member_text", [1, 7, 1000, 65280])
def test_every_line_once_for_any_cut(tmp_path, member_text):
    flat = [x for group in texts() for t in group for x in (t if isinstance(t, tuple) else (t,))]
    for n, text in enumerate(flat):
        if member_text < 1000:
            text = text[:600]
        want = [x.decode("utf-8", "replace").removesuffix("\r") for x in text.removesuffix(b"\n").split(b"\n")] if text else []
        path = tmp_path / f"{n}.gz"
        path.write_bytes(b"".join(blockgzip.member(text[k : k + member_text]) for k in range(0, len(text), member_text)) + blockgzip.member(b""))
        size = path.stat().st_size
        for split in {1, 13, 100, 5000, size - 1, size, 10**9} - {0}:
            if size // split < 20_000:
                assert [x for part in ranges(path, split) for x in part] == want, (n, split)
        if text:
            assert gzip.decompress(path.read_bytes()) == text
            (tmp_path / "plain.txt").write_bytes(text)
            (tmp_path / "other.gz").write_bytes(gzip.compress(text[: len(text) // 2]) + gzip.compress(text[len(text) // 2 :]))
            for split in (50, 5000):
                assert [x for part in ranges(tmp_path / "plain.txt", split) for x in part] == want
                assert [x for part in ranges(tmp_path / "other.gz", split) for x in part] == want


def test_headers_within_text_are_no_members(tmp_path):
    """Stored text full of what looks like members doesn't mislead a range that begins there."""
    fake = blockgzip.member(b"fake\n")
    text = (fake.replace(b"\n", b"?") + b"\n") * 500 + random.Random(1).randbytes(70_000).replace(b"\n", b" ") + b"\n"
    body = [text[k : k + 30_000] for k in range(0, len(text), 30_000)]
    import struct
    import zlib

    def stored(t):
        squeezed = zlib.compressobj(0, zlib.DEFLATED, -15)
        data = squeezed.compress(t) + squeezed.flush()
        return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(t), len(t))

    path = tmp_path / "f.gz"
    path.write_bytes(b"".join(map(stored, body)))
    want = [x.decode("utf-8", "replace") for x in text[:-1].split(b"\n")]
    for split in (4000, 20_000, 10**9):
        got = [x for part in ranges(path, split) for x in part]
        assert len(got) == len(want) and got == want


def test_fragments_by_range_equal_plain_gzip(spark, tmp_path):
    rows = [f"chr{i % 3}\t{i}\t{i + 50}\tBC{i % 7}\t{i % 4 + 1}" for i in range(50_000)]
    rows[10], rows[20], rows[30] = "# note", "chr1\tx\t5\tBC1\t1", "chr1\t5"
    (tmp_path / "both").mkdir()
    with gzip.open(tmp_path / "both" / "a.tsv.gz", "wt") as f:
        f.write("\n".join(rows) + "\n")
    frame = spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1)
    blockgzip.write_lines(frame, str(tmp_path / "blocks"), suffix=".tsv.gz")
    file = next((tmp_path / "blocks").iterdir())
    plain = sorted(map(tuple, formats.read_fragments_tsv(spark, str(tmp_path / "both")).collect()))
    assert len(plain) == len(rows) - 3
    for split in (3000, 1 << 30):
        got = formats.read_fragments_tsv(spark, str(tmp_path / "blocks"), split_bytes=split)
        assert sorted(map(tuple, got.collect())) == plain
    assert formats.read_fragments_tsv(spark, str(file), split_bytes=20_000).rdd.getNumPartitions() > 4
    # A folder with both kinds, and prefixes by file name.
    file.rename(tmp_path / "both" / "b.tsv.gz")
    both = formats.read_fragments_tsv(spark, str(tmp_path / "both"), prefixes={"b.tsv.gz": "b_"})
    assert both.count() == 2 * len(plain) and both.filter("barcode like 'b_%'").count() == len(plain)


@pytest.mark.parametrize("split", [40, 1000, 1 << 25])
def test_places_grow_along_the_file(tmp_path, split):
    text = b"".join(b"%d" % i * (i % 7) + b"\n" for i in range(400))
    (tmp_path / "p.txt").write_bytes(text)
    (tmp_path / "b.gz").write_bytes(b"".join(blockgzip.member(text[k : k + 300]) for k in range(0, len(text), 300)) + blockgzip.member(b""))
    (tmp_path / "g.gz").write_bytes(gzip.compress(text))
    want = [sum(len(x) + 1 for x in text.split(b"\n")[:k]) for k in range(400)]
    for name in ("p.txt", "b.gz", "g.gz"):
        reader = blockgzip.LineReader({"path": str(tmp_path / name), "splitbytes": str(split)})
        got = [x.as_py() for part in reader.partitions() for batch in reader.read(part) for x in batch.column(2)]
        assert len(got) == 400 and all(a < b for a, b in zip(got, got[1:], strict=False))
        assert name == "b.gz" or got == want


def test_batches_keep_places(tmp_path, monkeypatch):
    monkeypatch.setattr(blockgzip, "BATCH_BYTES", 50)
    test_places_grow_along_the_file(tmp_path, 1000)


@pytest.mark.parametrize("name", ["a.fa", "b.fa.gz", "c.fa.gz"])
def test_sequences_in_any_lines(spark, tmp_path, name):
    rng = random.Random(3)
    seqs = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate([500, 0, 61, 1200, 3])}
    out = []
    for chrom, seq in seqs.items():
        out.append(f">{chrom} words")
        while seq:
            n = rng.randint(1, 40)
            out.append(seq[:n])
            seq = seq[n:]
        out.append("")
    text = "\n".join(out).encode()
    squeezed = {"a.fa": text, "b.fa.gz": b"".join(blockgzip.member(text[k : k + 97]) for k in range(0, len(text), 97)) + blockgzip.member(b""), "c.fa.gz": gzip.compress(text)}[name]
    (tmp_path / name).write_bytes(squeezed)
    for chroms in (None, ["c3", "c2"]):
        chunks = formats.fasta_chunks(spark, str(tmp_path / name), chroms, split_bytes=150)
        got = {}
        for r in chunks.orderBy("chrom", "offset").collect():
            assert len(got.setdefault(r.chrom, "")) == r.offset
            got[r.chrom] += r.seq
        assert got == {c: s for c, s in seqs.items() if s and (chroms is None or c in chroms)}


def test_damaged_members_and_empty_tables(spark, tmp_path):
    data = bytearray(blockgzip.member(b"some lines\n" * 900) + blockgzip.member(b""))
    data[60] ^= 255
    (tmp_path / "bad.gz").write_bytes(bytes(data))
    with pytest.raises(PySparkException):
        blockgzip.read_lines(spark, str(tmp_path / "bad.gz")).count()
    frame = spark.createDataFrame([(None,)], "value string")
    blockgzip.write_lines(frame.limit(0), str(tmp_path / "none"))
    assert blockgzip.read_lines(spark, str(tmp_path / "none")).count() == 0
    blockgzip.write_lines(frame, str(tmp_path / "none"))
    assert blockgzip.read_lines(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        blockgzip.listed(str(tmp_path / "nowhere"))


def test_many_sequences_meet_their_lines_by_number(spark, tmp_path):
    """Lines of a range meet their own header only, not all headers of the range."""
    rows = [x for i in range(20_000) for x in (f">s{i} note", "ACGT"[: i % 5], "AC")]
    frame = spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1)
    blockgzip.write_lines(frame, str(tmp_path / "fa"), suffix=".fa.gz")
    (tmp_path / "plain.fa").write_text("\n".join(rows) + "\n")
    want = sorted((f"s{i}", o, x) for i in range(20_000) for o, x in ((0, "ACGT"[: i % 5]), (i % 5 if i % 5 < 4 else 4, "AC")) if x)
    for path in ("fa", "plain.fa"):
        chunks = formats.fasta_chunks(spark, str(tmp_path / path), split_bytes=5000)
        assert sorted(map(tuple, chunks.collect())) == want
        plan = chunks._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Join" in x and (" < " in x or " > " in x)]
    some = formats.fasta_chunks(spark, str(tmp_path / "fa"), ["s7", "s12"])
    assert sorted(map(tuple, some.collect())) == [x for x in want if x[0] in ("s12", "s7")]
