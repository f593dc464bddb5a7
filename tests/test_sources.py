import gzip
import shutil

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.sources import formats, genomes


def test_text_fragments_drop_bad_rows_and_take_prefixes(spark, tmp_path):
    for n in ("s1", "s2"):
        with gzip.open(tmp_path / f"{n}.tsv.gz", "wt") as f:
            f.write("# comment\nchr1\t1\t5\tAC\t2\nchr1\tx\t5\tAC\t2\nchr1\t3\t9\n")
    df = formats.read_fragments_tsv(spark, str(tmp_path), prefixes={"s1.tsv.gz": "one_"})
    assert sorted(tuple(r) for r in df.collect()) == [("chr1", 1, 5, "AC", 2), ("chr1", 1, 5, "one_AC", 2)]
    out = formats.make_parquet_batch(spark, [str(tmp_path / "s1.tsv.gz")], str(tmp_path), prefixes=["p_"])
    assert [tuple(r) for r in formats.read_fragments(spark, out[0], ["barcode", "start"]).collect()] == [("p_AC", 1)]
    with pytest.raises(ValueError):
        formats.make_parquet_batch(spark, ["a"], str(tmp_path), prefixes=["p", "q"])


def test_annotations_in_both_writings(spark, tmp_path):
    p = tmp_path / "a.gtf"
    p.write_text('#x\nchr1\ts\ttranscript\t11\t20\t.\t-\t.\tgene_id "E1"; gene_name "G1"; transcript_id "T1";\nchr1\ts\tgene\t11\t20\t.\t-\t.\tgene_name=G2;ID=q\n')
    assert [tuple(r) for r in formats.read_transcripts(spark, str(p)).collect()] == [("chr1", 11, 20, "-", "T1", "G1")]
    assert [tuple(r) for r in formats.read_genes(spark, str(p)).collect()] == [("G2", "chr1", 11, 20, "-")]


def test_sequences_across_lines(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">c1 text\nACGT\nTTGG\n>c2\nCCCC\n")
    chunks = formats.fasta_chunks(spark, str(p))
    regions = spark.createDataFrame([("c1", 2, 7), ("c2", 0, 9), ("c3", 0, 3)], "chrom string, start long, end long")
    assert {r.chrom: r.seq for r in formats.fetch_sequences(regions, chunks).collect()} == {"c1": "GTTTG", "c2": "CCCC", "c3": ""}


def test_genomes(spark, tmp_path):
    assert genomes.chrom_sizes("GRCh38")["chr1"] == 248956422
    with pytest.raises(ValueError):
        genomes.chrom_sizes("none")
    (tmp_path / "s.txt").write_text("chr1 10\nchr2\t20\n")
    assert [tuple(r) for r in genomes.sizes_frame(spark, str(tmp_path / "s.txt")).collect()] == [("chr1", 10), ("chr2", 20)]


def test_command_line(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("".join(f"chr1\t{i * 10}\t{i * 10 + 30}\t{c}\t1\n" for i in range(20) for c in "AB"))
    (tmp_path / "s.txt").write_text("chr1 1000\n")
    d = str(tmp_path)
    assert cli.main(["convert", f"{d}/f.tsv", "-o", f"{d}/f.parquet", "--partitions", "2"], spark) == 0
    assert cli.main(["tile", f"{d}/f.parquet", "-o", f"{d}/t", "-g", f"{d}/s.txt", "--min-fragments", "5", "--tile-size", "100"], spark) == 0
    assert cli.main(["features", f"{d}/t", "-o", f"{d}/sel", "-n", "2", "--filter-lower", "0", "--filter-upper", "0"], spark) == 0
    assert spark.read.parquet(f"{d}/sel/var").filter("selected").count() == 2
    # All tiles and passing cells are written, also those without counts.
    assert spark.read.parquet(f"{d}/t/var").count() == 10 and spark.read.parquet(f"{d}/t/obs").count() == 2
    assert cli.main(["combine", f"{d}/t", f"{d}/t", "-o", f"{d}/c"], spark) == 0  # one input named twice
    assert cli.main(["tile", f"{d}/f.parquet", "-o", f"{d}/t2", "-g", f"{d}/s.txt", "--min-fragments", "5", "--tile-size", "100", "--prefix", "p_"], spark) == 0
    assert cli.main(["combine", f"{d}/t", f"{d}/t2", "-o", f"{d}/c"], spark) == 0
    assert {r.cell for r in spark.read.parquet(f"{d}/c/obs").collect()} == {"A", "B", "p_A", "p_B"}
    shutil.copytree(f"{d}/t", f"{d}/t3")
    assert cli.main(["combine", f"{d}/t", f"{d}/t3", "-o", f"{d}/c2"], spark) == 1  # equal barcodes
    assert cli.main(["filter", f"{d}/f.parquet", "-o", f"{d}/none", "--min-fragments", "99"], spark) == 1
    assert cli.main(["doublets", f"{d}/f.parquet", "--min-fragments", "5"], spark) == 0
    (tmp_path / "a.gtf").write_text("".join(f'chr1\ts\t{kind}\t{a}\t{a + 50}\t.\t+\t.\tgene_id "E{a}"; gene_name "{n}"; transcript_id "T{a}";\n' for kind in ("gene", "transcript") for a, n in ((11, "G1"), (101, "G2"), (900, "far"))))
    assert cli.main(["metrics", f"{d}/f.parquet", "-o", f"{d}/m.csv", "-a", f"{d}/a.gtf", "--min-fragments", "5"], spark) == 0
    m = {r.barcode: r for r in formats.read_metrics(spark, f"{d}/m.csv").collect()}
    assert set(m) == {"A", "B"} and m["A"].n_unique == 20 and m["A"].tsse_score > 0
    assert cli.main(["gene", f"{d}/f.parquet", "-o", f"{d}/g", "-a", f"{d}/a.gtf", "--min-fragments", "5", "--metrics", f"{d}/m.csv", "--upstream", "0"], spark) == 0
    assert {(r.cell, r.feature) for r in spark.read.parquet(f"{d}/g/x").collect()} == {(c, g) for c in "AB" for g in ("G1", "G2")}
    assert {r.feature for r in spark.read.parquet(f"{d}/g/var").collect()} == {"G1", "G2", "far"} and "n_unique" in spark.read.parquet(f"{d}/g/obs").columns
    assert cli.main(["genescore", f"{d}/f.parquet", "-o", f"{d}/gs", "-a", f"{d}/a.gtf", "--min-fragments", "5"], spark) == 0
    assert spark.read.parquet(f"{d}/gs/x").count() >= 4 and spark.read.parquet(f"{d}/gs/var").count() == 3
    assert cli.main(["filter", f"{d}/f.parquet", "-o", f"{d}/q", "--min-fragments", "5", "--metrics", f"{d}/m.csv", "--query", "reflect('a') > 1"], spark) == 1
    assert cli.main(["tile", f"{d}/missing", "-o", f"{d}/t2", "-g", "none"], spark) == 1


def test_other_annotations_and_batches(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Symbol,SeqNames,Start,End,Strand\nA,chr1,90,10,-1\nB,chr2,5,9,1\n")
    assert sorted(map(tuple, formats.read_gene_csv(spark, str(tmp_path / "g.csv")).collect())) == [("A", "chr1", 10, 90, "-"), ("B", "chr2", 5, 9, "+")]
    (tmp_path / "b.bed").write_text("# c\nchr1\t5\t9\tname\nchr1\tx\t9\n")
    assert [tuple(r) for r in formats.read_bed(spark, str(tmp_path / "b.bed")).collect()] == [("chr1", 5, 9)]
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.tsv").write_text(f"chr1\t1\t5\t{folder}\t1\n")
    with pytest.raises(ValueError, match="same name"):
        formats.make_parquet_batch(spark, [str(tmp_path / f / "s.tsv") for f in ("one", "two")], str(tmp_path))
    assert formats.partitions_of(spark, spark.read.text(str(tmp_path / "g.csv"))) == 1


def test_long_sequences_over_several_scans(spark, tmp_path, monkeypatch):
    import random

    from tessera.functions import ranks

    rng = random.Random(1)
    texts = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 900))) for i in range(12)}
    for k, names in enumerate((list(texts)[:7], list(texts)[7:])):
        (tmp_path / f"{k}.fa").write_text("".join(f">{n} about\n" + "".join(texts[n][j : j + 60] + "\n" for j in range(0, len(texts[n]), 60)) + "\n" for n in names))
    regions = [(n, a, a + rng.randint(1, 200)) for n in texts for a in [rng.randint(0, 300)] for _ in range(3)] + [("c1", 5, 60)] * 2
    df = spark.createDataFrame(regions, "chrom string, start long, end long")
    monkeypatch.setattr(ranks.along, "__kwdefaults__", {**ranks.along.__kwdefaults__, "small": 0})
    got = sorted(map(tuple, formats.fetch_sequences(df, formats.fasta_chunks(spark, str(tmp_path))).collect()))
    assert got == sorted((n, a, b, texts[n][a:b]) for n, a, b in regions)


def test_stream_state_is_compacted(spark, tmp_path):
    from tessera.streaming import counts

    rows = [("chr1", i * 10, i * 10 + 30, "A", 1) for i in range(40)]
    spark.createDataFrame(rows, formats.FRAGMENT).repartition(8).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        counts.count_stream(counts.stream_fragments(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "check"), 100, compact_every=3).awaitTermination()
    got = sorted(map(tuple, counts.read_counts(spark, str(tmp_path / "state")).collect()))
    assert got == sorted(map(tuple, counts.tile_counts(spark.createDataFrame(rows, formats.FRAGMENT), 100).collect()))
    left = [p.name for p in (tmp_path / "state" / "batch").iterdir()]
    assert len(left) < 8 and len(list((tmp_path / "state" / "version").iterdir())) <= 2


def test_verbosity():
    import logging

    from tessera.session import set_verbosity

    set_verbosity("error")
    assert logging.getLogger("tessera").level == logging.ERROR
    set_verbosity(3)
    assert logging.getLogger("tessera").level == logging.DEBUG
    with pytest.raises(ValueError):
        set_verbosity("loud")


def test_stream_of_totals_drops_repeats_and_late_rows(spark, tmp_path):
    """Repeats count once, across batches and a restart; rows far behind the watermark are dropped."""
    from tessera.streaming import counts

    kind = "chrom string, start long, `end` long, barcode string, count int, seen long"

    def send(*rows):
        df = spark.createDataFrame([("chrM" if s % 2 else "chr1", s, s + 10, b, n, t) for s, b, n, t in rows], kind)
        df.withColumn("seen", F.timestamp_seconds("seen")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        counts.qc_stream(stream, str(tmp_path / "state"), str(tmp_path / "check"), delay="1 hour").awaitTermination()
        return {r.barcode: (r.n_unique, round(r.duplicate_fraction, 6), round(r.mito_fraction, 6)) for r in counts.read_qc(spark, str(tmp_path / "state"), 1).collect()}

    day = 10**9
    send((0, "A", 2, day), (1, "A", 4, day), (0, "A", 2, day + 5), (0, "B", 1, day))
    assert run() == {"A": (2, 0.666667, 0.666667), "B": (1, 0.0, 0.0)}
    send((1, "A", 4, day + 60), (2, "A", 2, day + 60))  # a repeat and a new one, after a restart
    assert run() == {"A": (3, 0.625, 0.5), "B": (1, 0.0, 0.0)}
    send((4, "B", 1, day + 86400))
    run()
    send((6, "B", 1, day), (8, "B", 1, day + 86400))  # the first is a day late
    assert run() == {"A": (3, 0.625, 0.5), "B": (3, 0.0, 0.0)}


def test_files_of_a_short_axis_are_of_equal_size(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("concat('chr', id % 2) as chrom", "id % 500 as start", "id % 500 + 50 as `end`", "concat('b', id % 90) as barcode", "1 as count")
    formats.write_fragments(rows, str(tmp_path / "out"), 8)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 40_000 and max(sizes) < 10_000
