"""Readers and writers: fragments, annotations, regions, sequences and matrices."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import over_ranges
from ..session import stored, stored_bytes
from . import blockgzip

FRAGMENT = "chrom string, start long, `end` long, barcode string, count int"
COLUMNS = ["chrom", "start", "end", "barcode", "count"]


def _text_rows(spark: SparkSession, paths: str | list[str], separator: str, split_bytes: int) -> DataFrame:
    """Five columns of text, and the name of the file: block-gzip files in ranges, others by Spark's own reader."""
    given = [paths] if isinstance(paths, str) else list(paths)
    names = [f"_{i}" for i in range(1, 6)]
    schema, rules = ", ".join(f"{n} string" for n in names), {"sep": separator, "comment": "#"}
    blocks = {p: blockgzip.blocked(p) for p in given}
    parts = []
    if found := [f for files in blocks.values() for f in files]:
        lines = blockgzip.read_lines(spark, found, split_bytes)
        parts.append(lines.select(F.from_csv("value", schema, rules).alias("r"), F.col("file").alias("_file")).select("r.*", "_file"))
    # A folder may hold both kinds.
    rest = [f for p in given for f in ([x for x, _ in blockgzip.listed(p) if x not in blocks[p]] if blocks[p] else [p])]
    if rest:
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        parts.append(spark.read.csv(rest, schema=schema, **rules).select(*names, name.alias("_file")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_fragments_tsv(spark: SparkSession, paths: str | list[str], *, separator: str = "\t", prefix: str | None = None, prefixes: dict[str, str] | None = None, split_bytes: int = blockgzip.SPLIT_BYTES) -> DataFrame:
    """Fragments of headerless text files; rows that don't parse are dropped.

    All five columns are read and checked, so that pruning columns never changes which rows survive.
    ``prefixes`` gives barcodes a prefix by file name. Block-gzip files are read by ``split_bytes`` at a time.
    """
    raw = _text_rows(spark, paths, separator, split_bytes)
    rows = raw.select(
        F.col("_1").alias("chrom"), F.expr("try_cast(_2 as bigint)").alias("start"), F.expr("try_cast(_3 as bigint)").alias("end"),
        F.col("_4").alias("barcode"), F.expr("try_cast(_5 as int)").alias("count"), "_file",
    ).dropna(subset=COLUMNS)
    if prefixes:
        table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
        rows = rows.withColumn("barcode", F.concat(F.coalesce(F.element_at(table, F.col("_file")), F.lit("")), F.col("barcode")))
    elif prefix:
        rows = rows.withColumn("barcode", F.concat(F.lit(prefix), F.col("barcode")))
    return rows.select(COLUMNS)


def write_fragments_tsv(fragments: DataFrame, path: str) -> None:
    """Fragments as block-gzip text, sorted by place within files, one file for each task."""
    blockgzip.write_lines(fragments.sortWithinPartitions("chrom", "start").select(F.concat_ws("\t", *COLUMNS).alias("value")), path, suffix=".tsv.gz")


def write_fragments(fragments: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet sorted by place within files, which lets readers skip row groups; an empty table is written too.

    With ``partitions`` files hold ranges of places of about equal numbers of rows, however short the axis.
    """
    dealt = fragments.repartitionByRange(partitions, "chrom", "start", "end", "barcode") if partitions else fragments
    dealt.select(COLUMNS).sortWithinPartitions("chrom", "start").write.mode("overwrite").option("compression", "snappy").parquet(path)


#: Bytes of text for each Parquet file, and how much larger text is than its gzip.
FILE_BYTES, GZIP_RATIO = 512 << 20, 5


def partitions_of(spark: SparkSession, df: DataFrame) -> int:
    """As many files as the text that ``df`` reads fills."""
    files = df.inputFiles()
    return max(1, -(-sum(stored_bytes(spark, f) * (GZIP_RATIO if f.endswith(".gz") else 1) for f in files) // FILE_BYTES))


def make_parquet(spark: SparkSession, source: str, output: str, *, separator: str = "\t", prefix: str | None = None, partitions: int | None = None) -> str:
    """Text fragments to Parquet, in as many files as the text fills if no number is given.

    Block-gzip is read in ranges; other gzip cannot be split. Rows are dealt out after reading.
    """
    partitions = partitions or partitions_of(spark, spark.read.text(source))
    write_fragments(read_fragments_tsv(spark, source, separator=separator, prefix=prefix), output, partitions)
    return output


def make_parquet_batch(spark: SparkSession, inputs: list[str], output_dir: str, *, separator: str = "\t", prefixes: list[str] | str | None = None) -> list[str]:
    """One Parquet directory per input file."""
    each = prefixes if isinstance(prefixes, list) else [prefixes] * len(inputs)
    if len(each) != len(inputs):
        raise ValueError("as many prefixes as inputs are needed")
    stems = [source.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz").rsplit(".", 1)[0] for source in inputs]
    if len(set(stems)) < len(stems):
        raise ValueError("two inputs have the same name and would overwrite each other")
    outputs = [f"{output_dir}/{stem}.parquet" for stem in stems]
    # Jobs of several files run side by side; plain gzip is a single task each.
    with ThreadPoolExecutor(max_workers=8) as pool:
        return list(pool.map(lambda x: make_parquet(spark, x[0], x[1], separator=separator, prefix=x[2]), zip(inputs, outputs, each, strict=True)))


def read_fragments(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Fragments of Parquet files with the types of this library; unsigned columns are cast."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    kinds = {"chrom": "string", "start": "long", "end": "long", "barcode": "string", "count": "int"}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in (columns or COLUMNS)])


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns of GTF or GFF3, comments left out."""
    names = "chrom source feature start end score strand frame attributes".split()
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema=", ".join(f"`{n}` string" for n in names))
    return raw.withColumns({"start": F.expr("try_cast(start as bigint)"), "end": F.expr("try_cast(`end` as bigint)")}).dropna(subset=["start", "end"])


def attribute(key: str) -> Column:
    """An attribute in GTF (``key "value"``) or GFF3 (``key=value``) writing; null if absent."""
    gtf = F.regexp_extract("attributes", rf'(?:^|;\s*){key} "([^"]*)"', 1)
    gff = F.regexp_extract("attributes", rf"(?:^|;\s*){key}=([^;]*)", 1)
    return F.nullif(F.when(gtf != "", gtf).otherwise(gff), F.lit(""))


def read_transcripts(spark: SparkSession, path: str, *, id_key: str = "gene_name", transcript_key: str = "transcript_id") -> DataFrame:
    """``chrom, g_start, g_end, strand, transcript_id, gene_id`` of transcript rows that have an id."""
    rows = read_annotation(spark, path).filter(F.col("feature") == "transcript")
    return rows.select("chrom", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "strand", attribute(transcript_key).alias("transcript_id"), attribute(id_key).alias("gene_id")).filter("gene_id is not null")


def read_genes(spark: SparkSession, path: str, *, key: str = "gene_name") -> DataFrame:
    """``symbol, chrom, lo, hi, strand`` of gene rows, the first row of each symbol by place."""
    rows = read_annotation(spark, path).filter(F.col("feature") == "gene").select(attribute(key).alias("symbol"), "chrom", F.col("start").alias("lo"), F.col("end").alias("hi"), "strand").filter("symbol is not null")
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy("chrom", "lo", "hi"))).filter("_k = 1").drop("_k")


def read_gene_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same of a CSV with symbol, seqnames, start, end, strand, in any letter case."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    a, b = F.col("start").cast("double").cast("long"), F.col("end").cast("double").cast("long")
    return df.select("symbol", F.col("seqnames").alias("chrom"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(F.col("strand").isin("-", "2", "-1"), "-").otherwise("+").alias("strand"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start string, `end` string")
    return raw.select("chrom", F.expr("try_cast(start as bigint)").alias("start"), F.expr("try_cast(`end` as bigint)").alias("end")).dropna()


def fasta_chunks(spark: SparkSession, path: str, chroms: list[str] | None = None, split_bytes: int = blockgzip.SPLIT_BYTES) -> DataFrame:
    """``chrom, offset, seq``: a line of a FASTA file each, with its place in its sequence.

    Plain and block-gzip files are read in ranges. Headers and lengths are counted along a file, over
    ranges of places, so a line knows the number of its header and meets it by that; lines of any
    width do. ``chroms`` keeps some sequences. Write the result once and read it as Parquet afterwards.
    """
    lines = blockgzip.read_lines(spark, path, split_bytes).select("file", "at", F.rtrim("value").alias("line"))
    lines = lines.withColumn("_head", F.col("line").startswith(">")).withColumn("n", F.when(F.col("_head"), 0).otherwise(F.length("line")))
    size = 1 << 36 if blockgzip.blocked(path) else None
    placed = stored(over_ranges(lines, ("file",), "at", sums={"number": F.col("_head").cast("long"), "upto": "n"}, size=size))
    heads = placed.filter("_head").select("file", "number", "at", "upto", F.regexp_extract("line", r"^>(\S*)", 1).alias("chrom"))
    heads = over_ranges(heads, ("file",), "at", after={"until": "at"}, size=size)
    if chroms is not None:
        heads = heads.filter(F.col("chrom").isin(chroms))
    # A sequence is listed for each range of the file that it reaches into, so that a long one is not one key.
    reach = F.lit(1 << 40 if size else 1 << 24)
    last = placed.groupBy(F.col("file").alias("_file")).agg(F.max("at").alias("_last"))
    heads = heads.select(F.col("file").alias("_file"), F.col("number").alias("_number"), F.col("upto").alias("_upto"), "at", "until", "chrom").join(last, "_file")
    listed = heads.withColumn("_range", F.explode(F.sequence(F.floor(F.col("at") / reach), F.floor(F.coalesce("until", "_last") / reach)))).drop("at", "until", "_last")
    body = placed.filter("not _head and n > 0").withColumn("_at", F.floor(F.col("at") / reach)).drop("at")
    owned = body.join(listed, (F.col("file") == F.col("_file")) & (F.col("number") == F.col("_number")) & (F.col("_at") == F.col("_range")))
    return owned.select("chrom", (F.col("upto") - F.col("n") - F.col("_upto")).alias("offset"), F.col("line").alias("seq"))


def fetch_sequences(regions: DataFrame, chunks: DataFrame, width: int = 65536) -> DataFrame:
    """``regions`` (chrom, start, end) with ``seq``; what is not in the sequences is empty."""
    from ..operators.intervals import join_overlaps

    wanted = regions.select("chrom", "start", "end").distinct().withColumn("_last", F.col("end") - 1)
    parts = chunks.withColumn("_c_end", F.col("offset") + F.length("seq") - 1)
    hit = join_overlaps(wanted, parts, "start", "_last", "offset", "_c_end", width=width)
    piece = F.expr("substring(seq, cast(greatest(start - offset, 0) + 1 as int), cast(least(_last, _c_end) - greatest(start, offset) + 1 as int))")
    joined = hit.withColumn("p", F.struct("offset", piece.alias("s"))).groupBy("chrom", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), "").alias("seq"))
    return regions.join(joined, ["chrom", "start", "end"], "left").withColumn("seq", F.coalesce("seq", F.lit(""))).select(*regions.columns, "seq")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics table as CSV; a missing file is an error."""
    return spark.read.csv(path, header=True, inferSchema=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


@dataclass
class MatrixBundle:
    """An annotated sparse matrix: ``x`` (cell, feature, value), tables of cells and features, and more tables by name.

    Kept as a directory of Parquet tables, which stands in for single-file matrix formats.
    """

    x: DataFrame
    obs: DataFrame
    var: DataFrame
    more: dict[str, DataFrame] | None = None

    def write(self, path: str) -> None:
        for name, df in {"x": self.x, "obs": self.obs, "var": self.var, **{f"more/{k}": v for k, v in (self.more or {}).items()}}.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, more: tuple[str, ...] = ()) -> MatrixBundle:
        table = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(table("x"), table("obs"), table("var"), {k: table(f"more/{k}") for k in more})
