"""The driver's tables read as fragments, transcripts, sequences and rankings, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

CHROMS = [f"chr{i}" for i in range(1, 7)] + ["chrM"]
SIZE = 201000
GENOME = 6.0 * SIZE

# DuckDB views that the oracles begin with.
FRAGMENTS = """frag as (
  select concat('chr', case when l_linenumber=7 then 'M' else cast(l_linenumber as varchar) end) as chrom,
         (l_partkey*53+l_orderkey*7)%200000 as s, (l_partkey*53+l_orderkey*7)%200000+40+(l_orderkey*7+l_linenumber*13)%860 as e,
         concat('BC', cast(l_suppkey as varchar)) as barcode, cast(l_quantity as int) as n, l_suppkey%4 as g
  from lineitem)"""
# Fragments of every fourth window of 5,000 bases drawn together, so that there are peaks.
PEAK_FRAGMENTS = (
    FRAGMENTS.replace("frag as", "frag0 as", 1),
    "frag1 as (select *, case when s//5000%4 = 0 then s - s%5000 + s%300 else s end as t from frag0)",
    "frag as (select chrom, t as s, t + e - s as e, barcode, n, g from frag1)",
)
CELLS = """cells as (select barcode from frag group by barcode having count(*) >= 100)"""
# An annotation doesn't grow with the number of cells: all parts together make 200 transcripts.
TRANSCRIPTS = """tx as (
  select concat('chr', cast(1+k%6 as varchar)) as chrom, (k*97)%195000+1 as g_start, (k*97)%195000+1+p_size*100 as g_end,
         case when (k-k%6)%12=0 then '+' else '-' end as strand, concat('T', cast(k as varchar)) as transcript_id,
         concat('G', cast(k%60 as varchar)) as gene_id
  from (select p_partkey%200 as k, max(p_size) as p_size from part group by 1))"""
DNA = """dna as (
  select doc_id, translate(regexp_replace(text,'[^A-Za-z]','','g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT') as seq
  from documents)"""
TILES = """hit as (
  select barcode, chrom, n, s//5000 as tile from frag
  union all select barcode, chrom, n, (e-1)//5000 from frag where (e-1)//5000 <> s//5000),
tiles as (
  select barcode, chrom, tile, cast(count(*) as bigint) as value, cast(sum(n) as bigint) as total
  from hit where barcode in (select barcode from cells) and chrom <> 'chrM' and tile*5000 < 201000 group by barcode, chrom, tile)"""


def fragments(spark: SparkSession, d: str, record: bool = False) -> DataFrame:
    """Fragments; with ``record`` also what tells a row of ``lineitem`` from all others."""
    start = (F.col("l_partkey") * 53 + F.col("l_orderkey") * 7) % 200000
    length = 40 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 860
    chrom = F.concat(F.lit("chr"), F.when(F.col("l_linenumber") == 7, "M").otherwise(F.col("l_linenumber").cast("string")))
    lines = table(spark, d, "lineitem")
    return lines.select(
        chrom.alias("chrom"), start.alias("start"), (start + length).alias("end"), F.concat(F.lit("BC"), F.col("l_suppkey").cast("string")).alias("barcode"),
        F.col("l_quantity").cast("int").alias("count"), (F.col("l_suppkey") % 4).cast("int").alias("group"),
        *([F.concat_ws(":", *[F.col(c).cast("string") for c in lines.columns]).alias("record")] if record else []),
    )


def peak_fragments(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("start")
    drawn = F.when(F.floor(s / 5000) % 4 == 0, s - s % 5000 + s % 300).otherwise(s)
    moved = fragments(spark, d).withColumn("to", drawn)
    return moved.withColumn("end", F.col("to") + F.col("end") - s).withColumn("start", F.col("to")).drop("to")


def sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, SIZE) for c in CHROMS], "chrom string, size long")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    start = (k * 97) % 195000 + 1
    parts = table(spark, d, "part").groupBy((F.col("p_partkey") % 200).alias("k")).agg(F.max("p_size").alias("p_size"))
    return parts.select(
        F.concat(F.lit("chr"), (1 + k % 6).cast("string")).alias("chrom"), start.alias("g_start"), (start + F.col("p_size") * 100).alias("g_end"),
        F.when((k - k % 6) % 12 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("T"), k.cast("string")).alias("transcript_id"),
        F.concat(F.lit("G"), (k % 60).cast("string")).alias("gene_id"),
    )


def genes(spark: SparkSession, d: str) -> DataFrame:
    """One span per gene: its first transcript by place."""
    return transcripts(spark, d).groupBy("gene_id", "chrom", "strand").agg(F.min("g_start").alias("lo"), F.max("g_end").alias("hi")).select(F.col("gene_id").alias("symbol"), "chrom", "lo", "hi", "strand")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """The letters of whole texts, read as bases."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    letters += letters.lower()
    seq = F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), letters, "ACGT" * 13)
    return table(spark, d, "documents").select(F.col("doc_id").alias("region"), seq.alias("seq"), "lang")


def ranking(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("feature"), (F.col("p_retailprice") - 1400.0).cast("double").alias("score"))


def term_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("feature"))
