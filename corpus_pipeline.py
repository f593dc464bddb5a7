"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but
the last return the columns of ``documents``. The last returns the mixture: a row for each copy of
a document that the mix takes, with the words that it takes.

Defined results: null and empty texts fail the quality rules and go; rows without an id are kept or
dropped by their own text and never as copies; repeated rows stay together, and each is mixed; null
languages and sources are groups of their own; texts are read whole; columns other than those of
``documents`` are left out; an empty table gives an empty mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, linedup, mixing, quality, superminhash
from tessera.session import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.keep_good(docs).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source; documents of which nothing is left stay, empty.

    Copies are still there, so pages with equal texts count once; the next stage drops them.
    """
    out = linedup.drop_boilerplate(docs, copies=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, by shingles of five words."""
    return superminhash.drop_copies(docs, k=5, percent=80).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents into which a benchmark item leaks."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources, 150% of what is left, weighed 5, 2, 1 in turn."""
    mixed = mixing.copies(mixing.mix(docs, keep=True))
    return mixed.select(*COLUMNS, "epoch", "copy_words", "size", "taken", "source_size", "target")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Near-duplicates have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
