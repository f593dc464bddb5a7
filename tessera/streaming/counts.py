"""Incremental cell and tile counts over a stream of fragments.

Counts add up, so no watermark is needed: each micro-batch is counted by itself and written under its
number. A batch that is retried writes its number again, so results are the same as one batch over all
input. Every ``COMPACT_EVERY`` batches the state is added up into one version, which replaces what it
holds; readers take the newest version and the batches after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matrix import tiles_of
from ..session import remove, tasks_of

COMPACT_EVERY = 32

#: Rows of a stream from which its state is kept on disk by RocksDB.
STATE_ROWS = 1 << 22
#: Such a state takes a bounded part of an executor's memory, and a batch writes what it changed.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def tile_counts(fragments: DataFrame, tile_size: int = 5000) -> DataFrame:
    """``barcode, chrom, tile, value`` of a batch or a stream of fragments."""
    spread = fragments.select("barcode", "chrom", F.explode(tiles_of(tile_size)).alias("tile"))
    return spread.groupBy("barcode", "chrom", "tile").agg(F.count(F.lit(1)).alias("value"))


def cell_counts(fragments: DataFrame) -> DataFrame:
    """``barcode, n_unique, n_total``."""
    return fragments.groupBy("barcode").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("count").alias("n_total"))


def stream_fragments(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    from ..sources.formats import FRAGMENT

    return spark.readStream.schema(FRAGMENT).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of finished parts (``n=...``) in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    done = lambda p: store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(x.getPath().getName().split("=")[1]) for x in store.listStatus(at) if "=" in x.getPath().getName() and done(x.getPath()))


def _parts(spark: SparkSession, state: str) -> list[str]:
    """The newest version, which holds all batches up to its number, and the later batches."""
    upto = max(_numbers(spark, f"{state}/version"), default=-1)
    parts = [f"{state}/version/n={upto}"] if upto >= 0 else []
    return parts + [f"{state}/batch/n={n}" for n in _numbers(spark, f"{state}/batch") if n > upto]


def count_stream(fragments: DataFrame, state: str, checkpoint: str, tile_size: int = 5000, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Starts a query that keeps the tile counts of all fragments so far under ``state``."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.repartition(tasks_of(spark, batch.count()), "barcode", "chrom")
        tile_counts(dealt, tile_size).write.mode("overwrite").parquet(f"{state}/batch/n={number}")
        if (number + 1) % compact_every:
            return
        versions, batches = _numbers(spark, f"{state}/version"), _numbers(spark, f"{state}/batch")
        if number not in versions:
            read_counts(spark, state).write.mode("overwrite").parquet(f"{state}/version/n={number}")
        # What the last version but one held is no longer read by anyone.
        for n in versions[:-1]:
            remove(spark, f"{state}/version/n={n}")
        for n in batches:
            if versions and n <= versions[-1] and n < number:
                remove(spark, f"{state}/batch/n={n}")

    return fragments.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, state: str) -> DataFrame:
    """The counts over all batches."""
    rows = spark.read.parquet(*_parts(spark, state))
    keys = ("barcode", "chrom", "tile")
    return rows.repartition(tasks_of(spark, rows.count()), *keys).groupBy(*keys).agg(F.sum("value").alias("value"))


def qc_stream(fragments: DataFrame, state: str, checkpoint: str, *, keys: tuple[str, ...] = ("chrom", "start", "end", "barcode"), time: str = "seen", delay: str = "1 day", mito: tuple[str, ...] = ("chrM", "M"), tasks: int | None = None, on_disk: bool = False) -> StreamingQuery:
    """Starts a query that keeps running totals of each barcode, in Spark's own state.

    Fragments with the same ``keys`` within ``delay`` of their ``time`` count once, and those that come
    later than that are dropped. Each micro-batch writes the totals that it changed under its number;
    a batch that is retried, or a query that goes on from its checkpoint, writes the same again. State
    is dealt to ``tasks`` partitions, if given, and kept in memory or ``on_disk``; a checkpoint keeps the
    number and the place that it began with.
    """
    needed = fragments.select(*dict.fromkeys([*keys, time, "barcode", "chrom", "count"]))
    once = needed.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    total = once.groupBy("barcode").agg(
        F.count(F.lit(1)).alias("n_unique"), F.sum(F.col("count").cast("long")).alias("n_total"),
        F.sum(F.when(F.col("chrom").isin(*mito), F.col("count").cast("long")).otherwise(F.lit(0).cast("long"))).alias("n_mito"),
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("n", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{state}/totals/batch={number}")

    writer = total.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    # A query takes the settings that hold when it starts.
    conf, wanted = fragments.sparkSession.conf, {**({"spark.sql.shuffle.partitions": str(tasks)} if tasks else {}), **(ON_DISK if on_disk else {})}
    before = {name: conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def read_qc(spark: SparkSession, state: str, min_fragments: int = 100) -> DataFrame:
    """``barcode, n_unique, duplicate_fraction, mito_fraction`` by the newest totals of each barcode."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{state}/totals")
    last = rows.groupBy("barcode").agg(F.max_by(F.struct("n_unique", "n_total", "n_mito"), "n").alias("t")).select("barcode", "t.*").filter(F.col("n_unique") >= min_fragments)
    total = F.col("n_total") + 1e-9
    return last.select("barcode", "n_unique", ((F.col("n_total") - F.col("n_unique")) / total).alias("duplicate_fraction"), (F.col("n_mito") / total).alias("mito_fraction"))
