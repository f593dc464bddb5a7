"""Session helpers: a local session, table access and durable intermediate results."""

from __future__ import annotations

import logging
import tempfile
import uuid
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Names of log levels.
LEVELS = {"error": logging.ERROR, "warning": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG}


def set_verbosity(level: str | int) -> None:
    """How much the library logs: error, warning, info or debug, or 0 to 3."""
    if isinstance(level, int):
        level = list(LEVELS)[level] if 0 <= level < len(LEVELS) else str(level)
    if level not in LEVELS:
        raise ValueError(f"unknown verbosity {level!r}; known: {', '.join(LEVELS)}")
    log = logging.getLogger("tessera")
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(LEVELS[level])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A machine-local folder is made only where neither that setting nor a checkpoint
    directory exists and the master is local; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage, surviving the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of input for each task of a shuffle whose memory goes with its rows.
TASK_ROWS = 1 << 20


def tasks_of(spark: SparkSession, rows: int) -> int:
    """As many tasks as the rows fill, and no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def stored(df: DataFrame, path: str | None = None, tasks: int | None = None, batch: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, without its shuffle files.

    Its shuffles have ``tasks`` partitions, and Python workers are handed ``batch`` rows at once, if given.

    The plan is written from a copy of the session that removes shuffle files once the write ends,
    so that the steps of a job don't add up on disk. The caller's session keeps its settings.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    again = spark._jsparkSession.cloneSession()
    again.conf().set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if tasks:
        again.conf().set("spark.sql.shuffle.partitions", str(tasks))
    if batch:
        again.conf().set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(again, df._jdf.logicalPlan())
    DataFrame(plan, SparkSession(spark.sparkContext, again)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The size of a folder, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, key: str, tables: list[str]) -> DataFrame:
    """``df`` as a table of the warehouse in buckets of ``key``, sorted by it; its name is added to ``tables``.

    Joins and aggregations by ``key`` read it again and again without dealing it out anew. Drop the
    table when it is no longer read.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tessera_{uuid.uuid4().hex}"
    tables.append(name)
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)
