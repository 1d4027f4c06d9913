"""Session helpers: a tuned session, and a fault-tolerant way to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "zonewise", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench; on a cluster the submitted session is used as it is."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("ZONEWISE_DRIVER_MEMORY", "8g"))
        )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such a
    folder is invisible to the other machines.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="zonewise-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written_folder(spark: SparkSession) -> str:
    """The part of the shared folder that holds what this application has written."""
    return f"{checkpoint_root(spark)}/zonewise/{spark.sparkContext.applicationId}"


def clear_written(spark: SparkSession) -> None:
    """Remove this application's intermediates, through the file system that holds them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(written_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


PART_BYTES = 64 << 20


def parts_of(spark: SparkSession, size: int) -> int:
    """How many parts hold ``size`` bytes of rows at about ``PART_BYTES`` each, no fewer than there are cores.

    For rows that shrink when they are shuffled or grow after it: the shuffled bytes do not tell what a task has to hold.
    """
    return max(spark.sparkContext.defaultParallelism, -(-int(size) // PART_BYTES))


def pin(df: DataFrame, partition_by: tuple[str, ...] = (), rows_per_file: int | None = None) -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back.

    Survives lost executors, cuts the plan, and gives the optimizer the true size
    of the table, so that joins against it are broadcast only when it is under
    ``spark.sql.autoBroadcastJoinThreshold``. A reader takes 4,096 rows of a file
    at a time, so rows that hold long arrays need few ``rows_per_file``.
    """
    spark = df.sparkSession
    path = f"{written_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove what these tables read of this application's written intermediates, once no later step reads it.

    Whatever was made of them must itself have been written; other files stay.
    """
    for df in tables:
        spark, own = df.sparkSession, f"/zonewise/{df.sparkSession.sparkContext.applicationId}/"
        heads = {f[: f.index(own) + len(own)] + f[f.index(own) + len(own) :].split("/", 1)[0] for f in df.inputFiles() if own in f}
        for head in heads:
            path = spark._jvm.org.apache.hadoop.fs.Path(head)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
