"""Session settings and the shared folder that survives the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Bytes that rows take in memory for each byte of a file, at least where values repeat.
FILE_FACTOR = "20"


def expect_compressed(spark: SparkSession) -> None:
    """Size estimates of tables in files allow for their compression, unless the session says by how much itself.

    A table of a few MB on disk is several hundred in memory; planned by its size on disk it is broadcast through the
    driver.  Beyond the estimate AQE still broadcasts what it measures to be small.
    """
    if float(spark.conf.get(_FACTOR)) == 1.0:
        spark.conf.set(_FACTOR, FILE_FACTOR)


def build_session(app: str = "vacantia", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs are written for.

    Nothing is broadcast by hint: Spark broadcasts a join side only when its
    measured size is below ``autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config(_FACTOR, FILE_FACTOR))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; any other session fails, since
    executors would not see each other's files.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="vacantia-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` over as many partitions as shuffles have, by the hash of ``cols``.

    For the small side of a join that gives many rows per row: AQE merges partitions
    by their bytes and would leave such a side in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For a result that several branches of one job use: the branches read the table
    instead of repeating its work, and a lost executor repeats nothing but the read.
    The shuffle files of the write go when it has ended, so that the disk holds those of one job at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    had = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if had is None else spark.conf.set(_CLEANUP, had)
    return spark.read.schema(df.schema).parquet(path)
