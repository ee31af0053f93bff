"""Session and storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "engramlake", **conf: str) -> SparkSession:
    """Session for tests and benches. On a cluster the submitter supplies the settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ENGRAMLAKE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the cluster's shared checkpoint folder.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local session without that
    setting (tests, notebooks) falls back to a temporary folder; elsewhere it is an error, because
    executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster[...] has other processes
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="engramlake-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a job inside go as soon as the job ends."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage where a frame feeds several branches that must agree, so a lost executor
    costs a re-read instead of a recomputation that might come out in another order. The shuffle
    files of the job go as soon as the table stands in for them.
    """
    path = shared_dir(df.sparkSession, purpose)
    with brief_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MOST_BROADCAST = 50_000  # rows


def sized(written: DataFrame) -> DataFrame:
    """A written table, marked for a sort-merge join if it has many rows.

    Spark takes the size of the compressed files for the size in memory, and so would send a table to the driver and
    every executor that is many times its threshold. The rows are counted from the files' footers.
    """
    return written.hint("merge") if written.count() > MOST_BROADCAST else written


def bucketed(df: DataFrame, purpose: str, keys: Sequence[str]) -> DataFrame:
    """As ``materialise``, in buckets of ``keys``: a later join or grouping by them moves none of these rows."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows meet by bucket before the write, so that a bucket is one file
    rows = df.repartition(buckets, *keys)
    rows.write.format("parquet").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where the input comes in fewer splits than there are cores.

    A file with one row group is one task however costly its rows are. Inputs that already split
    widely (the normal case on a cluster) are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
