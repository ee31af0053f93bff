"""Intermediate tables in the shared folder, and small helpers all operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramlake.session import brief_shuffles, materialise, shared_dir

def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that a lost executor costs a re-read."""
    return materialise(df, purpose)


def bucketed(df: DataFrame, purpose: str, key: str) -> DataFrame:
    """As ``written``, in buckets of ``key``: grouping or joining by it later moves none of these rows.

    Format 2 of Parquet writes numbers and strings in order as steps.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with brief_shuffles(spark):
        df.write.format("parquet").option("compression", "zstd").option("parquet.writer.version", "v2").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
