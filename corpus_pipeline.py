"""The corpus pipeline: documents in, kept, mixed and sharded documents out.

Each stage works on all that its predecessor kept, returns the columns it got (the last adds shard
and depth, replacing columns of these names) and takes what else it needs from the tables in
``sf_dir``. Null and empty texts, null ids, repeated rows and empty tables have the results the
operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm import sharding, simhash, suffixes, toxicity
from engramlake.llm.queries import held_out, mixture
from engramlake.llm.store import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go; the model is fitted on the stage's input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model, name="__toxicity").where("__toxicity.score < 0.5").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, by a twentieth of their words or more, go."""
    return suffixes.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights of domain, language and source; a row for each epoch a document is in."""
    return mixture(docs, domain="__domain").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each row."""
    found = sharding.shards(docs)
    name = sharding.shard_name(F.col("__depth"), F.col("__prefix"))
    kept = [c for c in docs.columns if c not in ("shard", "depth")]
    return found.select(*kept, name.alias("shard"), F.col("__depth").alias("depth"))


STAGES = [
    ("toxicity", reject_toxic), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate),
    ("mixing_sources", mix), ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
