"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm import bpe, infill, mixing, negatives, neighbours, oracles, pii, quotes, sharding, simhash, suffixes, superkmers, toxicity, urls
from engramlake.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixes.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "contamination.n_words", "contamination.n_hit", F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "contamination.items"), 256).alias("items_sha256"), suffixes.is_contaminated().alias("contaminated"),
    )


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return superkmers.remove_repeats(docs, texts=False).withColumnRenamed("id", "doc_id")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = toxicity.score(docs, model)
    score = F.col("toxicity.score")
    return found.select(
        "doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
        F.size("toxicity.segments").cast("long").alias("n_segments"),
    )


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query
def op2_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 50 == 0)


#: Configuration of the mixture: weights by path from the root; 1 where none stands here.
TREE = ("domain", "lang", "source")
WEIGHTS = {
    ("web",): 4.0, ("books",): 3.0, ("code",): 2.0, ("forums",): 1.0, ("other",): 1.0,
    ("web", "en"): 2.0, ("books", "en"): 2.0, ("code", "en"): 2.0, ("forums", "en"): 2.0,
}


def domain_of(source: Column) -> Column:
    """The domain of a source, by its number."""
    n = F.regexp_extract(source, "^src([0-9]{1,6})$", 1)
    n = F.when(n != "", n.cast("int"))
    return F.when(n < 5, "web").when(n < 10, "books").when(n < 15, "code").when(n >= 15, "forums").otherwise("other")


def mixture(docs: DataFrame, domain: str = "domain") -> DataFrame:
    """``docs`` mixed, with the column ``domain`` and ``__epoch``."""
    return mixing.mixed(docs.withColumn(domain, domain_of(F.col("source"))), (domain, *TREE[1:]), WEIGHTS)


@query
def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixture(docs).select("doc_id", *TREE, mixing.token_count(F.col("text")).alias("n_tokens"), F.col("__epoch").alias("epoch"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sharding.shards(docs)
    return found.select(
        "doc_id", sharding.shard_name(F.col("__depth"), F.col("__prefix")).alias("shard"), F.col("__depth").alias("depth"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )


ORACLES["op3_mixing_sources"] = oracles.mixing_sql(WEIGHTS, TREE)
ORACLES["op6_sharding"] = oracles.sharding_sql()


@query
def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.threads(table(spark, sf_dir, "conversations"))
    return found.select(
        F.col("conv").alias("conv_id"), "turn", F.md5("own").alias("text_md5"), "n_quotes", "n_linked", "reply_to", "thread", "depth"
    )


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), redact=False)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in pii.KINDS],
        F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"),
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return infill.restore(made).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


@query
def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


ORACLES["op11_fill_in_middle"] = oracles.INFILL
ORACLES["op12_hard_negative_mining"] = oracles.NEGATIVES
