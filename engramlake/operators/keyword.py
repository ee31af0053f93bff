"""Keyword search for the k best entries over a block-max inverted index.

An entry belongs to one of its scope's blocks by the hash of its id. The index has a row per word and
block: the postings, and the largest part that the word can add to a score in that block. For a query the
sums of these maxima bound every score of a block from above, without a look at the postings. The blocks of
the highest bounds are scored first; of the others only those that can still hold one of the k best are.
Words that stand in most entries so cost a row per block, not a row per entry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.functions.scale import top_k
from engramlake.functions.text import exploded, words
from engramlake.operators.memory import B, K1
from engramlake.session import bucketed, materialise

BLOCK_ENTRIES = 128
LEAD = 4
SLACK = 1e-9  # bounds are sums of doubles in any order

EXACT = "decimal(38,18)"  # sums do not depend on their order, so equal entries tie


def asked_words(queries: DataFrame, scope: Sequence[str] = ("agent_id",)) -> DataFrame:
    """scope, query_id, tok, qtf."""
    keys = [*scope, "query_id"]
    return exploded(queries, keys, words(F.col("text")), "tok").groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("qtf"))


def keyword_index(
    entries: DataFrame, scope: Sequence[str] = ("agent_id",), *, only: DataFrame | None = None, block_entries: int = BLOCK_ENTRIES
) -> DataFrame:
    """scope, tok, block, n_docs, n, top, postings (entry_id, impact), bucketed by the first three.

    ``entries``: scope, entry_id (one row each), content; a null text is an empty one. With ``only`` (scope,
    tok) other words stay out before the first shuffle. A block holds about ``block_entries`` entries.
    """
    scope = list(scope)
    doc = entries.select(*scope, "entry_id", words(F.coalesce("content", F.lit(""))).alias("__w"))
    stats = doc.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("__w")).alias("__avgdl"))
    each = exploded(doc, [*scope, "entry_id", F.size("__w").alias("__dl")], F.col("__w"), "tok")
    if only is not None:
        each = each.join(only.select(*scope, "tok").distinct(), [*scope, "tok"], "left_semi")
    tf = each.groupBy(*scope, "entry_id", "__dl", "tok").agg(F.count(F.lit(1)).alias("__tf")).join(stats, scope)
    block = F.pmod(F.xxhash64("entry_id"), F.ceil(F.col("n_docs") / block_entries)).cast("long").alias("block")
    norm = K1 * (1 - B + B * F.col("__dl") / F.col("__avgdl"))
    impact = (F.col("__tf") * (K1 + 1) / (F.col("__tf") + norm)).alias("impact")
    index = tf.select(*scope, "tok", block, "n_docs", "entry_id", impact).groupBy(*scope, "tok", "block").agg(
        F.first("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n"), F.max("impact").alias("top"),
        F.collect_list(F.struct("entry_id", "impact")).alias("postings"),
    )
    return bucketed(index, "keyword-index", [*scope, "tok", "block"])


def weighted_words(queries: DataFrame, index: DataFrame, scope: Sequence[str] = ("agent_id",)) -> DataFrame:
    """scope, query_id, tok, weight: repetitions in the query times the inverse document frequency."""
    scope = list(scope)
    df = index.groupBy(*scope, "tok").agg(F.sum("n").alias("__df"), F.first("n_docs").alias("__n"))
    idf = F.log(1 + (F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5))
    d = asked_words(queries, scope).join(df, [*scope, "tok"])
    return d.select(*scope, "query_id", "tok", (F.col("qtf") * idf).alias("weight"))


def block_bounds(terms: DataFrame, index: DataFrame, scope: Sequence[str] = ("agent_id",)) -> DataFrame:
    """scope, query_id, block, bound: no entry of the block scores more. Reads no postings."""
    scope = list(scope)
    tops = index.select(*scope, "tok", "block", "top")
    return terms.join(tops, [*scope, "tok"]).groupBy(*scope, "query_id", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))


def block_scores(chosen: DataFrame, terms: DataFrame, index: DataFrame, scope: Sequence[str] = ("agent_id",)) -> DataFrame:
    """scope, query_id, entry_id, score of all entries of the ``chosen`` blocks (scope, query_id, block) that share a word."""
    scope = list(scope)
    keys = [*scope, "query_id"]
    wanted = chosen.select(*keys, "block").join(terms, keys)
    held = index.select(*scope, "tok", "block", "postings")
    each = wanted.join(held, [*scope, "tok", "block"]).select(*keys, "weight", F.explode("postings").alias("p"))
    part = (F.col("weight") * F.col("p.impact")).cast(EXACT)
    return each.groupBy(*keys, F.col("p.entry_id").alias("entry_id")).agg(F.sum(part).alias("score"))


def open_blocks(bounds: DataFrame, read: DataFrame, got: DataFrame, k: int, scope: Sequence[str] = ("agent_id",)) -> DataFrame:
    """The blocks not among ``read`` whose bound reaches the k-th best score in ``got``, or all where it has fewer."""
    keys = [*scope, "query_id"]
    bar = top_k(got, keys, [F.col("score").desc(), F.col("entry_id")], k, "__rank").where(F.col("__rank") == k)
    bar = bar.select(*keys, F.col("score").cast("double").alias("__bar"))
    left = bounds.join(read.select(*keys, "block"), [*keys, "block"], "left_anti").join(bar, keys, "left")
    return left.where(F.col("__bar").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("__bar"))).drop("__bar")


def bm25_topk(
    queries: DataFrame, entries: DataFrame, k: int, scope: Sequence[str] = ("agent_id",), *, index: DataFrame | None = None,
    block_entries: int = BLOCK_ENTRIES, lead: int = LEAD,
) -> DataFrame:
    """The ``k`` entries of each query's scope with the highest Okapi scores: scope, query_id, entry_id, score, rank.

    Scores are those of ``bm25_scores``; ties go to the smaller entry id. Entries that share no word with
    the query are not returned, so a query may get fewer than ``k``. An ``index`` of all words
    (``keyword_index``) can be given and used again; else one of the words asked for is built.
    """
    scope = list(scope)
    keys = [*scope, "query_id"]
    if index is None:
        index = keyword_index(entries, scope, only=asked_words(queries, scope), block_entries=block_entries)
    terms = materialise(weighted_words(queries, index, scope), "query-words")
    bounds = materialise(block_bounds(terms, index, scope), "block-bounds")
    read = top_k(bounds, keys, [F.col("bound").desc(), F.col("block")], lead, "__first")
    got = materialise(block_scores(read, terms, index, scope), "first-scores")
    rest = block_scores(open_blocks(bounds, read, got, k, scope), terms, index, scope)
    best = top_k(got.unionByName(rest), keys, [F.col("score").desc(), F.col("entry_id")], k, "rank")
    return best.withColumn("score", F.col("score").cast("double"))
