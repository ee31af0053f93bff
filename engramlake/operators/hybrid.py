"""Hybrid retrieval without a row for each query and entry.

The final score is at most 1/61 and at least 0.3 / (60 + n), times a decay that halves every 69
writes. So an entry much older than the k-th newest of its scope cannot reach the k best, whatever
its ranks: the window of candidates grows with the logarithm of the number of entries. Exact ranks
are needed for candidates only. Blocks of entries are scored in place, first for the candidates
among them, then to count how many entries stand before each candidate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.scale import top_k
from engramlake.functions.text import exploded, words
from engramlake.operators.memory import DECAY, K1, RRF_K, W_KEYWORD, W_VECTOR, B
from engramlake.session import materialise

BLOCK_ROWS = 20_000
ARROW = {"long": pa.int64(), "double": pa.float64()}

Scores = tuple[np.ndarray, np.ndarray]


def window(n: Column) -> Column:
    """Writes by which a candidate may be older than the k-th newest of ``n`` entries."""
    ratio = (W_VECTOR + W_KEYWORD) / (RRF_K + 1) / W_KEYWORD
    return F.ceil(F.log((RRF_K + n) * ratio) / -math.log(DECAY)) + 1


def candidates(entries: DataFrame, k: int, scope: Sequence[str]) -> DataFrame:
    """(scope, entry_id, age) of the entries that can be among the ``k`` best of some query."""
    scope = list(scope)
    newest = top_k(entries.select(*scope, "seq"), scope, [F.col("seq").desc()], k, "__n").groupBy(*scope).agg(F.min("seq").alias("__kth"))
    size = entries.groupBy(*scope).agg(F.count(F.lit(1)).alias("__size"), F.max("seq").alias("__latest"))
    kept = entries.select(*scope, "entry_id", "seq").join(newest.join(size, scope), scope).where(F.col("seq") >= F.col("__kth") - window(F.col("__size")))
    return kept.select(*scope, "entry_id", (F.col("__latest") - F.col("seq")).alias("age"))


def _terms(queries: DataFrame, entries: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scope, query_id, terms) and (scope, entry_id, parts): weights of asked words, and what an entry has of them."""
    asked = exploded(queries, [*scope, "query_id"], words(F.col("text")), "tok").groupBy(*scope, "query_id", "tok").agg(F.count(F.lit(1)).alias("qtf"))
    doc = entries.select(*scope, "entry_id", words(F.col("content")).alias("__w"))
    stats = doc.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("__w")).alias("avgdl"))
    tf = (
        exploded(doc, [*scope, "entry_id", F.size("__w").alias("dl")], F.col("__w"), "tok")
        .join(asked.select(*scope, "tok").distinct(), [*scope, "tok"], "left_semi")
        .groupBy(*scope, "entry_id", "dl", "tok").agg(F.count(F.lit(1)).alias("tf"))
    )
    tf = materialise(tf, "asked-words")
    idf = tf.groupBy(*scope, "tok").agg(F.count(F.lit(1)).alias("df")).join(stats, scope).select(
        *scope, "tok", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    weighed = asked.join(idf, [*scope, "tok"]).groupBy(*scope, "query_id").agg(
        F.sort_array(F.collect_list(F.struct("tok", (F.col("qtf") * F.col("idf")).alias("w")))).alias("terms")
    )
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = tf.join(stats, scope).groupBy(*scope, "entry_id").agg(F.collect_list(F.struct("tok", part.alias("w"))).alias("parts"))
    return weighed, parts


class _Block:
    """Entries of a block, ordered by id: vectors with their lengths, and postings of the asked words."""

    def __init__(self, rows: list[tuple], dims: int, digits: int | None) -> None:
        rows.sort(key=lambda r: r[0])
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.age = [r[3] for r in rows]
        self.digits = digits
        self.has = np.array([r[1] is not None for r in rows], bool)
        self.x = np.zeros((len(rows), dims))
        for i, (_, v, _, _) in enumerate(rows):
            if v is not None and len(v) == dims and None not in v:
                self.x[i] = v
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        postings: dict[str, list] = {}
        for i, (_, _, parts, _) in enumerate(rows):
            for p in parts or ():
                postings.setdefault(p["tok"], []).append((i, p["w"]))
        self.postings = {t: (np.array([i for i, _ in p]), np.array([w for _, w in p])) for t, p in postings.items()}

    def scores(self, vector: list[float] | None, terms: list[dict] | None) -> Scores:
        """Cosine (NaN without an embedding) and keyword score of every entry; equal entries have equal scores."""
        dims = self.x.shape[1]
        q = np.array(vector, float) if vector is not None and len(vector) == dims and None not in vector else np.zeros(dims)
        size = self.norm * np.sqrt((q * q).sum())
        near = np.divide((self.x * q).sum(axis=1), size, out=np.zeros(len(size)), where=size > 0)
        near[~self.has] = np.nan
        told = np.zeros(len(size))
        for t in terms or ():
            if t["tok"] in self.postings:
                at, w = self.postings[t["tok"]]
                told[at] += t["w"] * w
        return (near, told) if self.digits is None else (np.round(near, self.digits), np.round(told, self.digits))

    def before(self, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many entries stand before each (score, id): a larger score, or the same and a smaller id."""
        some = np.flatnonzero(~np.isnan(scores))
        order = some[np.argsort(-scores[some], kind="stable")]  # ids ascend among equals
        falling, at = -scores[order], self.ids[order]
        lo, hi = np.searchsorted(falling, -own, "left"), np.searchsorted(falling, -own, "right")
        return np.array([a + np.searchsorted(at[a:b], i) if b > a else a for a, b, i in zip(lo, hi, ids, strict=True)], np.int64)


def _by_block(
    held: DataFrame, asks: DataFrame, scope: list[str], dims: int, digits: int | None, answer: Callable[[_Block, dict], list[tuple]], outs: dict[str, str]
) -> DataFrame:
    """Rows of ``answer`` for every query in every block of its scope. A task holds one block; queries stream past it."""
    cols = [*scope, "__block", "__kind", "entry_id", "embedding", "parts", "age", "query_id", "qvec", "terms", "pool"]
    empty = lambda frame, other: frame.withColumns({c: F.lit(None).cast(other.schema[c].dataType) for c in cols if c not in frame.columns})
    held, asks = held.withColumn("__kind", F.lit(0)), asks.withColumn("__kind", F.lit(1))
    both = empty(held, asks).select(*cols).union(empty(asks, held).select(*cols))
    both = both.repartition(*scope, "__block").sortWithinPartitions(*scope, "__block", "__kind")
    n = len(scope) + 1
    named = {c: both.schema[c].dataType.simpleString() for c in (*scope, "query_id")} | outs
    schema = ", ".join(f"{c} {t}" for c, t in named.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, block = None, [], None
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                own = tuple(row[c] for c in cols[:n])
                if own != now:
                    now, rows, block = own, [], None
                if row["__kind"] == 0:
                    rows.append((row["entry_id"], row["embedding"], row["parts"], row["age"]))
                    continue
                if block is None:
                    block, rows = _Block(rows, dims, digits), []
                out += [(*own[:-1], row["query_id"], *r) for r in answer(block, row)]
            kinds = [*(b.schema.field(c).type for c in (*scope, "query_id")), *(ARROW[t] for t in outs.values())]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*scope, "query_id", *outs])

    return both.mapInArrow(run, schema)


def _pool(block: _Block, row: dict) -> list[tuple]:
    near, told = block.scores(row["qvec"], row["terms"])
    return [(int(block.ids[i]), int(a), None if np.isnan(near[i]) else float(near[i]), float(told[i])) for i, a in enumerate(block.age) if a is not None]


def _counts(block: _Block, row: dict) -> list[tuple]:
    near, told = block.scores(row["qvec"], row["terms"])
    ids = np.array([p["entry_id"] for p in row["pool"]], np.int64)
    own = [np.array([np.nan if p[c] is None else p[c] for p in row["pool"]], float) for c in ("near", "told")]
    first, second = block.before(near, ids, own[0]), block.before(told, ids, own[1])
    return [(int(i), int(a), int(c)) for i, a, c in zip(ids, first, second, strict=True)]


def hybrid_search(
    queries: DataFrame, entries: DataFrame, k: int, dims: int, scope: Sequence[str] = ("agent_id",), *, block_rows: int = BLOCK_ROWS, digits: int | None = None
) -> DataFrame:
    """Top ``k`` entries per query by fused rank with recency decay.

    (scope, query_id, entry_id, rank_vec, rank_bm25, rrf, score, position). Ranks are over all entries
    of the scope; an entry without an embedding has its keyword rank only. With ``digits``, scores that
    round to the same number tie; ties go to the smaller integer entry_id, which is unique in its scope.
    """
    scope = list(scope)
    weighed, parts = _terms(queries, entries, scope)
    asks = queries.select(*scope, "query_id", F.col("qvec").cast("array<double>").alias("qvec")).join(weighed, [*scope, "query_id"], "left")
    pool = candidates(entries, k, scope)
    pieces = entries.groupBy(*scope).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("__pieces"))
    held = entries.select(*scope, "entry_id", F.col("embedding").cast("array<double>").alias("embedding")).join(parts, [*scope, "entry_id"], "left")
    held = held.join(pool, [*scope, "entry_id"], "left").join(pieces, scope)
    held = materialise(held.withColumn("__block", F.pmod(F.xxhash64("entry_id"), F.col("__pieces"))).drop("__pieces"), "entry-blocks")
    each = asks.join(pieces, scope).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__pieces") - 1))).drop("__pieces")
    none = F.lit(None).cast("array<struct<entry_id:bigint,near:double,told:double>>")
    scored = _by_block(
        held.where("age is not null"), each.withColumn("pool", none), scope, dims, digits, _pool,
        {"entry_id": "long", "age": "long", "near": "double", "told": "double"},
    )
    scored = materialise(scored, "candidate-scores")
    pools = scored.groupBy(*scope, "query_id").agg(F.collect_list(F.struct("entry_id", "near", "told")).alias("pool"))
    counted = _by_block(
        held, each.join(pools, [*scope, "query_id"]), scope, dims, digits, _counts, {"entry_id": "long", "n_near": "long", "n_told": "long"}
    )
    ranks = counted.groupBy(*scope, "query_id", "entry_id").agg((F.sum("n_near") + 1).alias("rank_vec"), (F.sum("n_told") + 1).alias("rank_bm25"))
    d = ranks.join(scored, [*scope, "query_id", "entry_id"]).withColumn("rank_vec", F.when(F.col("near").isNotNull(), F.col("rank_vec")))
    rrf = F.coalesce(W_VECTOR / (RRF_K + F.col("rank_vec")), F.lit(0.0)) + W_KEYWORD / (RRF_K + F.col("rank_bm25"))
    d = d.withColumn("rrf", rrf).withColumn("score", F.col("rrf") * F.pow(F.lit(DECAY), F.col("age")))
    d = d.select(*scope, "query_id", "entry_id", "rank_vec", "rank_bm25", "rrf", "score").where(F.col("score") > 0)
    return top_k(d, [*scope, "query_id"], [F.col("score").desc(), F.col("entry_id")], k, "position")
