"""Hard negatives by slot-decomposed selection.

A positive allows the negatives whose score lies in a window below its own. The windows' upper
limits of an anchor cut all scores into disjoint slots. Every task keeps the top k of each slot,
which merge by shuffling; the answer to a window is the top k of its own slot and all below it. So
one descending merge over the slots answers all windows of an anchor, however they overlap: what
lies above the lower limit is always a prefix of that answer.

Rows are dealt to blocks, and each block meets all anchors as they stream past it. A score is an
exact integer: float64 products where no sum can pass 2^53, Python integers otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.store import written

SCALE = 256
BLOCK_BYTES = 16 << 20
STRIP = 32
EXACT = 1 << 53
LONG = (-(1 << 63), (1 << 63) - 1)
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90


def participating(rows: DataFrame, is_anchor: Column, *, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label, vec, asks of the rows that take part, one for each id."""
    rows = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where("id is not null and label is not null and vec is not null").where(~bad)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec", "asks")).alias("row")).select("id", "row.*")


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles; infinite where the product is beyond them."""
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def _whole(v: float) -> int:
    """floor(256 * v) of one component, exactly."""
    return int(v) * SCALE if abs(v) >= EXACT else int(np.floor(v * SCALE))


class Scorer:
    """Integer inner products of the rows of a block with anchors, within the range of a long."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.q = x, quantised(x)
        limit = np.sqrt(EXACT / max(1, x.shape[1]))
        self.wide = np.flatnonzero((np.abs(self.q) > limit).any(axis=1)) if x.size else np.zeros(0, np.int64)
        self.limit = limit
        self.small = self.q
        if len(self.wide):
            self.small = self.q.copy()
            self.small[self.wide] = 0

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """anchors x rows, as 64-bit integers."""
        q = quantised(anchors)
        wide = (np.abs(q) > self.limit).any(axis=1)
        out = (np.where(wide[:, None], 0.0, q) @ self.small.T).astype(np.int64)
        for i in range(len(anchors)):
            for j in range(len(self.x)) if wide[i] else self.wide:
                exact = sum(_whole(a) * _whole(b) for a, b in zip(anchors[i], self.x[j], strict=True))
                out[i, j] = min(max(exact, LONG[0]), LONG[1])
        return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, larger first, ties by place."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.argsort(-scores[at].astype(object) if len(at) and scores[at].min() == LONG[0] else -scores[at], kind="stable")][:k]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


Pick = Callable[[np.ndarray, np.ndarray, np.ndarray, int, int, list[int]], Iterator[tuple[int, np.ndarray]]]


def _streamed(rows: DataFrame, anchors: DataFrame, blocks: int, dims: int, pick: Pick) -> DataFrame:
    """anchor, slot, id, score: what ``pick`` keeps of each block for each anchor.

    ``rows``: id, label, vec; ``anchors``: the same and limits (array of long). ``pick`` gets scores,
    labels and ids of a block (ids ascend), the anchor's label and id, and its limits.
    """
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(0).alias("asks"), "id", "label", "vec", F.array().cast("array<long>").alias("limits"))
    asks = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("asks"), "id", "label", "vec", "limits")
    parts = max(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = held.union(asks).repartition(parts, "block").sortWithinPartitions("block", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, scorer, ids, labels = None, [], None, None, None
        for b in batches:
            at = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            x = _matrix(b.column(4), dims)
            edges = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1 if len(at) else []
            out: list[list] = [[], [], [], []]
            for lo, hi in zip([0, *edges], [*edges, len(at)], strict=True):
                if lo == hi:
                    continue
                if block != at[lo, 0]:
                    block, kept, scorer = at[lo, 0], [], None
                if at[lo, 1] == 0:
                    kept.append((b.column(2).to_numpy()[lo:hi], b.column(3).to_numpy()[lo:hi], x[lo:hi]))
                    continue
                if not kept:
                    continue
                if scorer is None:
                    ids, labels, vectors = (np.concatenate(c) for c in zip(*kept, strict=True))
                    scorer, kept = Scorer(vectors), [()]
                limits = b.column(5).slice(lo, hi - lo).to_pylist()
                for first in range(lo, hi, STRIP):
                    scores = scorer.scores(x[first : min(hi, first + STRIP)])
                    for i, s in enumerate(scores, first):
                        own_id, own_label = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                        for slot, found in pick(s, labels, ids, own_label, own_id, limits[i - lo]):
                            out[0] += [own_id] * len(found)
                            out[1] += [slot] * len(found)
                            out[2] += ids[found].tolist()
                            out[3] += s[found].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor", "slot", "id", "score"])

    return both.mapInArrow(run, "anchor long, slot long, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first rows of each anchor's slot; Spark cuts each task's share to ``k`` before the shuffle."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _upper(score: int) -> int:
    return HIGH * score // 100


def hard_negatives(
    rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, block_bytes: int = BLOCK_BYTES, least_blocks: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that ``is_anchor``. A score is the inner product of the components
    floor(256 * x); larger scores come first, ties by smaller id. An anchor's positives are the
    first ``positives`` other rows of its label; for each of them the first ``negatives`` rows of
    other labels with 30 * positive <= 100 * negative <= 90 * positive are returned, ranked from 1.

    Rows without id, label or vector, or with a null or non-finite component, take no part, nor do
    vectors of another length than most have (the longer of equals). Rows that repeat an id count
    once: the smallest label, then vector. Scores beyond a long count as its limits. An anchor
    without positives, and a positive whose window is empty, give no rows; an empty table gives none.
    """
    spark = rows.sparkSession
    rows = participating(rows, is_anchor, id_col=id_col, label_col=label_col, vector_col=vector_col)
    rows = written(rows, "negative-rows")
    lengths = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims, n = (lengths.dims, lengths["count"]) if lengths else (0, 0)
    rows = rows.where(F.size("vec") == dims)
    least = spark.sparkContext.defaultParallelism if least_blocks is None else least_blocks
    blocks = max(1, least, -(-n * max(1, dims) * 8 // block_bytes))
    anchors = rows.where("asks").withColumn("limits", F.array().cast("array<long>"))

    def positive(s: np.ndarray, labels: np.ndarray, ids: np.ndarray, label: int, own: int, _: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        same = np.flatnonzero((labels == label) & (ids != own))
        yield 0, same[best(s[same], positives)]

    near = written(_first(_streamed(rows, anchors, blocks, dims, positive), positives), "positives")
    # upper limits of the windows, the largest first; as a positive's limit depends on its score only, equal ones share a slot
    upper = F.expr(f"cast(floor(cast(score as decimal(20, 0)) * {HIGH} / 100) as long)")
    limits = near.where("score >= 0").groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_set(upper), asc=False).alias("limits"))
    asking = written(rows.where("asks").join(limits, "id"), "anchors")

    def slots(s: np.ndarray, labels: np.ndarray, ids: np.ndarray, label: int, own: int, limits: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        other = np.flatnonzero((labels != label) & (s >= 0))  # no window reaches below zero
        at = s[other]
        for top, below in zip(limits, [*limits[1:], -1], strict=True):
            inside = other[(at <= top) & (at > below)]
            yield top, inside[best(s[inside], negatives)]

    tops = _first(_streamed(rows, asking, blocks, dims, slots), negatives)
    tops = tops.groupBy("anchor", "slot").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "id")).alias("top"))
    # from the lowest slot up, each one's top k merged into those below: the answer to the window that ends there
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("slot", "top"))),
        F.struct(F.array().cast("array<struct<s:long,id:long>>").alias("below"), F.array().cast("array<struct<slot:long,top:array<struct<s:long,id:long>>>>").alias("done")),
        lambda a, x: _joined(a, x, negatives),
        lambda a: a["done"],
    )
    answers = tops.groupBy("anchor").agg(merged.alias("done")).select("anchor", F.explode("done").alias("d")).select("anchor", F.col("d.slot").alias("slot"), F.col("d.top").alias("top"))
    # a window's own slot may be empty: then the next slot below answers
    own = near.where("score >= 0").select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), upper.alias("upper"))
    both = own.join(answers.groupBy("anchor").agg(F.collect_list(F.struct("slot", "top")).alias("answers")), "anchor")
    fitting = F.array_max(F.transform(F.filter("answers", lambda a: a["slot"] <= F.col("upper")), lambda a: a["slot"]))
    both = both.withColumn("fitting", fitting).where("fitting is not null")
    both = both.withColumn("top", F.filter("answers", lambda a: a["slot"] == F.col("fitting"))[0]["top"])
    each = both.select("anchor", "positive_id", "positive_score", F.posexplode("top").alias("at", "negative"))
    score = -F.col("negative.s")
    wide = lambda c: c.cast("decimal(20, 0)")
    each = each.where(wide(F.col("positive_score")) * F.lit(LOW) <= wide(score) * F.lit(100))
    return each.select(
        F.col("anchor").alias("anchor_id"), "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("negative.id").alias("negative_id"),
        "positive_score", score.alias("negative_score"),
    )


def _joined(a: Column, x: Column, k: int) -> Column:
    top = F.slice(F.array_sort(F.concat(a["below"], x["top"])), 1, k)
    return F.struct(top.alias("below"), F.concat(a["done"], F.array(F.struct(x["slot"].alias("slot"), top.alias("top")))).alias("done"))
