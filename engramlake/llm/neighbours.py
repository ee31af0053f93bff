"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table has ``bits`` functions floor((a.v + b) / width) with Gaussian a over unit vectors; their
values are a bucket. A query visits its own bucket and perturbed ones in the order of their
estimated chance to hold a neighbour: the product, over the functions, of the Gaussian mass of the
perturbed interval. Candidates are scored in their bucket by exact cosine, and the tables' best are
merged. How many buckets to visit is fitted on a sample of queries with known neighbours.

Queries that so find fewer than k rows visit more buckets, and at last all vectors, block by block. Where
the sample shows that the most buckets a query may visit miss the recall, all queries take that exact way.

Equal vectors are one class, so a vector that a third of the rows share is indexed once. Buckets
with more rows than ``piece`` are split, and queries visit all pieces.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.store import written
from engramlake.session import MOST_BROADCAST, sized

TABLES = 4
WIDTH = 1.5
BUCKET_ROWS = 2048
PIECE = 16_384
SAMPLE = 256
RECALL = 0.98
MOST_PROBES = 20_000
MORE_PROBES = 8  # times as many buckets for queries that found too little


def usable(vector: Column) -> Column:
    """Vectors of finite components that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query in double precision; a row's value does not depend on the others.

    Each vector is first scaled by a power of two, which is exact, so that no square is infinite or lost.
    """
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    query = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    dot = (vectors * query).sum(axis=1)
    return dot / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort([ids, -scores])[:k]


@dataclass
class Index:
    a: np.ndarray  # table x function x dims
    b: np.ndarray
    spread: float  # expected distance of a neighbour

    @classmethod
    def of(cls, dims: int, rows: int, spread: float, seed: int, tables: int, width: float) -> Index:
        bits = max(1, round(math.log2(max(2, rows / BUCKET_ROWS)) / cls.entropy(width)))
        rng = np.random.default_rng(seed)
        return cls(rng.normal(size=(tables, bits, dims)) / width, rng.random((tables, bits)), spread / width)

    @staticmethod
    def entropy(width: float) -> float:
        """Bits that one function tells about a random unit vector (its projection has variance 1/dims scaled to 1)."""
        edges = np.arange(-8, 9) * width
        p = np.diff([0.5 * math.erfc(-e / math.sqrt(2)) for e in edges])
        p = p[p > 0]
        return float(-(p * np.log2(p)).sum())

    def reachable(self) -> int:
        """Buckets of a table that ``probes`` can list at all."""
        return 12 ** self.a.shape[1]

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """table x row x function, before flooring."""
        return np.einsum("tfd,nd->tnf", self.a, _unit(vectors)) + self.b[:, None, :]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        return bucket_keys(np.floor(self.places(vectors)).astype(np.int64))

    def probes(self, place: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` buckets (rows of function values) for one query in one table, likeliest first."""
        base = np.floor(place)
        costs, moves = [], []
        for x, f in zip(place, base, strict=True):
            step = np.arange(f - 6, f + 7)
            mass = np.diff([0.5 * math.erfc(-(e - x) / self.spread / math.sqrt(2)) for e in (*step, step[-1] + 1)])
            order = np.argsort(-mass, kind="stable")
            keep = order[mass[order] > 1e-12]
            costs.append((-np.log(mass[keep])).tolist())
            moves.append(step[keep])
        first = (0,) * len(costs)
        heap, seen, out = [(sum(c[0] for c in costs), first)], {first}, []
        while heap and len(out) < most:
            cost, at = heapq.heappop(heap)
            out.append([moves[i][j] for i, j in enumerate(at)])
            for i, j in enumerate(at):
                if j + 1 < len(costs[i]):
                    new = (*at[:i], j + 1, *at[i + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(heap, (cost - costs[i][j] + costs[i][j + 1], new))
        return np.array(out, np.int64)


def bucket_keys(values: np.ndarray) -> np.ndarray:
    """One number for the function values on the last axis."""
    key = np.zeros(values.shape[:-1], np.int64)
    for i in range(values.shape[-1]):
        key = key * 1_000_003 + values[..., i] + 17
    return key


def _sampled(classes: DataFrame, queries: DataFrame, dims: int, k: int, sample: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """About ``sample`` query vectors and the exact nearest vectors of each."""
    spark = classes.sparkSession
    n = queries.count()
    some = queries.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 40)) < int(min(1.0, sample / max(1, n)) * (1 << 40)))
    rows = [(r.cls, np.array(r.vec, float)) for r in some.collect()]
    if not rows:
        return []
    shared = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in shared.value]
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), dims)
            for i, (own, q) in enumerate(shared.value):
                s = np.where(ids == own, -2.0, cosines(x, q)) if len(x) else np.zeros(0)
                best[i] += [(s[j], ids[j], x[j]) for j in _top(s, ids, k)]
                best[i] = sorted(best[i], key=lambda r: (-r[0], r[1]))[:k]
        out = [(i, s, c, v.tolist()) for i, rows in enumerate(best) for s, c, v in rows if s > -2]
        q, s, c, v = ([r[j] for r in out] for j in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.float64()), pa.array(c, pa.int64()), pa.array(v, pa.list_(pa.float64()))], ["q", "s", "c", "v"])

    near = classes.select("cls", "vec").mapInArrow(run, "q int, s double, c long, v array<double>")
    first = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    got = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).collect()
    out: list[list] = [[] for _ in rows]
    for r in got:
        out[r.q].append(np.array(r.v))
    return [(v, found) for (_, v), found in zip(rows, out, strict=True) if found]


def _probes_needed(index: Index, known: list, recall: float) -> int | None:
    """Buckets to visit in each table so that ``recall`` of the sample's neighbours are found; None where the limit finds fewer."""
    ranks = []
    for query, near in known:
        keys = index.keys(np.array(near))
        places = index.places(query[None])
        found = np.full(len(near), MOST_PROBES)
        for t in range(len(index.a)):
            order = {int(v): r for r, v in reversed(list(enumerate(bucket_keys(index.probes(places[t, 0], MOST_PROBES)))))}
            found = np.minimum(found, [order.get(int(x), MOST_PROBES) for x in keys[t]])
        ranks += found.tolist()
    reached = float(np.mean(np.array(ranks) < MOST_PROBES)) if ranks else 1.0
    if reached < recall:
        return None
    return min(MOST_PROBES, 1 + int(np.quantile(ranks, recall, method="higher"))) if ranks else 1


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7,
    tables: int = TABLES, width: float = WIDTH, sample: int = SAMPLE, recall: float = RECALL, piece: int = PIECE,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` its ``k`` nearest rows found, by largest cosine.

    Vectors null, zero, with null or non-finite components, or of another length than most of the
    others (the longer of equals) take no part, nor do rows without an id; repeated rows count once.
    Ties go to the smaller id. A query's own row is no candidate, other rows of the same vector are.
    A query gets fewer than ``k`` rows only where the table holds fewer candidates; an empty table
    gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null")
    rows = rows.where(usable(F.col("vec")))
    lengths = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths.dims if lengths else 0
    rows = rows.where(F.size("vec") == dims)
    # the k + 1 smallest ids of a vector answer for all of its rows; Spark limits them before the shuffle
    own = Window.partitionBy("vec").orderBy("id")
    low = rows.select("id", "vec").withColumn("n", F.dense_rank().over(own)).where(F.col("n") <= k + 1).distinct()
    low = low.withColumn("cls", F.min("id").over(Window.partitionBy("vec")))
    low = sized(written(low, "vector-members"))
    classes = low.where("n = 1").select("cls", "vec")
    asked = rows.where("asks").select("id", "vec").join(classes, "vec").select("id", "cls").distinct()
    asked = sized(written(asked, "vector-queries"))
    queries = written(classes.join(asked.select("cls").distinct(), "cls"), "query-classes")
    n = classes.count()
    known = _sampled(classes, queries, dims, k, sample) if n else []
    far = [math.sqrt(max(0.0, 2 - 2 * float(cosines(np.array(near), q).min()))) for q, near in known]
    index = Index.of(max(1, dims), n, max(0.05, float(np.median(far))) if far else 1.0, seed, tables, width)
    probes = _probes_needed(index, known, recall)
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = shared.value.keys(_matrix(b.column(1), dims)) if b.num_rows else np.zeros((tables, 0), np.int64)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(keys[t]), b.column(0), b.column(1)], ["t", "bucket", "cls", "vec"])

    kinds = "t int, bucket long, cls long, vec array<double>"
    dealt = written(classes.mapInArrow(deal, kinds), "vector-buckets")
    sizes = written(dealt.groupBy("t", "bucket").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces")), "bucket-sizes")
    # each query has many rows in what visits the buckets, and Spark would take them for as few as the queries and broadcast them
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes.hint("merge")
    dealt = dealt.join(sizes, ["t", "bucket"]).withColumn("piece", F.pmod(F.xxhash64("cls"), F.col("pieces")).cast("int"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cols = ["t", "bucket", "piece", "asks", "cls", "vec"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, x = None, [], [], None
        for b in batches:
            at = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
            cls, vec = b.column(4).to_numpy(), _matrix(b.column(5), dims)
            edges = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1 if len(at) else []
            out: list[list] = [[], [], []]
            for lo, hi in zip([0, *edges], [*edges, len(at)], strict=True):
                if lo == hi:
                    continue
                if key != (now := tuple(at[lo, :3])):
                    key, ids, held, x = now, [], [], None
                if at[lo, 3] == 0:
                    ids.append(cls[lo:hi])
                    held.append(vec[lo:hi])
                    x = None
                    continue
                if not held:
                    continue
                if x is None:
                    ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    x = _unit(held[0])
                for i in range(lo, hi):
                    rough = x @ _unit(vec[i : i + 1])[0]
                    cut = np.partition(rough, -(k + 1))[-(k + 1)] - 1e-9 if len(rough) > k + 1 else -2.0
                    some = np.flatnonzero(rough >= cut)
                    s = cosines(held[0][some], vec[i])
                    best = _top(s, ids[0][some], k + 1)
                    out[0] += [cls[i]] * len(best)
                    out[1] += ids[0][some][best].tolist()
                    out[2] += s[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["q", "cls", "score"])

    def searched(held: DataFrame, visits: DataFrame) -> DataFrame:
        """q, cls, score: the k + 1 best classes of each query in the pieces that it visits."""
        both = held.withColumn("asks", F.lit(0)).select(*cols).union(visits.withColumn("asks", F.lit(1)).select(*cols))
        both = both.repartition(parts, "t", "bucket", "piece").sortWithinPartitions("t", "bucket", "piece", "asks")
        found = both.mapInArrow(score, "q long, cls long, score double").distinct()
        return found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))).where(F.col("r") <= k + 1).drop("r")

    def probed(queries: DataFrame, probes: int) -> DataFrame:
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), dims)
                places = shared.value.places(x) if len(x) else np.zeros((tables, 0, 1))
                for i in range(b.num_rows):
                    keys = [np.unique(bucket_keys(shared.value.probes(places[t, i], probes))) for t in range(tables)]
                    t = np.repeat(np.arange(tables, dtype=np.int32), [len(x) for x in keys])
                    take = pa.array(np.full(len(t), i))
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.concatenate(keys)), b.column(0).take(take), b.column(1).take(take)], ["t", "bucket", "cls", "vec"])

        visits = queries.mapInArrow(visit, kinds).join(sizes, ["t", "bucket"])
        return searched(dealt, visits.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))))

    def by_blocks(queries: DataFrame) -> DataFrame:
        blocks = max(1, -(-n // piece))
        held = classes.select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket"), F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int").alias("piece"), "cls", "vec")
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("piece")
        return searched(held, queries.select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket"), each, "cls", "vec"))

    members = low.groupBy("cls").agg(F.sort_array(F.collect_set("id")).alias("ids"))  # k + 1 at most
    named = lambda best: best.join(members, "cls").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("best"))  # noqa: E731  k + 1 at most
    # with the query's own row among them
    enough = min(k + 1, low.select("id").distinct().count())
    size = F.aggregate("best", F.lit(0), lambda a, b: a + F.size(b["ids"]))
    done, left, blocked = [], queries, probes is None
    while True:
        best = sized(written(named(by_blocks(left) if blocked else probed(left, probes)), "nearest-classes"))
        full = best if blocked else best.where(size >= enough)
        done.append(full)
        if blocked:
            break
        left = written(left.join(full, left.cls == full.q, "left_anti"), "query-classes")
        if left.isEmpty():
            break
        blocked = probes >= MOST_PROBES or probes >= index.reachable()
        probes = min(MOST_PROBES, probes * MORE_PROBES)
    best = reduce(DataFrame.union, done)
    each = asked.join(best, asked.cls == best.q).select("id", F.explode("best").alias("b"))
    each = each.select("id", F.col("b.score").alias("score"), F.explode("b.ids").alias("vec_id")).where("vec_id <> id")
    rank = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return each.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
