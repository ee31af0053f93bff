"""The skew-safe helpers against plain Python, with pieces small enough to cross their borders."""

import random

import pytest
from pyspark.sql import functions as F

from engramlake.functions import scale as S


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for seq in range(600):
        key = "hot" if seq % 3 else rng.choice("abc")  # two thirds of the rows in one key
        out.append((key, seq * rng.choice([1, 1]) + 0, rng.choice([0.0, 1.5, 1.5, 2.0, rng.random() * 10]), rng.choice("xyz")))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, seq bigint, v double, tag string").repartition(5)


def by_key(rows):
    d = {}
    for r in sorted(rows, key=lambda r: r[1]):
        d.setdefault(r[0], []).append(r)
    return d


@pytest.mark.parametrize("chunk", [1, 7, 100, 10_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(df, rows, chunk, inclusive):
    got = {(r.k, r.seq): r.s for r in S.running_sum(df, ["k"], "seq", {"s": F.lit(1)}, inclusive=inclusive, chunk_rows=chunk).collect()}
    want = {(k, r[1]): i + (1 if inclusive else 0) for k, rs in by_key(rows).items() for i, r in enumerate(rs)}
    assert got == want


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_lagged(df, rows, chunk):
    got = {(r.k, r.seq): r.p for r in S.lagged(df, ["k"], "seq", {"p": "tag"}, chunk_rows=chunk).collect()}
    want = {(k, r[1]): (rs[i - 1][3] if i else None) for k, rs in by_key(rows).items() for i, r in enumerate(rs)}
    assert got == want


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_last_known(df, rows, chunk):
    value = F.when(F.col("tag") == "x", F.col("v"))
    got = {(r.k, r.seq): r.c for r in S.last_known(df, ["k"], "seq", {"c": value}, chunk_rows=chunk).collect()}
    want = {}
    for k, rs in by_key(rows).items():
        seen = None
        for r in rs:
            seen = r[2] if r[3] == "x" else seen
            want[(k, r[1])] = seen
    assert got == want


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_islands(df, rows, chunk):
    got = {(r.k, r.seq): r.island for r in S.islands(df, ["k"], "seq", "tag", chunk_rows=chunk).collect()}
    want = {}
    for k, rs in by_key(rows).items():
        n, prev = 0, None
        for r in rs:
            n += r[3] != prev
            prev = r[3]
            want[(k, r[1])] = n
    assert got == want


@pytest.mark.parametrize("buckets", [None, 1, 2, 8, 128])
def test_order_statistics(df, rows, buckets):
    n = F.col("n")
    out = S.order_statistics(df, ["k"], "v", {"mid": F.floor(n / 2) + 1, "third": F.floor(n / 3) + 1, "last": n}, buckets=buckets)
    for r in out.collect():
        vals = sorted(x[2] for x in rows if x[0] == r.k)
        assert (r.n, r.mid, r.third, r.last) == (len(vals), vals[len(vals) // 2], vals[len(vals) // 3], vals[-1])


@pytest.mark.parametrize("buckets", [None, 1, 4, 128])
def test_distributed_rank(df, rows, buckets):
    got = {(r.k, r.seq): r["rank"] for r in S.distributed_rank(df, ["k"], "v", "seq", buckets=buckets).collect()}
    want = {}
    for k, rs in by_key(rows).items():
        for i, r in enumerate(sorted(rs, key=lambda r: (-r[2], r[1]))):
            want[(k, r[1])] = i + 1
    assert got == want


def test_one_key_with_all_rows_is_many_ranges(spark):
    d = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 4000).cast("double").alias("v"), F.col("id").alias("seq"))
    sizes = [r["count"] for r in S.ranges(d, ["k", "v"], 20).groupBy("__range").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 600
    n = F.col("n")
    got = S.order_statistics(d, ["k"], "v", {"low": F.floor(n / 5) + 1, "past": n + 1, "none": F.lit(None).cast("long")}, buckets=20).first()
    assert (got.n, got.low, got.past, got.none) == (4000, 800.0, None, None)
    same = d.withColumn("v", F.lit(1.0))  # one score for all: cut by the tie
    ranked = S.distributed_rank(same, ["k"], "v", "seq", buckets=20)
    assert ranked.where(F.col("rank") != F.col("seq") + 1).count() == 0
    assert S.order_statistics(d.where("false"), ["k"], "v", {"low": n}).count() == 0


def test_null_scores_rank_last(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 7.0), ("a", 4, None)], "k string, seq bigint, v double")
    assert {r.seq: r["rank"] for r in S.distributed_rank(d, ["k"], "v", "seq", buckets=3).collect()} == {3: 1, 2: 2, 1: 3, 4: 4}


def test_hashed_rank_is_a_permutation(df, rows):
    got = S.hashed_rank(df, ["k"], "seq").collect()
    for k, rs in by_key(rows).items():
        assert sorted(r["rank"] for r in got if r.k == k) == list(range(1, len(rs) + 1))
    again = {(r.k, r.seq): r["rank"] for r in S.hashed_rank(df.repartition(3), ["k"], "seq").collect()}
    assert again == {(r.k, r.seq): r["rank"] for r in got}


def test_top_k_limits_before_the_shuffle(df):
    plan = S.top_k(df, ["k"], [F.col("v").desc(), F.col("seq")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_a_rank_moves_its_rows_once(spark):
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(50)], "k string, seq int, v double")
    for ranked in (S.distributed_rank(df, ["k"], "v", "seq", buckets=4), S.hashed_rank(df, ["k"], "seq", buckets=4)):
        assert "row_number" not in ranked._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 51))
