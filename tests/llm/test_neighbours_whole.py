"""Every query gets its neighbours, whatever else the table holds."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from engramlake.llm import neighbours


def test_a_longer_vector_and_isolated_queries(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=8) + 0.01 * rng.normal(size=(5000, 8)), rng.normal(size=(3, 8)), -10 + 0 * np.zeros((1, 8))])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    # longer ones, one of them usable: neither takes part
    rows += [(9000, [0.0] * 20), (9001, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    asks = [0, 5000, 5001, 5002, 5003]
    for r in sorted(neighbours.nearest(df, F.col("vec_id").isin(asks + [9000, 9001]), recall=0.5).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert {q: len(v) for q, v in got.items()} == {q: 5 for q in asks}


def test_a_probe_limit_short_of_the_recall(spark, monkeypatch):
    rng = np.random.default_rng(0)
    index = neighbours.Index.of(8, 1_000_000, 0.8, 1, 1, 1.5)
    known = [(q, list(q + 0.5 * rng.normal(size=(5, 8)))) for q in rng.normal(size=(40, 8))]
    assert neighbours._probes_needed(index, known, 0.1)
    monkeypatch.setattr(neighbours, "MOST_PROBES", 2)
    assert neighbours._probes_needed(index, known, 0.98) is None
    # such an index answers every query exactly
    x = rng.normal(size=(3000, 6))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 4)
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 100 == 0, piece=700).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    for q in range(0, 3000, 100):
        s = neighbours.cosines(x, x[q])
        s[q] = -2
        assert got[q] == np.argsort(-s, kind="stable")[:5].tolist()


def test_large_and_small_components(spark):
    x = np.random.default_rng(3).normal(size=(40, 4))
    scale = np.array([1e200, 1.0, 1e-200, 1e307])[np.arange(40) % 4]
    df = spark.createDataFrame(list(enumerate((x * scale[:, None]).tolist())), "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.lit(True)).collect()
    assert len(got) == 200
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    assert all(abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12 for r in got)
