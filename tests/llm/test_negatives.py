"""Hard negatives beside brute force in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramlake.llm import negatives


def brute(rows, asks, positives=5, k=10):
    ok = {}
    for i, label, v in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1])):
        if len(v) == 3 and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, (label, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]))
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for a, (label, q) in ok.items():
        if not asks(a):
            continue
        scored = sorted((-clip(sum(x * y for x, y in zip(q, p, strict=True))), i, lab) for i, (lab, p) in ok.items() if i != a)
        for ps, p, _ in [r for r in scored if r[2] == label][:positives]:
            window = [r for r in scored if r[2] != label and -30 * ps <= -100 * r[0] <= -90 * ps]
            out += [(a, p, n, i, -ps, -s) for n, (s, i, _) in enumerate(window[:k], 1)]
    return sorted(out)


def mined(df, every=4, **kw):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect())


SCHEMA = "vec_id long, label int, embedding array<double>, rank int, score double"


@pytest.mark.parametrize("block_bytes", [1 << 24, 3 * 8 * 7])
def test_beside_brute_force(spark, block_bytes):
    r = random.Random(3)
    rows = [(i, r.randint(0, 2), [r.uniform(-1, 2) for _ in range(3)]) for i in range(160)]
    rows += [(i, i % 3, [1.0, 0.5, 0.25]) for i in range(160, 200)]  # copies and ties
    rows += [(200, 9, [1.0, 1.0, 1.0])]  # the only one of its label
    rows += [(204, None, [1.0] * 3), (208, 1, None), (212, 1, [None, 1.0, 1.0]), (216, 1, [float("nan"), 1.0, 1.0]), (220, 1, [float("inf"), 1.0, 1.0]), (224, 1, [1.0]), (228, 1, [])]
    rows += [(None, 1, [1.0] * 3), (232, 0, [0.0, 0.0, 0.0]), (236, 2, [-5.0, -5.0, -5.0])]
    df = spark.createDataFrame([(*x, 0, 0.5) for x in [*rows, rows[3], rows[3]]], SCHEMA)
    want = brute(rows, lambda i: i % 4 == 0)
    assert len(want) > 500 and mined(df, block_bytes=block_bytes) == want
    assert mined(df.limit(0)) == []


def test_repeated_ids_and_wide_numbers(spark):
    rows = [(i, i % 2, [float(i), 2.0**40 * i, 1.0]) for i in range(12)] + [(12, 0, [1e18, 1e18, 1.0]), (13, 1, [1e18, 3e17, -1.0]), (16, 1, [1e305, 1.0, 1.0]), (17, 0, [-1e305, 5.0, 1.0])]
    twice = [(4, 0, [9.0, 9.0, 9.0]), (4, 1, [1.0, 1.0, 1.0])]  # the smallest label, then vector, of an id counts
    df = spark.createDataFrame([(*x, 0, 0.5) for x in [*rows, *twice]], SCHEMA)
    kept = [x for x in rows if x[0] != 4] + [min(x for x in [*rows, *twice] if x[0] == 4)]
    assert mined(df) == brute(kept, lambda i: i % 4 == 0)


def test_tops_by_score_then_place():
    s = np.array([3, 9, 9, -1, 9, 3])
    assert negatives.best(s, 2).tolist() == [1, 2] and negatives.best(s, 9).tolist() == [1, 2, 4, 0, 5, 3] and negatives.best(s[:0], 2).tolist() == []
    assert negatives.best(np.array([0, negatives.LONG[0], negatives.LONG[1]]), 3).tolist() == [2, 0, 1]
