"""The buckets that queries visit are many rows of few vectors; they are not sent to the driver."""

import numpy as np
from pyspark.sql import functions as F

from engramlake.llm import neighbours


def below(plan: str, node: str) -> list[str]:
    """The subtrees of a printed plan under each ``node``."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if node in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i + 1 : end]))
    return out


def test_visits_are_not_broadcast(spark, monkeypatch):
    plans = []
    kept = neighbours.written

    def seen(df, purpose):
        if purpose == "nearest-classes":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, purpose)

    monkeypatch.setattr(neighbours, "written", seen)
    x = np.random.default_rng(5).normal(size=(600, 8)).round(3)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(rows, F.col("vec_id") % 50 == 0, k=3).collect()
    assert plans and all("MapInArrow" not in tree for p in plans for tree in below(p, "BroadcastExchange"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 600, 50):
        near = [i for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q][:3]
        assert len({r.vec_id for r in got if r.query_id == q} & set(near)) >= 2
