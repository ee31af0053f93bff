"""Connected components of a table of links, by alternating large-star and small-star steps.

Links and components stay distributed. Each round writes its links to the shared folder, so a lost
executor costs a re-read of one small table. The number of rounds grows with the logarithm of the
longest chain of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.store import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with at most one link per node: each node and the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (before == label).all() and (label[a] == label[b]).all():
            break
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for x in batches:
        a = np.concatenate([a, x.column(0).to_numpy()])
        b = np.concatenate([b, x.column(1).to_numpy()])
        if len(a) > 1 << 18:
            a, b = forest(a, b)
            if len(a) > 1 << 17:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
                a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``links``: columns u, v (long). Returns node, root for each node that has a link to another.

    The root is the smallest node of the component. Nulls, loops and repeated links add nothing.
    """
    clean = links.where("u is not null and v is not null and u <> v").select("u", "v")
    now = written(clean.mapInArrow(_forests, "u long, v long"), "links")
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        now = written(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
