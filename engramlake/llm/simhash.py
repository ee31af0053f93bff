"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked exactly within a Hamming distance.

Fingerprints are made beside the scan. Distinct fingerprints are dealt to shards by a vantage-point
tree (``vptree``), linked inside the shards, and joined into components (``links``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm import vptree
from engramlake.llm.links import components, forest
from engramlake.llm.store import written

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes(range(65, 91))
DOWN = bytes.maketrans(UPPER, UPPER.lower())
SLICE = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """Lower-case A-Z, hash each run of ``size`` words (XXH64, seed 42), keep the bits set in over half.

    Fewer words make one shingle; no words, like null, give 0.
    """
    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(DOWN))
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, SLICE):
        part = words[lo : min(n, lo + SLICE) + size - 1]
        if len(words) < size:
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, marks: bool = False) -> DataFrame:
    """id, fp (the fingerprint as a signed long), with ``marks`` also mark (a hash of the text); a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), np.uint64, b.num_rows)
            more = b.columns[2:]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *more], ["id", "fp", "mark"][: 2 + len(more)])

    mark = [F.xxhash64(text_col).alias("mark")] if marks else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *mark)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long" + (", mark long" if marks else ""))


def near_fingerprints(
    distinct: DataFrame, reach: int = 3, sample: int = 65_536, leaf_points: int = 100_000
) -> DataFrame:
    """u, v: links that join distinct fingerprints (column fp) at ``reach`` or fewer differing bits.

    Pairs in reach are joined directly or by a chain, so components are exact, and a cluster of m
    fingerprints gives about m links. The tree is built on the driver from about ``sample``
    fingerprints (those of low hash); ``leaf_points`` is the size a shard aims at. A shard that
    turns out larger (a cluster that no vantage point cuts) is dealt in a triangle of block pairs.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    chosen = distinct.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(min(1.0, sample / max(1, total)) * (1 << 40)))
    points = np.fromiter((r.fp for r in chosen.collect()), np.int64).view(np.uint64)
    tree = vptree.build(points, total, leaf_points, reach)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            at, leaf = tree.deal(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(fp[at])], ["leaf", "fp"])

    dealt = distinct.select("fp").mapInArrow(deal, "leaf int, fp long")
    # one row per leaf, and the tree has at most sample / 8 leaves
    sizes = {r.leaf: r.n for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    cuts = {leaf: -(-n // (2 * leaf_points)) for leaf, n in sizes.items() if n > 2 * leaf_points}
    cut = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]), F.col("leaf")), F.lit(1)) if cuts else F.lit(1)
    own = F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")
    tasks = dealt.withColumn("cut", cut.cast("int")).withColumn("own", own)
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    shard = F.struct("leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    tasks = tasks.select(shard.alias("shard"), "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by shard: one shard at a time
        key, parts = None, []

        def done() -> pa.RecordBatch:
            fp = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            a, b = vptree.near_links(fp.view(np.uint64), reach)
            a, b = forest(fp[a], fp[b])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

        for batch in batches:
            shard = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            fp = batch.column(3).to_numpy()
            edges = np.flatnonzero((shard[1:] != shard[:-1]).any(axis=1)) + 1 if len(shard) else []
            for lo, hi in zip([0, *edges], [*edges, len(fp)], strict=True):
                if lo == hi:
                    continue
                if key != (now := tuple(shard[lo])):
                    if parts:
                        yield done()
                    key, parts = now, []
                parts.append(fp[lo:hi])
        yield done()

    n_tasks = max(1, min(10_000, sum(-(-n // leaf_points) for n in sizes.values()), spark.sparkContext.defaultParallelism * 64))
    rows = tasks.repartition(n_tasks, "shard").sortWithinPartitions("shard")
    return rows.select("shard.leaf", "shard.a", "shard.b", "fp").mapInArrow(join, "u long, v long")


def _rooted(prints: DataFrame, reach: int, sample: int, leaf_points: int) -> DataFrame:
    """fp, least, root: each fingerprint with the smallest id that has it and the root of its component."""
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    distinct = written(distinct, "distinct")
    roots = components(near_fingerprints(distinct, reach, sample, leaf_points))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left")
    return written(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 3, reach: int = 3,
    sample: int = 65_536, leaf_points: int = 100_000,
) -> DataFrame:
    """id, fp, component: each row's fingerprint and the smallest id of its component.

    Rows whose fingerprints differ in ``reach`` or fewer bits are linked. Null and empty texts have
    fingerprint 0 and link like any other. Rows with a null id take part as links; they get the
    component of their fingerprint, which is null where no row of it has an id. Repeated rows each
    come out. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    rooted = _rooted(prints, reach, sample, leaf_points)
    groups = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(groups, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 3, reach: int = 3,
    sample: int = 65_536, leaf_points: int = 100_000,
) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component stays: the one with the smallest id.

    All columns are kept. Of a component's rows that share its smallest id, the one whose text hashes
    lowest stays; an id that repeats in several components can stay once in each. Rows without an id
    cannot be told apart by the result and stay.
    """
    prints = written(fingerprints(docs, id_col, text_col, size, marks=True), "fingerprints")
    rooted = _rooted(prints, reach, sample, leaf_points)
    # what is smallest for a fingerprint comes first: only one row of each is joined to its component
    least = prints.where("id is not null").groupBy("fp").agg(F.min(F.struct("id", "mark")).alias("row"))
    stay = least.join(rooted, "fp").groupBy("root").agg(F.min("row").alias("row"))
    stay = stay.select(F.col("row.id").alias(id_col), F.col("row.mark").alias("__mark"))
    kept = docs.where(F.col(id_col).isNotNull()).withColumn("__mark", F.xxhash64(text_col)).join(stay, [id_col, "__mark"], "left_semi")
    # rows alike in id and text are of one component; the join has dealt and sorted them, this window adds no exchange
    first = Window.partitionBy(id_col, "__mark").orderBy("__mark")
    kept = kept.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
