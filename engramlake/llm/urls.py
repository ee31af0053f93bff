"""URL filter: host and path rules, and a character language-model ratio for URLs no rule covers.

Two smoothed variable-order Markov models over bytes, of accepted and of rejected URLs, are counted
from every URL that a rule decides. A gram is a byte with up to five before it, packed exactly into
a long; the counts are tables keyed by gram, which grow with the corpus and stay distributed. A
prediction blends all orders, each with the shorter one as its prior, and is made once for each
distinct gram. Predictions of the commonest grams are broadcast, the others joined. The difference
of the log-likelihoods over the length of the URL is compared with a threshold calibrated on URLs
that a first model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.spans import Block, blocks
from engramlake.llm.store import written

ORDER = 5
COMMON = 1_000_000  # grams whose predictions are broadcast
FIXED = 1 << 32  # predictions are summed as whole numbers, in any order alike
STRENGTH = 2.0
FOLDS = 5
BINS = 1000  # per unit of the difference

#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first `://`; empty for null and for URLs without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _DOWN)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its text and its gram: bits 48 and up the length, below them the bytes."""
    data = block.data.astype(np.int64)
    doc = np.repeat(np.arange(block.hi - block.lo), np.diff(block.offsets))
    length = np.minimum(np.arange(len(data)) - block.offsets[doc], ORDER) + 1
    gram = length << 48
    for k in range(min(ORDER + 1, len(data))):
        gram[k:] += np.where(length[k:] > k, data[: len(data) - k] << (8 * k), 0)
    return doc, gram


def _length(gram: str = "gram") -> Column:
    return F.shiftright(F.col(gram), 48).cast("int")


def _suffix(gram: str, length: Column | int) -> Column:
    """The last ``length`` bytes of a gram, as a gram."""
    n = F.lit(length) if isinstance(length, int) else length
    mask = F.lit((1 << 8 * (ORDER + 1)) - 1)
    for k in range(1, ORDER + 1):
        mask = F.when(n == k, F.lit((1 << 8 * k) - 1)).otherwise(mask)
    return F.col(gram).bitwiseAND(mask) + n.cast("long") * F.lit(1 << 48)


def _context(gram: str = "gram") -> Column:
    """What stands before the last byte of a gram, as a gram; it may be empty."""
    return F.shiftright(F.col(gram).bitwiseAND(F.lit((1 << 48) - 1)), 8) + (_length(gram).cast("long") - 1) * F.lit(1 << 48)


COUNTS = ["n0", "n1", "m0", "m1"]  # of rejected and accepted URLs: all, and those not kept apart


def _counts(rests: DataFrame) -> DataFrame:
    """gram, and its ``COUNTS`` over ``rests`` (rest, kind: 1 accepted, 0 rejected, part: 1 kept apart, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, part, n = (b.column(i).to_numpy() for i in (1, 2, 3))
            for block in blocks(b.column(0), lower=True):
                doc, gram = _grams(block)
                doc = doc + block.lo
                keys, at = np.unique(gram, return_inverse=True)
                sums = []
                for own in (kind == 0, kind == 1, (kind == 0) & (part == 0), (kind == 1) & (part == 0)):
                    sums.append(pa.array(np.bincount(at, (n * own)[doc], minlength=len(keys)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *sums], ["gram", *COUNTS])

    full = rests.select("rest", "kind", "part", "n").mapInArrow(run, "gram long, " + ", ".join(f"{c} long" for c in COUNTS))
    full = full.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])
    # a gram of n bytes counts for each of its n ends
    each = full.withColumn("k", F.explode(F.sequence(F.lit(1), _length()))).withColumn("gram", _suffix("gram", F.col("k")))
    return written(each.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS]), "gram-counts")


def _predictions(wanted: DataFrame, counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """gram, ratio: log P(accepted) - log P(rejected) of the last byte of each ``wanted`` gram, times ``FIXED``.

    ``names`` are the columns of ``counts`` for rejected and accepted URLs.
    """
    have = counts.select("gram", *[F.col(c).alias(f"p{k}") for k, c in enumerate(names)])
    around = have.groupBy(_context().alias("context")).agg(F.sum("p0").alias("c0"), F.sum("p1").alias("c1"))
    ends = wanted.select(F.explode(F.transform(F.sequence(F.lit(1), _length()), lambda k: _suffix("gram", k))).alias("gram")).distinct()
    facts = ends.join(have, "gram", "left").withColumn("context", _context()).join(around, "context", "left").drop("context")
    facts = written(facts.na.fill(0).withColumn("k", _length()), "gram-facts")
    out = shorter = None
    for k in range(1, ORDER + 2):
        level = facts.where(F.col("k") == k)
        if shorter is None:
            level = level.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            level = level.withColumn("end", _suffix("gram", k - 1)).join(shorter.select(F.col("gram").alias("end"), "q0", "q1"), "end")
        blend = lambda i: (F.col(f"p{i}") + STRENGTH * F.col(f"q{i}")) / (F.col(f"c{i}") + STRENGTH)
        shorter = written(level.select("gram", blend(0).alias("q0"), blend(1).alias("q1")), "gram-level")
        out = shorter if out is None else out.union(shorter)
    ratio = F.round((F.log("q1") - F.log("q0")) * FIXED).cast("long").alias("ratio")
    return written(out.join(wanted, "gram").select("gram", ratio, "n"), "gram-ratios")


def _differences(rests: DataFrame, counts: DataFrame, names: Sequence[str], common: int = COMMON) -> DataFrame:
    """rest, difference of each of the distinct texts ``rests`` (a table); 0 for empty ones."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(0), lower=True):
                keys, n = np.unique(_grams(block)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["gram", "n"])

    wanted = written(rests.select("rest").mapInArrow(seen, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    ratios = _predictions(wanted, counts, names)
    # the commonest, down to a power of two that leaves at most ``common``
    least = total = 0
    for r in ratios.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().orderBy(F.desc("b")).collect():
        total += r["count"]
        if total > common:
            least = 1 << (r.b + 1)
            break
    some = ratios.where(F.col("n") >= least).select("gram", "ratio").toArrow()
    keys, values = (np.asarray(some.column(i).to_numpy(), np.int64) for i in (0, 1))
    order = np.argsort(keys)
    shared = rests.sparkSession.sparkContext.broadcast((np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for b in batches:
            u = b.column(1).to_numpy()
            for block in blocks(b.column(0), lower=True):
                doc, gram = _grams(block)
                at = np.searchsorted(keys, gram)
                known = keys[at] == gram
                sums = np.zeros(block.hi - block.lo, np.int64)
                np.add.at(sums, doc[known], values[at[known]])
                own, rare = u[block.lo : block.hi], np.flatnonzero(~known)
                # a row of each text with what is known, under a key that no gram has, and one for each rare gram
                texts = b.column(0).slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(-1 - own), texts, pa.array(sums), pa.array(np.diff(block.offsets))], ["u", "gram", "rest", "sum", "bytes"]
                )
                none = pa.nulls(len(rare), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(own[doc[rare]]), pa.array(gram[rare]), pa.nulls(len(rare), pa.string()), none, none], ["u", "gram", "rest", "sum", "bytes"])

    rows = rests.select("rest", F.monotonically_increasing_id().alias("u")).mapInArrow(run, "u long, gram long, rest string, sum long, bytes long")
    if least:
        rows = rows.join(ratios.where(F.col("n") < least).select("gram", "ratio"), "gram", "left").withColumn("sum", F.coalesce("sum", "ratio"))
    sums = rows.groupBy("u").agg(F.max("rest").alias("rest"), F.sum("sum").alias("sum"), F.max("bytes").alias("bytes"))
    return sums.select("rest", (F.col("sum") / F.lit(float(FIXED)) / F.greatest("bytes", F.lit(1))).alias("difference"))


@dataclass
class Model:
    """The table of counts by gram, and the threshold."""

    counts: DataFrame
    threshold: float = 0.0

    def differences(self, rests: DataFrame, common: int = COMMON) -> DataFrame:
        """rest, difference: log P(accepted) - log P(rejected) over the bytes of each of the distinct texts ``rests`` (a table)."""
        return _differences(rests, self.counts, COUNTS[:2], common)

    def difference(self, texts: pa.Array, common: int = COMMON) -> np.ndarray:
        """The differences of a few texts, in their order; 0 for empty ones."""
        spark, given = self.counts.sparkSession, [t or "" for t in texts.to_pylist()]
        rests = written(spark.createDataFrame([(t,) for t in sorted(set(given))], "rest string"), "rests")
        found = {r.rest: r.difference for r in self.differences(rests, common).collect()}
        return np.array([found[t] for t in given])


def fit(rows: DataFrame) -> Model:
    """A model from ``rows`` (rest, kind). All rows count; a fifth of them, by hash, sets the threshold.

    The driver gets the commonest grams and a histogram of differences. Without accepted or without
    rejected URLs the threshold is 0 and the missing class is uniform.
    """
    part = (F.pmod(F.xxhash64("rest"), F.lit(FOLDS)) == 0).cast("int")
    rests = written(rows.groupBy("rest", "kind").agg(F.count("*").alias("n")).withColumn("part", part), "known-rests")
    counts = _counts(rests)
    apart = rests.where("part = 1").select("rest", "kind", "n")
    first = _differences(written(apart.select("rest").distinct(), "rests-apart"), counts, COUNTS[2:])
    apart = apart.join(first, "rest")
    bins = apart.groupBy("kind", F.floor(F.col("difference") * BINS).alias("bin")).agg(F.sum("n").alias("n")).collect()
    return Model(counts, _threshold([(r.kind, r.bin, r.n) for r in bins]))


def _threshold(bins: list[tuple[int, int, int]]) -> float:
    """The cut with the least sum of both error rates; the middle of equals."""
    n = [sum(c for k, _, c in bins if k == kind) for kind in (0, 1)]
    if not n[0] or not n[1]:
        return 0.0
    edges = sorted({b for _, b, _ in bins} | {b + 1 for _, b, _ in bins})
    wrong = [sum(c / n[k] for k, b, c in bins if (b >= e) != (k == 1)) for e in edges]
    best = [e for e, w in zip(edges, wrong, strict=True) if w <= min(wrong) + 1e-12]
    return (best[0] + best[-1]) / 2 / BINS


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, difference: for every row its rule's verdict, or the models'.

    Null URLs and URLs without `://` have empty host, path and difference 0. Rows repeated come out
    repeated, null ids come out as null.
    """
    rows = pages.select(F.col(id_col).alias("id"), rest_of(F.col(url_col).cast("string")).alias("rest"))
    rows = rows.withColumns({"host": host_of(F.col("rest")), "path": path_of(F.col("rest"))})
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    known = rows.where("verdict is not null").select("rest", (F.col("verdict") == "allow").cast("int").alias("kind"))
    model = fit(known)
    scored = model.differences(written(rows.where("rest <> ''").select("rest").distinct(), "rests"))
    found = rows.withColumn("rest", F.when(F.col("rest") != "", F.col("rest"))).join(scored, "rest", "left").na.fill(0.0, ["difference"])
    mine = F.when(F.col("difference") >= F.lit(model.threshold), "allow").otherwise("block")
    return found.select("id", "host", "path", "rule", F.coalesce("verdict", mine).alias("verdict"), "difference")


def keep_allowed(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` that are allowed, with all their columns."""
    rest = rest_of(F.col(url_col).cast("string"))
    verdict = matched(host_of(rest), path_of(rest), rules)[1]
    known = pages.select(rest.alias("rest"), verdict.alias("v"))
    model = fit(known.where("v is not null").select("rest", (F.col("v") == "allow").cast("int").alias("kind")))
    scored = model.differences(written(known.where("v is null and rest <> ''").select("rest").distinct(), "rests"))
    scored = scored.select(F.col("rest").alias("__rest"), F.col("difference").alias("__difference"))
    found = pages.withColumn("__rest", F.when(rest != "", rest)).join(scored, "__rest", "left").na.fill(0.0, ["__difference"])
    allowed = F.coalesce(verdict == "allow", F.col("__difference") >= F.lit(model.threshold))
    return found.where(allowed).select(*pages.columns)
