"""Toxicity by maximal scoring segments over token log-odds.

1. Counts. A pass over all documents counts the texts that hold each token (word, and its first five
   and four letters) in a fixed number of hash slots: over all texts, and over a bounded sample of
   labelled ones.
2. Log-odds. A slot's rate in a class, relative to its rate in the whole corpus, has a Dirichlet
   prior centred on the rate of the shorter prefix: words never labelled score as their prefix does.
3. Segments. The linear scan for all maximal scoring segments runs over each text.
4. Extreme values. The best segment of clean texts follows a Gumbel law whose location grows with
   the logarithm of the length; a text's segments become p-values, and a logistic curve over them
   gives the score. Both are fitted on the third of the labelled texts that the class counts leave out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.rowwise import add_column
from engramlake.llm.store import written
from engramlake.llm.spans import ALNUM, Block, Words, blocks, mix

SLOTS = 1 << 20
PREFIXES = (4, 5)
STRENGTH = 4.0
DRIFT = 1.0
MAX_LABELLED = 40_000
MIN_SCORE = 2.0
APART = 3


def _tokens(block: Block) -> tuple[Words, list[np.ndarray]]:
    """Slots of each word's first four letters, first five letters, and the word itself."""
    w = block.words(ALNUM)
    n = len(w.data)
    starts = np.concatenate([(w.data & 0xC0) != 0x80, [True]]) if n else np.ones(1, bool)
    letter = np.cumsum(starts)[:-1] - 1  # the letter each byte belongs to
    place = np.flatnonzero(starts)  # where each letter begins; the last is the end
    out = []
    for level, size in enumerate((*PREFIXES, None)):
        if size is None or not len(w.start):
            part = w
        else:
            to = np.minimum(letter[w.start] + size, len(place) - 1)
            part = Words(w.data, w.start, np.minimum(place[to], w.end), w.doc, w.bounds)
        h = mix(part.hashes() + np.uint64(level + 1)) if len(w.start) else np.zeros(0, np.uint64)
        out.append((h % np.uint64(SLOTS)).astype(np.int64))
    return w, out


@dataclass
class Model:
    """Counts per level and slot relative to the corpus, and the calibration."""

    seen: np.ndarray  # level x slot: share of all texts
    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: float
    n_clean: float
    gumbel: tuple[float, float, float] = (1.0, 0.0, 1.0)  # slope on log length, location, scale
    weights: np.ndarray | None = None
    sent: Broadcast | None = None

    def shared(self, spark: SparkSession) -> Callable[[], Model]:
        """What makes the model in a task. The counts are sent once, however often the calibration changes."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast((self.seen, self.toxic, self.clean, self.n_toxic, self.n_clean))
        sent, gumbel, weights = self.sent, self.gumbel, self.weights
        return lambda: Model(*sent.value, gumbel, weights)

    def log_odds(self, slots: list[np.ndarray]) -> np.ndarray:
        a = b = np.ones(len(slots[0]))
        for level, s in enumerate(slots):
            share = self.seen[level, s]
            a = (self.toxic[level, s] + STRENGTH * a) / (self.n_toxic * share + STRENGTH)
            b = (self.clean[level, s] + STRENGTH * b) / (self.n_clean * share + STRENGTH)
        return np.log(a / b)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last excluded, score), left to right, in linear time.

    Runs of scores above zero are merged before the scan, which changes no segment.
    """
    up = scores > 0
    if not up.any():
        return []
    turn = np.flatnonzero(np.diff(up, prepend=False, append=False))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    segments: list[tuple[int, int, float, float]] = []  # first, last, left sum, right sum
    back: list[int] = []  # for each segment, the nearest earlier one with a smaller left sum
    for first, last in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        left, right = float(total[first]), float(total[last])
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= left:
                j = back[j]
            if j < 0 or segments[j][3] >= right:
                segments.append((first, last, left, right))
                back.append(j)
                break
            first, left = segments[j][0], segments[j][2]
            del segments[j:], back[j:]
    return [(a, z, right - left) for a, z, left, right in segments]


def _scan(texts: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Number of words and segments of each text."""
    for block in blocks(texts, lower=True):
        w, slots = _tokens(block)
        scores = model.log_odds(slots) - DRIFT
        for k in range(block.hi - block.lo):
            lo, hi = int(w.bounds[k]), int(w.bounds[k + 1])
            yield hi - lo, maximal_segments(scores[lo:hi])


def _features(n: int, segments: list, gumbel: tuple[float, float, float]) -> list[float]:
    """Extreme-value evidence: surprise of the best segment, summed surprise of all, and their number."""
    slope, location, scale = gumbel
    z = [(s - location - slope * np.log(n + 1.0)) / scale for _, _, s in segments]
    surprise = [_surprise(x) for x in z]
    strong = [x for x in surprise if x > MIN_SCORE]
    return [1.0, np.log1p(max(surprise, default=0.0)), np.log1p(sum(strong)), np.log1p(len(strong))]


def _surprise(z: float) -> float:
    """-log P(the best of a clean text reaches z), for the standard Gumbel law."""
    return float(-np.log(-np.expm1(-np.exp(-z)))) if z < 30 else float(z)


def _counts(docs: DataFrame) -> DataFrame:
    """level, slot, seen, toxic, clean over ``docs`` (text, toxic: 1, 0 or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(PREFIXES) + 1, SLOTS + 1), np.int64)
        for b in batches:
            label = b.column(1).fill_null(-1).to_numpy()
            for block in blocks(b.column(0), lower=True):
                w, slots = _tokens(block)
                own = label[block.lo : block.hi]
                sums[:, 0, SLOTS] += [len(own), (own == 1).sum(), (own == 0).sum()]
                for level, s in enumerate(slots):
                    # a text counts once for each of its tokens
                    pairs = np.unique(w.doc * SLOTS + s)
                    doc, slot = pairs // SLOTS, pairs % SLOTS
                    sums[0, level, :SLOTS] += np.bincount(slot, minlength=SLOTS)
                    for row, value in ((1, 1), (2, 0)):
                        at, n = np.unique(slot[own[doc] == value], return_counts=True)
                        sums[row, level, at] += n
        level, slot = np.nonzero(sums[0])
        for lo in range(0, len(slot), 100_000):
            k, s = level[lo : lo + 100_000], slot[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.astype(np.int32)), pa.array(s.astype(np.int32)), *(pa.array(sums[r, k, s]) for r in range(3))],
                ["level", "slot", "seen", "toxic", "clean"],
            )

    parts = docs.mapInArrow(run, "level int, slot int, seen long, toxic long, clean long")
    return parts.groupBy("level", "slot").agg(*[F.sum(c).alias(c) for c in ("seen", "toxic", "clean")])


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, limit: int = MAX_LABELLED) -> DataFrame:
    """id, toxic of at most about ``limit`` labelled ids, chosen by hash. Ids with two labels are left out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
    one = one.agg(F.min(label_col).alias("toxic"), F.max(label_col).alias("other")).where("toxic = other").select("id", "toxic")
    n = one.count()
    share = min(1.0, limit / max(1, n))
    return one.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else one


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """Counts from all of ``docs``; classes from at most about ``max_labelled`` labelled ids, which bounds the broadcast.

    The driver gets the slot table (``SLOTS`` rows a level at most) and three numbers for each text of the sample.
    Without toxic or without clean labels on either side of the split every score is 0.
    """
    spark = docs.sparkSession
    sample = F.broadcast(labelled_sample(labels, id_col, label_col, max_labelled))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # copies of one text are one example
    once = rows.join(sample, "id").groupBy(F.xxhash64("text").alias("th")).agg(F.min("id").alias("id"))
    sample = F.broadcast(written(sample.join(once, "id").select("id", "toxic").distinct(), "labelled"))
    rows = rows.join(sample, "id", "left").withColumn("apart", F.pmod(F.xxhash64("text"), F.lit(APART)) == 0)
    table = _counts(rows.select("text", F.expr("if(apart, null, cast(toxic as int))").alias("toxic")))
    sums = np.zeros((3, len(PREFIXES) + 1, SLOTS + 1))
    for b in table.toArrow().to_batches():
        k, s = b.column(0).to_numpy(), b.column(1).to_numpy()
        for r in range(3):
            sums[r, k, s] = b.column(2 + r).to_numpy()
    total, n_toxic, n_clean = sums[:, 0, SLOTS]
    model = Model((sums[0] / max(1.0, total)).astype(np.float32), sums[1].astype(np.float32), sums[2].astype(np.float32), n_toxic, n_clean)
    if not model.n_toxic or not model.n_clean:
        return model
    apart = rows.where("apart and toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    calibrate(model, written(apart, "calibration"))
    return model


def calibrate(model: Model, texts: DataFrame) -> None:
    """Fit the Gumbel law on the clean ones of ``texts`` (text, toxic) and then the logistic curve on all.

    Both passes take every segment of a text; the driver gets its length and best segment, then its features.
    """

    def each(row) -> list:
        shared = model.shared(texts.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared()
            for b in batches:
                found = [row(n, s, own) for n, s in _scan(b.column(0), own)]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

        return texts.mapInArrow(run, "toxic int, x array<double>").collect()

    got = each(lambda n, s, _: [np.log(n + 1.0), max((x[2] for x in s), default=0.0)])
    if len({r.toxic for r in got}) < 2:
        return
    x, best = np.array([r.x for r in got if r.toxic == 0]).T
    slope = max(0.0, float(np.cov(x, best)[0, 1] / max(np.var(x), 1e-9))) if len(x) > 1 else 0.0
    rest = best - slope * x
    scale = max(float(rest.std() * np.sqrt(6) / np.pi), 0.25)
    model.gumbel = (slope, float(rest.mean() - 0.5772 * scale), scale)
    got = each(lambda n, s, m: _features(n, s, m.gumbel))
    model.weights = logistic(np.array([r.x for r in got]), np.array([r.toxic for r in got], float))


def logistic(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-regularised logistic curve, by damped Newton steps."""
    ridge = np.diag([1e-3, *[0.1] * (a.shape[1] - 1)])

    def loss(beta: np.ndarray) -> float:
        m = a @ beta
        return float(np.logaddexp(0, m).sum() - y @ m + beta @ ridge @ beta / 2)

    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-8:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


FIELDS = "struct<score:double,segments:array<struct<first:int,last:int,score:double,p_value:double>>>"


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "toxicity", significance: float = 0.01) -> DataFrame:
    """``docs`` with a struct: score (0 to 1) and the significant segments (word numbers, last excluded).

    Null and empty texts have no segments and get the score of such a text. Rows repeated come out
    repeated. Columns of ``docs`` are kept; one called ``name`` is replaced.
    """
    shared = model.shared(docs.sparkSession)

    def values(texts: pa.Array) -> pa.Array:
        m = shared()
        out, segments = [], []
        slope, location, scale = m.gumbel
        for n, found in _scan(texts, m):
            if m.weights is None:
                out.append(0.0)
                segments.append([])
                continue
            out.append(float(1 / (1 + np.exp(-np.clip(np.dot(_features(n, found, m.gumbel), m.weights), -30, 30)))))
            p = [(a, z, s, float(np.exp(-_surprise((s - location - slope * np.log(n + 1.0)) / scale)))) for a, z, s in found]
            segments.append([{"first": a, "last": z, "score": s, "p_value": q} for a, z, s, q in p if q <= significance])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(out, pa.float64()), pa.array(segments, kind)], ["score", "segments"])

    return add_column(docs, text_col, name, FIELDS, lambda: values)
