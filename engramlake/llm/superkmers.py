"""Substring dedup with super-k-mers.

A window is ``window`` consecutive words, and its minimiser the run of ``gram`` words in it that
hashes lowest (the leftmost of equals). Consecutive windows with the same minimiser travel as one
packed string, a super-k-mer, to the bucket of the minimiser; no two windows of one super-k-mer are
equal. Equal windows have equal minimisers, so sorting a bucket counts its windows exactly.

Super-k-mers whose minimiser occurs once in the corpus hold no repeated window. They are found with
the minimisers alone, before any text moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.spans import NOT_SPACE, Block, Words, blocks, grams
from engramlake.llm.store import written

WINDOW = 35
GRAM = 10
BUCKET_STRINGS = 10_000


def super_kmers(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window (its first word), number of windows, and minimiser hash of each super-k-mer of a block."""
    none = np.zeros(0, np.int64)
    n = len(words.start) - window + 1
    if n <= 0:
        return none, none, np.zeros(0, np.uint64)
    g = grams(words.hashes(), gram)
    low, span, width = np.arange(len(g)), window - gram + 1, 1
    while width < span:
        step = min(width, span - width)
        a, b = low[:-step], low[step:]
        low = np.where(g[b] < g[a], b, a)
        width += step
    ends = np.repeat(words.bounds[1:], np.diff(words.bounds))
    valid = np.arange(n) + window <= ends[:n]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:n] != low[: n - 1])
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.concatenate([valid, [False]])[:-1] & np.concatenate([~valid[1:] | new[1:], [True]])) + 1
    return first, stop - first, g[low[first]]


def _spaced(block: Block, words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The block with one space between words, and the words' places in it."""
    w = NOT_SPACE[block.data]
    keep = w.copy()
    keep[1:] |= w[:-1]
    at = np.cumsum(keep)
    data = np.where(w, block.data, np.uint8(32))[keep].tobytes()
    return data, at[words.start] - 1, at[words.end - 1]


def _positions(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """id, th, minimiser, start: a row for each super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(2)):
                w = block.words(NOT_SPACE)
                first, _, key = super_kmers(w, window, gram)
                row = w.doc[first]
                take = pa.array(block.lo + row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(key.view(np.int64)), pa.array((first - w.bounds[row]).astype(np.int32))],
                    ["id", "th", "minimiser", "start"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, th long, minimiser long, start int")


def _strings(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """id, th, start, minimiser, packed: the super-k-mers of each text whose start is in ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(2)):
                w = block.words(NOT_SPACE)
                first, n, key = super_kmers(w, window, gram)
                row = w.doc[first]
                start = first - w.bounds[row]
                wanted = b.column(3).slice(block.lo, block.hi - block.lo)
                owner = np.repeat(np.arange(len(wanted)), np.diff(np.asarray(wanted.offsets)))
                wide = np.int64(len(w.start) + 1)
                keep = np.isin(row * wide + start, owner * wide + wanted.flatten().to_numpy())
                data, begin, end = _spaced(block, w)
                a, z = begin[first[keep]].tolist(), end[(first + n + window - 2)[keep]].tolist()
                take = pa.array(block.lo + row[keep])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(take), b.column(1).take(take), pa.array(start[keep].astype(np.int32)),
                        pa.array(key[keep].view(np.int64)), pa.array([data[x:y] for x, y in zip(a, z, strict=True)], pa.binary()),
                    ],
                    ["id", "th", "start", "minimiser", "packed"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, th long, start int, minimiser long, packed binary")


def windows_of(packed: bytes, window: int) -> list[bytes]:
    gaps = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    begin = [0, *(gaps + 1).tolist()]
    end = [*gaps.tolist(), len(packed)]
    return [packed[a:z] for a, z in zip(begin, end[window - 1 :], strict=False)]


def _ranges(flags: list[bool]) -> list[tuple[int, int]]:
    turn = np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]]))
    return list(zip(np.flatnonzero(turn == 1).tolist(), (np.flatnonzero(turn == -1) - 1).tolist(), strict=True))


def _counted(rows: DataFrame, window: int) -> DataFrame:
    """h, first, last: the runs of repeated windows in each distinct string. ``rows`` (minimiser, h, packed, n) are
    dealt and sorted by minimiser, and no minimiser has more than ``BUCKET_STRINGS`` rows."""

    def done(bucket: list[tuple[bytes, bytes, int]], out: list[list]) -> None:
        if len(bucket) == 1 and bucket[0][2] < 2:
            return
        cut = [windows_of(packed, window) for _, packed, _ in bucket]
        # sort the bucket's windows; equal ones stand together
        order = sorted((w, k) for k, part in enumerate(cut) for w in part)
        repeated, i = set(), 0
        while i < len(order):
            j, total = i, 0
            while j < len(order) and order[j][0] == order[i][0]:
                total += bucket[order[j][1]][2]
                j += 1
            if total > 1:
                repeated.add(order[i][0])
            i = j
        for (h, _, _), part in zip(bucket, cut, strict=True):
            for a, z in _ranges([w in repeated for w in part]):
                out[0].append(h)
                out[1].append(a)
                out[2].append(z)

    def batch(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["h", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket, out = None, [], [[], [], []]
        for b in batches:
            for m, *row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if m != key:
                    done(bucket, out) if bucket else None
                    key, bucket = m, []
                bucket.append(tuple(row))
            if len(out[0]) > 10_000:
                yield batch(out)
                out = [[], [], []]
        done(bucket, out) if bucket else None
        yield batch(out)

    return rows.select("minimiser", "h", "packed", "n").mapInArrow(run, "h binary, first int, last int")


def _exploded(rows: DataFrame, window: int) -> DataFrame:
    """The same for buckets with more strings: every window goes by its own words, counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, packed, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                cut = windows_of(packed, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * len(cut)), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary()), pa.array([n] * len(cut), pa.int64())],
                    ["h", "at", "win", "n"],
                )

    each = rows.select("h", "packed", "n").mapInArrow(run, "h binary, at int, win binary, n long")
    many = each.groupBy("win").agg(F.sum("n").alias("total")).where("total > 1").select("win")
    return each.join(many, "win").select("h", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """id, th, ranges: for each text (``docs``: id, th, text) with repeated windows, the word ranges they cover."""
    rows = written(_positions(docs, window, gram), "minimisers")
    twice = rows.groupBy("minimiser").agg(F.count("*").alias("c")).where("c > 1").select("minimiser")
    # a join of two tables that ends in a table can be dealt anew where one minimiser is very common
    twice = written(twice, "minimisers-met-again")
    twice = written(rows.join(twice, "minimiser", "left_semi").select("id", "th", "start"), "repeated")
    starts = written(twice.groupBy("id", "th").agg(F.collect_set("start").alias("starts")), "starts")
    starts = starts.withColumnsRenamed({"id": "id2", "th": "th2"})
    texts = docs.join(starts, docs.id.eqNullSafe(starts.id2) & docs.th.eqNullSafe(starts.th2)).select("id", "th", "text", "starts")
    strings = written(_strings(texts, window, gram).withColumn("h", F.unhex(F.md5("packed"))), "super-k-mers")
    distinct = strings.groupBy("packed").agg(F.count("*").alias("n"), F.first("minimiser").alias("minimiser"), F.first("h").alias("h"))
    distinct = written(distinct, "distinct-super-k-mers")
    heavy = distinct.groupBy("minimiser").agg(F.count("*").alias("c")).where(F.col("c") > bucket_strings).select("minimiser")
    # most buckets are small; a heavy one is cut into its windows
    light = distinct.join(heavy, "minimiser", "left_anti")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    light = light.repartition(parts, "minimiser").sortWithinPartitions("minimiser")
    found = _counted(light, window).union(_exploded(distinct.join(heavy, "minimiser", "left_semi"), window))
    found = written(found, "found")
    hit = written(strings.select("id", "th", "start", "h").join(found, "h").drop("h"), "hit")
    spans = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last") + window).alias("last"))
    return written(hit.groupBy("id", "th").agg(F.collect_set(spans).alias("ranges")), "ranges")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM,
    bucket_strings: int = BUCKET_STRINGS, texts: bool = True,
) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and, with ``texts``, kept: the text without words of repeated windows.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if a window that covers it also begins anywhere else,
    in the same text or another, judged on the input. Kept words are joined by one space. Null and
    empty texts have no words (kept: empty). Each row counts as a text of its own: of rows repeated
    in full all copies lose their windows. Null ids come out as null.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = repeated_ranges(rows.select("id", "th", "text"), window, gram, bucket_strings)
    ranges = ranges.withColumnsRenamed({"id": "id2", "th": "th2"})
    both = rows.join(ranges, rows.id.eqNullSafe(ranges.id2) & rows.th.eqNullSafe(ranges.th2), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha, kept = [], [], [], []
            flat = b.column(2)
            for block in blocks(b.column(1)):
                w = block.words(NOT_SPACE)
                data, begin, end = _spaced(block, w)
                for k in range(block.hi - block.lo):
                    lo, hi = int(w.bounds[k]), int(w.bounds[k + 1])
                    spans = flat[block.lo + k].as_py()
                    if not spans:
                        out = data[begin[lo] : end[hi - 1]] if hi > lo else b""
                        removed = 0
                    else:
                        gone = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(gone, [s["first"] for s in spans], 1)
                        np.add.at(gone, [s["last"] for s in spans], -1)
                        gone = np.cumsum(gone)[:-1] > 0
                        removed = int(gone.sum())
                        out = b" ".join(data[begin[lo + x] : end[lo + y]] for x, y in _ranges(~gone))
                    n_words.append(hi - lo)
                    n_removed.append(removed)
                    sha.append(hashlib.sha256(out).hexdigest())
                    kept.append(out.decode() if texts else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = both.select("id", "text", "ranges").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")
