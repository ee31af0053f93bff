"""Benchmark decontamination with training suffix arrays.

Each task builds suffix arrays over shards of training words and searches every test suffix in
them by binary search. Only words of the benchmark can be part of a match, so a shard holds the
runs of such words; all others end a run. Words are looked up by a 64-bit hash first and then
compared as bytes, so results are exact.

The benchmark goes to the tasks in blocks of at most about ``block_words`` words. A task has one
block in memory at a time, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.rowwise import add_column
from engramlake.llm.spans import ALNUM, Block, blocks

WINDOW = 13
BLOCK_WORDS = 2_000_000
FIELDS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,hits:array<struct<first:int,last:int>>>"


@dataclass
class Tests:
    """A block of the benchmark: its words as numbers from 1, item after item, and its windows."""

    names: list[str | None]
    number: dict[bytes, int]
    hashes: np.ndarray  # of the words, sorted
    hash_number: np.ndarray
    seq: np.ndarray  # 0 ends an item
    item: np.ndarray  # of each position
    left: np.ndarray  # words from each position to the end of its item
    start: np.ndarray  # of each different window
    length: np.ndarray
    owners: np.ndarray  # items of the windows, window after window
    owner_at: np.ndarray
    need: np.ndarray  # per word: the shortest window that begins with it

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], window: int) -> Tests:
        names = [None if r[0] is None else str(r[0]) for r in rows]
        number: dict[bytes, int] = {}
        hashes: dict[int, int] = {}
        seq, item = [], []
        for block in blocks(pa.array([r[1] for r in rows], pa.string()), lower=True):
            w = block.words(ALNUM)
            raw = w.data.tobytes()
            ids = []
            for s, e, h in zip(w.start.tolist(), w.end.tolist(), w.hashes().tolist(), strict=True):
                ids.append(n := number.setdefault(raw[s:e], len(number) + 1))
                hashes.setdefault(h, n)
            for k in range(block.hi - block.lo):
                own = ids[w.bounds[k] : w.bounds[k + 1]]
                seq += [*own, 0]
                item += [block.lo + k] * (len(own) + 1)
        seq, item = np.array(seq, np.int32), np.array(item, np.int32)
        ends = np.flatnonzero(seq == 0)
        left = ends[np.searchsorted(ends, np.arange(len(seq)))] - np.arange(len(seq))
        whole = np.concatenate([np.zeros(1, np.int64), ends + 1])[:-1][: len(ends)]
        short = np.zeros(len(seq), bool)
        short[whole] = left[whole] < window
        at = np.flatnonzero((left >= window) | (short & (left > 0)))
        length = np.minimum(left[at], window)
        rowed = np.zeros((len(at), window), np.int32)
        for j in range(window):
            has = length > j
            rowed[has, j] = seq[at[has] + j]
        different, back = np.unique(rowed, axis=0, return_inverse=True) if len(at) else (rowed, np.zeros(0, np.int64))
        back = back.reshape(-1)
        pairs = np.unique(np.stack([back, item[at]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        first = np.zeros(len(different), np.int64)
        first[back[::-1]] = at[::-1]
        size = np.zeros(len(different), np.int64)
        size[back] = length
        need = np.full(len(number) + 1, np.iinfo(np.int32).max, np.int64)
        np.minimum.at(need, seq[first], size)
        keys = np.array(sorted(hashes), np.uint64)
        return cls(
            names, number, keys, np.array([hashes[int(k)] for k in keys], np.int32), seq, item, left, first, size,
            pairs[1], np.searchsorted(pairs[0], np.arange(len(different) + 1)), need,
        )


@dataclass
class Shard:
    """Suffix array of the runs of test words in some texts."""

    seq: np.ndarray  # 0 ends a run
    word: np.ndarray  # the word of the block at each position
    order: np.ndarray  # positions of suffixes in sorted order

    @classmethod
    def of(cls, block: Block, words, tests: Tests, depth: int) -> Shard | None:
        if not len(tests.hashes) or not len(words.start):
            return None
        h = words.hashes()
        at = np.minimum(np.searchsorted(tests.hashes, h), len(tests.hashes) - 1)
        ids = np.where(tests.hashes[at] == h, tests.hash_number[at], 0)
        run = _runs(ids, words.bounds)
        keep = _reached(run >= tests.need[ids], run)
        if not keep.any():
            return None
        # the hash said yes: compare the words themselves
        raw = words.data
        where = np.flatnonzero(keep)
        ids = np.zeros_like(ids)
        number = tests.number
        ids[where] = [
            number.get(raw[s:e].tobytes(), 0) for s, e in zip(words.start[where].tolist(), words.end[where].tolist(), strict=True)
        ]
        run = _runs(ids, words.bounds)
        keep = _reached(run >= tests.need[ids], run)
        if not keep.any():
            return None
        # one terminator after each run kept
        ends = keep & np.concatenate([~keep[1:] | (run[:-1] == 1), [True]])
        word = np.flatnonzero(keep)
        place = np.arange(len(word)) + np.concatenate([[0], np.cumsum(ends[word])[:-1]])
        seq = np.zeros(int(place[-1]) + 2, np.int64)
        seq[place] = ids[word]
        at_word = np.full(len(seq), -1, np.int64)
        at_word[place] = word
        return cls(seq, at_word, suffix_order(seq, depth))


def _runs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Known words from each position on, within its text."""
    n = len(ids)
    stop = np.full(n + 1, n, np.int64)
    zero = np.flatnonzero(ids == 0)
    stop[zero] = zero
    stop = np.minimum.accumulate(stop[::-1])[::-1][:n]
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.minimum(stop, ends) - np.arange(n)


def _reached(begin: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Positions from each beginning to the end of its run."""
    at = np.flatnonzero(begin)
    cover = np.zeros(len(run) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + run[at], -1)
    return np.cumsum(cover)[:-1] > 0


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` or more values, by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        by = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(by[1:] != by[:-1])])
        rank, k = new, 2 * k
        if rank.max() == n - 1:
            break
    return order


def _compare(a: np.ndarray, at: np.ndarray, length: np.ndarray, b: np.ndarray, bt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of a[at:at+length] against b[bt:], over ``length`` values, and the values they share."""
    sign, same = np.zeros(len(at), np.int8), np.array(length)
    live, j = np.arange(len(at)), 0
    while len(live := live[length[live] > j]):
        x = a[at[live] + j]
        y = b[np.minimum(bt[live] + j, len(b) - 1)]
        out = x != y
        sign[live[out]] = np.where(x[out] < y[out], -1, 1)
        same[live[out]] = j
        live, j = live[~out], j + 1
    return sign, same


def _bound(shard: Shard, tests: Tests, start: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of each test suffix: the first place not before it, or past all that begin with it."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(shard.order), np.int64)
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        sign, _ = _compare(tests.seq, start[live], length[live], shard.seq, shard.order[mid])
        right = sign >= 0 if upper else sign > 0
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
    return lo


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range's number and each of its places."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def search(block: Block, words, tests: Tests, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of windows: first word (of the block) and length; and (text, item) pairs."""
    none = np.zeros(0, np.int64)
    shard = Shard.of(block, words, tests, window)
    if shard is None:
        return none, none, np.zeros((0, 2), np.int64)
    lo = _bound(shard, tests, tests.start, tests.length, False)
    hi = _bound(shard, tests, tests.start, tests.length, True)
    which, place = _expand(lo, hi)
    first = shard.word[shard.order[place]]
    pairs = np.unique(np.stack([words.doc[first], which], axis=1), axis=0)
    row, at = _expand(tests.owner_at[pairs[:, 1]], tests.owner_at[pairs[:, 1] + 1])
    return first, tests.length[which], np.unique(np.stack([pairs[row, 0], tests.owners[at]], axis=1), axis=0)


def _test_blocks(bench: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> list:
    """The benchmark as broadcasts of bounded size: items are dealt by hash to as many blocks as its words need."""
    spark = bench.sparkSession
    rows = bench.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    # a word and the gap after it take two bytes at least
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(size // (2 * block_words))
    out = []
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else rows
        got = [(r.item, r.text) for r in part.toLocalIterator()]
        if got:
            out.append(spark.sparkContext.broadcast(Tests.of(sorted(got, key=str), window)))
    return out


def _loaded(tests: list) -> Iterator[Tests]:
    for b in tests:
        yield b.value
        if len(tests) > 1:
            del b._value  # one block at a time


def contamination(
    docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, name: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct: n_words, n_hit, items (sorted as strings), hits (ranges of word numbers, last excluded).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A window is ``window``
    consecutive words of an item; an item of fewer words is one window, an item of none has none.
    A word is hit if any occurrence of a window covers it. Null and empty texts have no words, and
    items of null text no windows; an item without an id hits words but is not listed. Repeated rows
    come out as often as they go in. Columns of ``docs`` are kept; one called ``name`` is replaced.
    """
    tests = _test_blocks(bench, item_col, bench_text, window, block_words)

    def values(texts: pa.Array) -> pa.Array:
        n_words, n_hit, items, hits = [], [], [[] for _ in range(len(texts))], []
        cut = list(blocks(texts, lower=True))
        found = [[] for _ in cut]
        for t in _loaded(tests):
            for k, block in enumerate(cut):
                first, length, pairs = search(block, block.words(ALNUM), t, window)
                found[k].append((first, length))
                for d, i in pairs.tolist():
                    if t.names[i] is not None:
                        items[block.lo + d].append(t.names[i])
        for k, block in enumerate(cut):
            w = block.words(ALNUM)
            cover = np.zeros(len(w.start) + 1, np.int64)
            for first, length in found[k]:
                np.add.at(cover, first, 1)
                np.add.at(cover, first + length, -1)
            hit = np.cumsum(cover)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_words += np.diff(w.bounds).tolist()
            n_hit += np.diff(total[w.bounds]).tolist()
            turn = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            # a text's end ends a range
            rises, falls = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            ranges: list[list[dict]] = [[] for _ in range(block.hi - block.lo)]
            for a, b in zip(rises.tolist(), falls.tolist(), strict=True):
                d = int(w.doc[a])
                while a < b:
                    e = min(b, int(w.bounds[d + 1]))
                    if e > a:
                        ranges[d].append({"first": a - int(w.bounds[d]), "last": e - int(w.bounds[d])})
                    a, d = e, d + 1
            hits += ranges
        return pa.StructArray.from_arrays(
            [
                pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                pa.array(hits, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
            ],
            ["n_words", "n_hit", "items", "hits"],
        )

    return add_column(docs, text_col, name, FIELDS, lambda: values)


def is_contaminated(name: str = "contamination"):
    """Hit, and by a twentieth of its words or more."""
    return (F.col(f"{name}.n_hit") > 0) & (20 * F.col(f"{name}.n_hit") >= F.col(f"{name}.n_words"))


def clean(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    mark = "__contamination"
    return contamination(docs, bench, name=mark, **how).where(~is_contaminated(mark)).select(*docs.columns)


def longest_matches(
    docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    bench_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """item, word, length, id, at: for each test suffix of at least a window, its longest verbatim match in all
    shards, and where it is (ties to the smaller id and place). Suffixes that match no whole window have no row.
    """
    tests = _test_blocks(bench, item_col, bench_text, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t in _loaded(tests):
                suffix = np.flatnonzero(t.left >= window)
                opens = np.searchsorted(t.item, t.item[suffix]) if len(suffix) else suffix
                for block in blocks(b.column(1), lower=True):
                    w = block.words(ALNUM)
                    shard = Shard.of(block, w, t, int(t.left.max(initial=1)))
                    if shard is None:
                        continue
                    at = _bound(shard, t, suffix, t.left[suffix], False)
                    best = np.zeros(len(suffix), np.int64)
                    for near in (at, at - 1):
                        ok = (near >= 0) & (near < len(shard.order))
                        place = shard.order[np.clip(near, 0, len(shard.order) - 1)]
                        best = np.maximum(best, np.where(ok, _compare(t.seq, suffix, t.left[suffix], shard.seq, place)[1], 0))
                    keep = np.flatnonzero(best >= window)
                    lo, hi = (_bound(shard, t, suffix[keep], best[keep], up) for up in (False, True))
                    which, place = _expand(lo, hi)
                    word = shard.word[shard.order[place]]
                    # within a text, the first place of each longest match
                    order = np.lexsort([word, w.doc[word], which])
                    which, word = which[order], word[order]
                    new = np.ones(len(which), bool)
                    new[1:] = (which[1:] != which[:-1]) | (w.doc[word[1:]] != w.doc[word[:-1]])
                    which, word = which[new], word[new]
                    out[0] += [t.names[i] for i in t.item[suffix[keep[which]]]]
                    out[1] += (suffix[keep[which]] - opens[keep[which]]).tolist()
                    out[2] += best[keep[which]].tolist()
                    out[3] += b.column(0).take(pa.array(block.lo + w.doc[word])).to_pylist()
                    out[4] += (word - w.bounds[w.doc[word]]).tolist()
            kinds = [pa.string(), pa.int64(), pa.int64(), b.column(0).type, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["item", "word", "length", "id", "at"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"item string, word long, length long, id {kind}, at long")
    best = found.groupBy("item", "word").agg(F.min(F.struct(-F.col("length"), "id", "at")).alias("b"))
    return best.select("item", "word", (-F.col("b.col1")).alias("length"), "b.id", "b.at")
