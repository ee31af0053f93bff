"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

All sets of word characters used here are closed under UTF-8: every byte of a character above
0x7F is a word byte, so words can be cut on bytes. A block holds whole texts of at most
``BLOCK_BYTES`` together (one longer text is a block of its own), which bounds a task's memory by
the block and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C13)  # odd, 3 mod 4


def byte_set(excluded: str) -> np.ndarray:
    """True for bytes that belong to words, given the ASCII characters that do not."""
    t = np.ones(256, bool)
    t[[ord(c) for c in excluded]] = False
    return t


#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_set(" \t\n\x0b\x0c\r")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
ALNUM = byte_set("".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    """Texts ``lo`` to ``hi`` of a batch: their bytes, and where each begins and ends in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self, members: np.ndarray) -> Words:
        n = len(self.data)
        if n == 0:
            empty = np.zeros(0, np.int64)
            return Words(self.data, empty, empty, empty, np.zeros(self.hi - self.lo + 1, np.int64))
        w = members[self.data]
        begins, ends = w.copy(), w.copy()
        begins[1:] &= ~w[:-1]
        ends[:-1] &= ~w[1:]
        first = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        last = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        begins[first] = w[first]
        ends[last] = w[last]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        bounds = np.searchsorted(start, self.offsets)
        doc = np.repeat(np.arange(self.hi - self.lo), np.diff(bounds))
        return Words(self.data, start, end, doc, bounds)


@dataclass
class Words:
    """Words of a block: byte ranges, the text each belongs to, and each text's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every block."""
        n = len(self.data)
        power, inverse, weight = _powers(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(weight[self.data] * power[:n], out=run[1:])
        h = (run[self.end] - run[self.start]) * inverse[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_KEPT: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse, and a weight for each byte. A task keeps the longest made."""
    if not _KEPT or len(_KEPT[0][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())

        def powers(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.cumprod(out)

        _KEPT[:] = [(powers(int(_BASE)), powers(pow(int(_BASE), -1, 1 << 64)), mix(np.arange(1, 257, dtype=np.uint64)))]
    return _KEPT[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive values; entry i is the run that begins at i."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, inverse, _ = _powers(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=run[1:])
    return mix((run[n:] - run[:-n]) * inverse[: len(h) - n + 1])


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES, lower: bool = False) -> Iterator[Block]:
    """Cut a string column into blocks; null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, len(texts))
        part = raw[at[lo] : at[hi]]
        yield Block(lo, hi, LOWER[part] if lower else part, at[lo : hi + 1] - at[lo])
        lo = hi
