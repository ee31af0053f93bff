"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. Each block of texts writes its distinct pre-tokens once and its texts
as positions among them, so a frequent word costs a block one row however often it stands there,
and no word holds more rows than there are blocks. Shuffled and sorted by word, each distinct word
is encoded once; its ids go back to the blocks that hold it, and the texts are reassembled by
position. The blocks stay where they were written, in buckets. Decoding joins the table of token
bytes, which the vocabulary bounds, beside the scan.
"""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.store import bucketed, written

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 8 << 20
MOST_BYTES = 64 << 20  # of a vocabulary file: it is sent to every task
ANY = r"(?s:.+)"
_ROWS = 10_000
_SENT = 1 << 18
_OUT_BYTES = 4 << 20


def vocabulary(path: str) -> bytes:
    """The file of ranks: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        held = f.read(MOST_BYTES + 1)
    if len(held) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return held


def ranks(held: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, held.splitlines()) if token}


def _block_id(n: int) -> int:
    """A number for the ``n``-th block of a task; the table written from the blocks holds one attempt of each task."""
    return (TaskContext.get().partitionId() << 32) + n


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 in seven bits a byte, the lowest first; a byte of 128 or more has another after it."""
    out = np.zeros((len(numbers), 5), np.uint8)
    used = np.ones((len(numbers), 5), bool)
    rest = numbers.astype(np.uint64)
    for i in range(5):
        out[:, i] = (rest & np.uint64(127)).astype(np.uint8)
        rest = rest >> np.uint64(7)
        used[:, i + 1 :] &= (rest > 0)[:, None]
        out[:, i] |= (rest > 0).astype(np.uint8) << 7
    return out[used].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    held = np.frombuffer(packed, np.uint8)
    last = np.flatnonzero(held < 128)
    first = np.append(0, last[:-1] + 1) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for i in range(5):
        more = np.flatnonzero(first + i <= last)
        out[more] |= (held[first[more] + i].astype(np.int64) & 127) << (7 * i)
    return out


class _Block:
    """The distinct words of some texts, and the texts as numbers of words; frequent words have small numbers."""

    def __init__(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list = []
        self.places: list[np.ndarray] = []

    def add(self, own: object, words: Iterator) -> None:
        places = array("I", map(self.number.__getitem__, words))
        self.ids.append(own)
        self.places.append(np.frombuffer(places, np.uint32))

    def rows(self, block: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The words (block, k, word), then the texts (block, id, places), some at a time."""
        names = ["block", "k", "word", "id", "places"]
        words = [w.encode() for w in self.number]
        times = np.bincount(np.concatenate(self.places), minlength=len(words)).tolist()
        order = sorted(range(len(words)), key=lambda i: (-times[i], words[i]))
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words), dtype=np.uint32)
        for lo in range(0, len(words), _ROWS):
            part = [words[i] for i in order[lo : lo + _ROWS]]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(np.arange(lo, lo + n, dtype=np.int32)), pa.array(part, pa.binary()), pa.nulls(n, kind), pa.nulls(n, pa.binary())], names
            )
        for lo in range(0, len(self.ids), _ROWS):
            part = [_packed(number[p]) for p in self.places[lo : lo + _ROWS]]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(self.ids[lo : lo + n], kind), pa.array(part, pa.binary())], names
            )


def _sent_back(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
    """One row for each block: numbers of words (as steps), how many ids each has, and the ids, packed."""
    block, k = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.lexsort([k, block])
    ids = pa.concat_arrays([h[2] for h in held]).take(pa.array(order))
    block, k, counts, flat = block[order], k[order], ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    ends, upto = np.append(first[1:], len(block)), np.append(0, np.cumsum(counts))
    packed = [
        (_packed(np.diff(k[lo:hi], prepend=0)), _packed(counts[lo:hi]), _packed(flat[upto[lo] : upto[hi]])) for lo, hi in zip(first, ends, strict=True)
    ]
    return pa.RecordBatch.from_arrays([pa.array(block[first]), *[pa.array(c, pa.binary()) for c in zip(*packed, strict=True)]], ["block", "steps", "counts", "ids"])


def _reassemble(found: pa.Table, texts: pa.Table) -> pa.Table:
    """id, ids of the texts of one block, from the ids of its distinct words."""
    whole = lambda name, step=lambda x: x: np.concatenate([np.zeros(0, np.int64)] + [step(_unpacked(x)) for x in found.column(name).to_pylist()])
    k, counts, flat = whole("steps", np.cumsum), whole("counts"), whole("ids")
    parts = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), pa.array(flat.astype(np.int32))).take(pa.array(np.argsort(k)))
    out = [parts.take(pa.array(_unpacked(packed))).flatten().to_numpy() for packed in texts.column("places").to_pylist()]
    made = pa.table([texts.column("id"), pa.array(out, pa.list_(pa.int32()))], ["id", "ids"])
    pa.default_memory_pool().release_unused()
    return made


def encode(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """id, ids (array of int): a row for each row of ``docs``.

    Each match of ``pattern`` is encoded by itself with the ranks of the file ``path``, without
    special tokens. Null and empty texts have no ids. Ids of rows may be null or repeated: each row
    stands for itself. Bytes that are not UTF-8 are read as U+FFFD. An empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path or public_tokenizers.path(VOCABULARY)))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    words = regex.compile(pattern)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n, kind = _Block(), 0, 0, None
        for b in batches:
            kind = b.column(0).type
            for own, item in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                grows = item.as_buffer().size
                if held and held + grows > block_bytes:
                    yield from block.rows(_block_id(n), kind)
                    block, held, n = _Block(), 0, n + 1
                text = item.as_py().decode("utf-8", "replace")
                block.add(own, (m[0] for m in words.finditer(text)) if words.groups else words.findall(text))
                held += grows
        if block.ids:
            yield from block.rows(_block_id(n), kind)
        pa.default_memory_pool().release_unused()  # the worker lives on

    kind = rows.schema["id"].dataType.simpleString()
    blocks = bucketed(rows.mapInArrow(cut, f"block long, k int, word binary, id {kind}, places binary"), "bpe-blocks", "block")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = tiktoken.Encoding("words", pat_str=ANY, mergeable_ranks=ranks(held.value), special_tokens={})
        last, known, waiting, n = None, [], [], 0
        for b in batches:  # sorted by word: only a word that spans two batches comes again
            own = b.column(0).dictionary_encode()
            distinct = own.dictionary.to_pylist()
            ids = [known if w == last else whole.encode_ordinary(w.decode()) for w in distinct]
            if ids:
                last, known = distinct[-1], ids[-1]
                waiting.append((b.column(1).to_numpy(), b.column(2).to_numpy(), pa.array(ids, pa.list_(pa.int32())).take(own.indices)))
                n += b.num_rows
            if n >= _SENT:
                yield _sent_back(waiting)
                waiting, n = [], 0
        if waiting:
            yield _sent_back(waiting)
        pa.default_memory_pool().release_unused()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks.where("k is not null").select("word", "block", "k").repartition(parts, "word").sortWithinPartitions("word")
    found = written(asked.mapInArrow(encoded, "block long, steps binary, counts binary, ids binary"), "bpe-ids")
    texts = blocks.where("k is null").select(F.col("block").alias("of"), "id", "places")
    return found.groupBy("block").cogroup(texts.groupBy("of")).applyInArrow(_reassemble, f"id {kind}, ids array<int>")


def decode(rows: DataFrame, *, ids_col: str = "ids", name: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with ``name`` (binary), the bytes of the ids (in place of a column of that name).

    No ids decode to no bytes, a null array to null; an id that the vocabulary lacks, or a null
    among the ids, makes the row's decoded null. Every row stands for itself; an empty table gives none.
    """
    held = rows.sparkSession.sparkContext.broadcast(vocabulary(path or public_tokenizers.path(VOCABULARY)))
    rows = rows.drop(name).withColumn(ids_col, F.col(ids_col).cast("array<int>"))
    at, names = rows.columns.index(ids_col), [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks(held.value)
        table: list[bytes | None] = [None] * (max(own.values()) + 1)
        for token, rank in own.items():
            table[rank] = token
        parts = pa.array(table, pa.large_binary())
        for b in batches:
            lo, out, held_bytes = 0, [], 0
            for i, item in enumerate(b.column(at), 1):
                out.append(_bytes(item.values, parts) if item.is_valid else None)
                held_bytes += len(out[-1] or b"")
                if held_bytes > _OUT_BYTES or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(lo, i - lo).columns, pa.array(out, pa.binary())], names)
                    lo, out, held_bytes = i, [], 0

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(None).cast("binary")).schema)


def _bytes(ids: pa.Array, parts: pa.Array) -> bytes | None:
    """The parts of the ids, one after the other; null where one is null or unknown."""
    known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(parts)))
    taken = parts.take(pc.if_else(known, ids, pa.scalar(None, pa.int32())))
    if taken.null_count:
        return None
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return taken.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes() if offsets[-1] > offsets[0] else b""
