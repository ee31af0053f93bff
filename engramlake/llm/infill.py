"""Fill-in-the-middle: a text's three parts, exchanged in place and marked by sentinels.

The two cuts are scanned for in the UTF-8 bytes, the sentinels are inserted in a bytearray, and two
neighbouring segments change places by three reversals. The inverse rotation and the removal of the
sentinels restore the text byte for byte. A text that holds a sentinel stays plain, so that each
sentinel of an output is its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentinels, and the shares (of 100) of plain texts and of suffix-first ones.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINEL = "<[PSM]>"
PLAIN_FROM, SPM_BELOW = 90, 20

_SCAN = 1 << 20


def offset(text: bytes, units: int) -> int:
    """The byte at which code point ``units`` begins; the text's end for its number of code points."""
    if text.isascii():
        return units
    for lo in range(0, len(text), _SCAN):
        leads = np.flatnonzero((np.frombuffer(text[lo : lo + _SCAN], np.uint8) & 0xC0) != 0x80)
        if units < len(leads):
            return lo + int(leads[units])
        units -= len(leads)
    return len(text)


def rotate(block: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the neighbouring segments lo:mid and mid:hi in place: reverse each, then both together."""
    for a, b in ((lo, mid), (mid, hi), (lo, hi)):
        block[a:b] = block[a:b][::-1]


def infill(text: bytes, first: int, second: int, form: str) -> bytes:
    """The output of ``text`` cut after ``first`` and ``second`` code points."""
    if form == "plain":
        return text
    block = bytearray(text)
    a, b = offset(block, first), offset(block, second)
    for at, mark in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        block[at:at] = mark
    middle, suffix = len(PREFIX) + a, len(PREFIX) + len(MIDDLE) + b
    rotate(block, middle if form == "psm" else 0, suffix, len(block))
    return bytes(block)


def restored(output: bytes, form: str) -> bytes:
    """The text that ``infill`` had: the segments rotated back, the sentinels taken out."""
    if form == "plain":
        return output
    block = bytearray(output)
    suffix, middle = block.index(SUFFIX), block.index(MIDDLE)
    if form == "psm":
        rotate(block, suffix, middle, len(block))
    else:
        rotate(block, 0, block.index(PREFIX), len(block))
    for mark in (SUFFIX, MIDDLE, PREFIX):  # from the end to the front
        at = block.rindex(mark)
        del block[at : at + len(mark)]
    return bytes(block)


def draw(id_col: str, group: int) -> Column:
    """One of the first four 8-digit groups of the seeded hash of the id, as a number."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def planned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n, form and both cuts (in code points) of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *[draw(id_col, i).alias(f"h{i}") for i in range(1, 5)])
    rows = rows.withColumn("n", F.length("text").cast("long"))
    plain = (F.col("n") == 0) | F.rlike("text", F.lit(SENTINEL)) | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    return rows.select("id", "text", "n", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output: a row for each row of ``docs``.

    Null and empty texts, and texts that hold a sentinel, are plain: the output is the text (null
    counts as empty), the lengths are null. The cuts depend on the id alone: rows that repeat an id
    draw the same numbers, a null id those of the empty id. An empty table gives an empty result.
    """
    rows = planned(docs, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, (form, first, second) = _bytes(b.column(1)), (b.column(i).to_pylist() for i in (3, 4, 5))
            made = pa.array((infill(t.as_py(), i, j, f) for t, i, j, f in zip(texts, first, second, form, strict=True)), pa.large_binary())
            cut = pc.not_equal(b.column(3), "plain")
            lengths = (b.column(4), pc.subtract(b.column(5), b.column(4)))
            lengths = [pc.if_else(cut, x, pa.scalar(None, pa.int64())) for x in lengths]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), *lengths, made.cast(pa.binary()).view(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, *, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """``rows`` with the text that each output was made of (in place of a column of that name). Null where the output or form is."""
    rows = rows.drop(name)
    at, kind = rows.columns.index(output_col), rows.columns.index(form_col)
    names = [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(_bytes(b.column(at)), b.column(kind).to_pylist(), strict=True)
            back = pa.array((restored(o.as_py(), f) if o.is_valid and f is not None else None for o, f in pairs), pa.large_binary())
            yield pa.RecordBatch.from_arrays([*b.columns, back.cast(pa.binary()).view(pa.string())], names)

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(None).cast("string")).schema)
