"""Sharding by extendible hashing.

A directory is indexed by the first bits of a document's hash. A bucket splits on one more bit
while it is over the byte limit, so shards have prefixes of different lengths. All depths are found
in one aggregation over fine cells; only cells that are still too large take part in deeper rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.store import written

ID_BITS, TEXT_BITS = 36, 24
BITS = ID_BITS + TEXT_BITS
LIMIT = 8 << 20
SPARE_BITS = 6


def hash_bits(id_col: Column, text: Column) -> Column:
    """60 bits: 36 of the id's MD5 (of the empty string for null), then 24 of the text's.

    Documents that share an id, or have none, are told apart by the bits of their texts.
    """
    own = F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, ID_BITS // 4), 16, 10).cast("long")
    body = F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1, TEXT_BITS // 4), 16, 10).cast("long")
    return own * F.lit(1 << TEXT_BITS) + body


def prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _depths(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell, depth: the first depth in [low, high] at which the cell's bucket fits (null if none).

    ``cells``: cell (a hash whose bits beyond ``high`` are 0), bytes, least, most (hash values in it).
    A bucket of one hash value fits as it is, because no further bit splits it.
    """
    nodes = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    nodes = nodes.withColumn("node", prefix(F.col("cell"), F.col("depth")))
    fits = nodes.groupBy("depth", "node").agg(F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most"))
    fits = fits.where((F.col("bytes") <= limit) | (F.col("least") == F.col("most"))).select("depth", "node")
    first = nodes.select("cell", "depth", "node").join(fits, ["depth", "node"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(first, "cell", "left")


def shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with __h, __depth and __prefix: the directory entry of each row.

    A document's size is the UTF-8 length of its text, 0 for null. Each shard holds ``limit`` bytes
    or less, but for a single document (with its exact repetitions) that is larger by itself. An
    empty table gives an empty result. Columns of ``docs`` are kept.
    """
    rows = docs.withColumn("__h", hash_bits(F.col(id_col), F.col(text_col)))
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    sizes = written(rows.select(F.col("__h").alias("h"), size.alias("bytes")), "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)

    def cells(h: DataFrame, bits: int) -> DataFrame:
        low = F.lit(1 << (BITS - bits))
        return h.groupBy((F.col("h") - F.pmod("h", low)).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.min("h").alias("least"), F.max("h").alias("most")
        )

    found = written(_depths(cells(sizes, depth), 0, depth, limit), "directory")
    cell = F.col("__h") - F.pmod("__h", F.lit(1 << (BITS - depth)))
    out = rows.join(found.select(F.col("cell").alias("__cell"), F.col("depth").alias("__depth")), cell == F.col("__cell"), "left").drop("__cell")
    deep = found.where("depth is null").select("cell")
    if not deep.isEmpty():
        # a few cells hold several large documents: all their hash values, to the last bit
        inside = sizes.withColumn("cell", F.col("h") - F.pmod("h", F.lit(1 << (BITS - depth)))).join(deep, "cell", "left_semi")
        more = written(_depths(cells(inside, BITS), depth + 1, BITS, limit), "directory")
        more = more.select(F.col("cell").alias("__cell"), F.col("depth").alias("__more"))
        out = out.join(more, F.col("__h") == F.col("__cell"), "left").withColumn("__depth", F.coalesce("__depth", "__more")).drop("__cell", "__more")
    return out.withColumn("__prefix", prefix(F.col("__h"), F.col("__depth")))


def shard_name(depth: Column, node: Column) -> Column:
    """The prefix as a string of bits, empty for the only shard."""
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(node), depth, "0"))


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write ``docs`` as Parquet, one folder per shard (`shard=b<bits>`)."""
    found = shards(docs, **how).withColumn("shard", F.concat(F.lit("b"), shard_name(F.col("__depth"), F.col("__prefix"))))
    found = found.select(*[c for c in docs.columns if c != "shard"], "shard")
    found.repartition("shard").write.partitionBy("shard").parquet(path)
