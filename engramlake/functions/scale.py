"""Skew-safe replacements for windows over keys that may hold a large share of all rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. The helpers here cut each
key into pieces by *value* (sequence range or score range), so the cut is repeatable when a task
is run again after an executor is lost, work inside the pieces, and join back one small summary
row per piece.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.session import materialise

CHUNK_ROWS = 1_000_000


def _with_chunk(df: DataFrame, seq: str, chunk_rows: int) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(seq) / F.lit(chunk_rows)).cast("bigint"))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    values: Mapping[str, Column],
    *,
    inclusive: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``sum(value)`` over all rows of the key up to the current one, ordered by ``seq``.

    ``seq`` is an integer position, unique within the key.
    """
    keys = list(keys)
    d = _with_chunk(df, seq, chunk_rows)
    frame_end = 0 if inclusive else -1
    w = Window.partitionBy(*keys, "__chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, frame_end)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy(*keys, "__chunk").agg(*[F.sum(v).alias(f"__c_{n}") for n, v in values.items()])
    carry = carry.select(*keys, "__chunk", *[F.sum(f"__c_{n}").over(before).alias(f"__c_{n}") for n in values])
    local = d.select("*", *[F.sum(v).over(w).alias(f"__l_{n}") for n, v in values.items()])
    out = local.join(carry, [*keys, "__chunk"])
    zero = F.lit(0)
    return out.select(
        *df.columns,
        *[(F.coalesce(f"__c_{n}", zero) + F.coalesce(f"__l_{n}", zero)).alias(n) for n in values],
    )


def lagged(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    values: Mapping[str, str],
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the previous row's value of each column: ``values`` maps new name to source column."""
    keys = list(keys)
    d = _with_chunk(df, seq, chunk_rows)
    w = Window.partitionBy(*keys, "__chunk").orderBy(seq)
    last = d.groupBy(*keys, "__chunk").agg(
        F.max_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]), seq).alias("__last")
    )
    last = last.select(
        *keys, "__chunk", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__chunk")).alias("__prev")
    )
    local = d.select(
        "*",
        F.row_number().over(w).alias("__rn"),
        *[F.lag(c).over(w).alias(f"__l_{n}") for n, c in values.items()],
    )
    out = local.join(last, [*keys, "__chunk"])
    first = F.col("__rn") == 1
    return out.select(
        *df.columns,
        *[F.when(first, F.col(f"__prev.{n}")).otherwise(F.col(f"__l_{n}")).alias(n) for n in values],
    )


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    values: Mapping[str, Column],
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the latest non-null value at or before the current row (an as-of carry forward)."""
    keys = list(keys)
    d = _with_chunk(df, seq, chunk_rows)
    upto = Window.partitionBy(*keys, "__chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy(*keys, "__chunk").agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col(seq))).alias(f"__c_{n}") for n, v in values.items()]
    )
    ends = ends.select(
        *keys, "__chunk",
        *[F.last(f"__c_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values],
    )
    local = d.select("*", *[F.last(v, ignorenulls=True).over(upto).alias(f"__l_{n}") for n, v in values.items()])
    return local.join(ends, [*keys, "__chunk"]).select(
        *df.columns, *[F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in values]
    )


def islands(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, out: str = "island", *, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Number the runs of equal neighbouring ``value`` within each key, from 1."""
    d = df.withColumn("__one", F.lit(1))
    d = lagged(d, keys, seq, {"__seen": "__one", "__before": value}, chunk_rows=chunk_rows)
    change = F.when(F.col("__seen").isNull() | ~F.col(value).eqNullSafe(F.col("__before")), 1).otherwise(0)
    d = running_sum(d, keys, seq, {out: change}, chunk_rows=chunk_rows)
    return d.drop("__one", "__seen", "__before")


def ranges(df: DataFrame, order: Sequence[str | Column], pieces: int | None = None, purpose: str = "ranges") -> DataFrame:
    """Write the rows cut into ranges of ``order`` and read them back with the number of their range, ``__range``.

    Spark samples the rows and cuts at quantiles, so ranges hold about equal numbers of rows however the keys
    are spread. Their number is the session's shuffle partitions, fewer where adaptive execution merges small
    ones, or ``pieces``. As the numbers are written, all later branches agree on them.
    """
    cut = df.repartitionByRange(*order) if pieces is None else df.repartitionByRange(pieces, *order)
    return materialise(cut.withColumn("__range", F.spark_partition_id()), purpose)


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, positions: Mapping[str, Column], *, buckets: int | None = None
) -> DataFrame:
    """Exact elements of each key's sorted values at 1-based positions given in terms of ``n``.

    Equal values are counted first, once, and cut into ranges of (key, value). Counts by range tell which
    range holds a position; only those ranges are sorted. A key that holds most rows is many ranges.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    d = ranges(counted, [*keys, "__v"], buckets)
    w = Window.partitionBy(*keys)
    before = w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    hist = d.groupBy(*keys, "__range").agg(F.sum("__c").alias("__bc"))
    hist = hist.select(
        *keys, "__range", "__bc", F.coalesce(F.sum("__bc").over(before), F.lit(0)).alias("__off"), F.sum("__bc").over(w).alias("n")
    )
    wanted = F.col("__off") == 0  # every key keeps a range, also if none of its positions exists
    for p in positions.values():
        wanted = wanted | F.coalesce((F.col("__off") < p) & (p <= F.col("__off") + F.col("__bc")), F.lit(False))
    j = d.join(hist.where(wanted).drop("__bc"), [*keys, "__range"])
    upto = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("__cum", F.sum("__c").over(upto))
    hi = F.col("__off") + F.col("__cum")
    lo = hi - F.col("__c")
    return j.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when((lo < p) & (p <= hi), F.col("__v"))).alias(name) for name, p in positions.items()],
    )


def _rank_in_ranges(df: DataFrame, keys: list[str], order: list[Column], out: str, buckets: int | None) -> DataFrame:
    """Each range is written sorted, its rows numbered on, so that the rows move once: a rank is the row's number
    less the first one of its key in the range, after the rows of the key's ranges before."""
    at = [*keys, *order]
    cut = df.repartitionByRange(*at) if buckets is None else df.repartitionByRange(buckets, *at)
    numbered = cut.sortWithinPartitions(*at).withColumn("__at", F.monotonically_increasing_id())
    d = materialise(numbered.withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    hist = d.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    hist = hist.select(*keys, "__range", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return d.join(hist, [*keys, "__range"]).select(
        *df.columns, (F.col("__off") + F.col("__at") - F.col("__first") + 1).cast("bigint").alias(out)
    )


def distributed_rank(
    df: DataFrame, keys: Sequence[str], score: str, tie: str, out: str = "rank", *, buckets: int | None = None
) -> DataFrame:
    """Add the 1-based position within the key by (score descending, ``tie`` ascending); null scores come last.

    Ranges are cut by key, score and tie together, so neither a key nor a score that many rows share is one task.
    """
    return _rank_in_ranges(df, list(keys), [F.col(score).desc(), F.col(tie).asc()], out, buckets)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows of each key.

    A constant bound on ``row_number`` lets Spark cut every input partition to ``k`` rows per key
    before the shuffle (WindowGroupLimit), so a dominating key costs ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= F.lit(k))


def pieced_rank(
    df: DataFrame, keys: Sequence[str], pieces: Sequence[str], order: Sequence[str], out: str = "rank"
) -> DataFrame:
    """Add the 1-based position within the key in (pieces, order) order.

    Each piece is numbered apart and shifted by the sizes of the key's pieces before it.
    """
    keys, pieces = list(keys), list(pieces)
    hist = df.groupBy(*keys, *pieces).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(*keys, *pieces, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    local = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, *pieces).orderBy(*order)))
    return local.join(hist, [*keys, *pieces]).select(
        *df.columns, (F.col("__off") + F.col("__rn")).cast("bigint").alias(out)
    )


def hashed_rank(df: DataFrame, keys: Sequence[str], ident: str, out: str = "rank", *, buckets: int | None = None) -> DataFrame:
    """Position within the key in pseudo-random but repeatable order: (first two hex digits of the id's md5, id)."""
    d = df.withColumn("__piece", F.substring(F.md5(F.col(ident).cast("string")), 1, 2))
    return _rank_in_ranges(d, list(keys), [F.col("__piece"), F.col(ident)], out, buckets).drop("__piece")
