"""Event streams in batch form: batches, interleaving, sessions, deadlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.scale import hashed_rank, pieced_rank, running_sum
from engramlake.operators.scoring import fill_unanswered

MID_SHARE = 0.4


def assign_batches(entities: DataFrame, keys: Sequence[str], seq: str, batch_size: int, *, keep_tail: bool = True,
                   chunk_rows: int = 1_000_000) -> DataFrame:
    """Fixed-size batches in arrival order and the entities seen after each row's batch.

    The last batch may be shorter. Without ``keep_tail`` there are max(1, n // size) batches and the rest is not ingested.
    """
    keys = list(keys)
    d = running_sum(entities, keys, seq, {"__rn": F.lit(1)}, chunk_rows=chunk_rows)
    n = entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    d = d.join(n, keys).withColumn("batch", F.floor((F.col("__rn") - 1) / batch_size))
    whole = F.ceil(F.col("__n") / batch_size) if keep_tail else F.floor(F.col("__n") / batch_size)
    d = d.withColumn("n_batches", F.greatest(F.lit(1), whole))
    if not keep_tail:
        d = d.where(F.col("batch") < F.col("n_batches"))
    return d.select(
        *entities.columns, "batch", "n_batches", F.least((F.col("batch") + 1) * batch_size, F.col("__n")).alias("entities_seen")
    )


PHASES = {"noise": 0, "ingest": 1, "correction": 2, "contradiction": 3, "question": 4}


def interleave_events(worlds: DataFrame, corrections: DataFrame, contradictions: DataFrame, questions: DataFrame,
                      keys: Sequence[str]) -> DataFrame:
    """One ordered event list per world.

    ``worlds``: keys, n_batches, corr_frac, contra_frac. The others: keys, seq. In a batch: noise, ingest,
    corrections, contradictions, a mid-stream question; the remaining questions come last. About a third of
    the batches from 1 on carry noise, up to 40 % of the questions go to batches from 2 on, both drawn in hash order.
    """
    keys = list(keys)
    nb = F.col("n_batches")
    corr = F.least(nb - 1, F.greatest(F.lit(0), F.floor(nb * F.col("corr_frac"))))
    contra = F.when(nb > 1, F.least(nb - 1, F.greatest(corr + 1, F.floor(nb * F.col("contra_frac"))))).otherwise(0)
    w = worlds.select(*keys, nb.alias("n_batches"), corr.alias("corr_batch"), contra.alias("contra_batch"))
    batches = w.select(*keys, "n_batches", F.explode(F.sequence(F.lit(0).cast("bigint"), nb - 1)).alias("batch"))
    zero = F.lit(0).cast("bigint")

    def typed(df: DataFrame, kind: str, batch: Column, seq: Column) -> DataFrame:
        return df.select(*keys, batch.cast("bigint").alias("batch"), F.lit(PHASES[kind]).alias("phase"), seq.cast("bigint").alias("seq"), F.lit(kind).alias("type"))

    ingest = typed(batches, "ingest", F.col("batch"), zero)
    noisy = hashed_rank(batches.where((F.col("batch") >= 1) & (nb > 2)), keys, "batch", "__r").where(
        F.col("__r") <= F.greatest(F.lit(1), F.floor(nb / 3))
    )
    noise = typed(noisy, "noise", F.col("batch"), zero)
    fixes = typed(corrections.join(w, keys), "correction", F.col("corr_batch"), F.col("seq"))
    contras = typed(contradictions.join(w, keys), "contradiction", F.col("contra_batch"), F.col("seq"))

    nq = questions.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * MID_SHARE)).alias("__mid"))
    drawn = hashed_rank(batches.where((F.col("batch") >= 2) & (nb > 2)), keys, "batch", "__r").join(nq, keys).where(
        F.col("__r") <= F.col("__mid")
    )
    drawn = running_sum(drawn.select(*keys, "batch"), keys, "batch", {"__nth": F.lit(1)})
    numbered = running_sum(questions.select(*keys, "seq"), keys, "seq", {"__nth": F.lit(1)})
    q = numbered.join(drawn, [*keys, "__nth"], "left").join(w.select(*keys, "n_batches"), keys)
    asked = typed(q, "question", F.coalesce(F.col("batch"), nb), F.col("seq"))
    out = noise.unionByName(ingest).unionByName(fixes).unionByName(contras).unionByName(asked)
    ranked = pieced_rank(out, keys, ["batch", "phase"], ["seq"], "__at")
    return ranked.withColumn("event_idx", F.col("__at") - 1).drop("__at")


def break_positions(n_events: Column, n_sessions: int) -> Column:
    """Indices before which a new session starts: int(b x n / sessions), at least 1, without doubles."""
    at = [F.greatest(F.lit(1), F.floor(F.lit(b) * (n_events / n_sessions))).cast("bigint") for b in range(1, n_sessions)]
    return F.array_distinct(F.array(*at)) if at else F.array().cast("array<bigint>")


def split_sessions(events: DataFrame, keys: Sequence[str], n_sessions: int, idx: str = "event_idx", *,
                   entity: str | None = None) -> DataFrame:
    """Session number of every event; streams shorter than the number of breaks stay whole.

    With ``entity`` (events then also have a ``type``), a stream in which no break lies between a correction and
    the first ingest of its entity gets its first break moved there: half-way between the two for the earliest
    correction that follows its ingest. Without such a correction the even breaks stay.
    """
    keys = list(keys)
    n = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    none = F.array().cast("array<bigint>")
    plan = n.select(
        *keys, F.when(F.col("__n") < n_sessions, none).otherwise(break_positions(F.col("__n"), n_sessions)).alias("__breaks")
    )
    if entity:
        plan = _crossing_breaks(events, plan, keys, idx, entity)
    passed = F.filter("__breaks", lambda b: b <= F.col(idx))
    return events.join(plan, keys).withColumn("session", F.size(passed).cast("bigint")).drop("__breaks")


def _crossing_breaks(events: DataFrame, plan: DataFrame, keys: list[str], idx: str, entity: str) -> DataFrame:
    first = events.where(F.col("type") == "ingest").groupBy(*keys, entity).agg(F.min(idx).alias("__from"))
    fixes = events.where(F.col("type") == "correction").select(*keys, entity, F.col(idx).alias("__to"))
    start, end = F.col("__from"), F.col("__to")
    parted = F.exists("__breaks", lambda b: (F.least(start, end) < b) & (b <= F.greatest(start, end)))
    found = fixes.join(first, [*keys, entity]).join(plan, keys).groupBy(*keys).agg(
        F.bool_or(parted).alias("__parted"), F.min(F.when(start < end, F.struct("__to", "__from"))).alias("__pair")
    )
    between = (F.floor((F.col("__pair.__from") + F.col("__pair.__to")) / 2) + 1).cast("bigint")
    rest = F.slice("__breaks", 2, F.size("__breaks"))
    move = ~F.col("__parted") & F.col("__pair").isNotNull() & (F.size("__breaks") > 0)
    return plan.join(found, keys, "left").select(
        *keys,
        F.when(F.coalesce(move, F.lit(False)), F.array_distinct(F.concat(F.array(between), rest)))
        .otherwise(F.col("__breaks")).alias("__breaks"),
    )


def cross_session_updates(events: DataFrame, keys: Sequence[str], entity: str = "entity") -> DataFrame:
    """Corrections whose entity was first ingested in another session.

    ``events``: keys, entity, type, event_idx, session. Every break between the two positions changes the
    session number, so comparing numbers replaces a range join on break positions.
    """
    keys = list(keys)
    first = events.where(F.col("type") == "ingest").groupBy(*keys, entity).agg(
        F.min_by("session", "event_idx").alias("ingest_session"), F.min("event_idx").alias("ingest_idx")
    )
    return events.where(F.col("type") == "correction").join(first, [*keys, entity]).where(
        F.col("session") != F.col("ingest_session")
    ).select(*keys, entity, "event_idx", "session", "ingest_idx", "ingest_session")


def answers_before_deadline(questions: DataFrame, answers: DataFrame, deadlines: DataFrame, keys: Sequence[str],
                            run: Sequence[str]) -> DataFrame:
    """Answers at or after the run's deadline do not count; their questions become unanswered."""
    in_time = answers.join(deadlines, list(run)).where(F.col("ts") < F.col("deadline"))
    return fill_unanswered(questions, in_time, keys, "deadline")


def event_mix(events: DataFrame, keys: Sequence[str], types: Sequence[str], column: str = "type") -> DataFrame:
    """Counts per event type, one column each."""
    return events.groupBy(*keys).agg(*[F.count_if(F.col(column) == t).alias(f"n_{t}") for t in types])
