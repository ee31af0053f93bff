"""Structured Streaming twins: current state, budgeted memory, running scores, answers in time.

Each ``*_stream`` function turns a streaming frame into a streaming frame. ``run_to_table`` drives one
to the end of the available input and keeps every micro-batch under its own number, so a batch that is
replayed after a failure overwrites itself; ``latest`` reads the newest row per key back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engramlake.operators.memory import Store, memory_actions
from engramlake.session import shared_dir

MEMORY_ROW = "agent_id bigint, position bigint, topic string, content string, writes_used bigint"
MEMORY_STATE = "writes_used bigint, topics array<string>, contents array<string>"


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream; the number of files bounds a micro-batch."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def current_state_stream(changes: DataFrame, keys: Sequence[str], value: str = "new_val", seq: str = "seq") -> DataFrame:
    """Latest value per key as changes arrive, in whatever order."""
    return changes.groupBy(*keys).agg(
        F.max_by(value, seq).alias("value"), F.max(seq).alias("seq"), F.count(F.lit(1)).alias("n_seen")
    )


def running_scores_stream(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters per run, updated with every batch. ``steps``: keys, accepted, answered, correct."""
    return steps.groupBy(*keys).agg(
        F.count_if("accepted").alias("writes_used"), F.count_if("answered").alias("questions_answered"),
        F.count_if(F.col("answered") & F.col("correct")).alias("correct_count"), F.count(F.lit(1)).alias("n_steps"),
    )


def budgeted_memory_stream(ops: DataFrame, budget: int, *, free_replace: bool = False) -> DataFrame:
    """Fold memory operations per agent under the budget, keeping the entries as state.

    The state holds at most ``budget`` entries. Input must reach the stream in order per agent across
    batches; within a batch it is sorted here. Emits, per agent and batch, a marker row (position -1) and
    all current entries.
    """
    acts = memory_actions(ops)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, topics, contents = state.get if state.exists else (0, [], [])
        store = Store(list(zip(topics, contents)), used)
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            store.step(row, budget, free_replace)
        entries, used = store.entries(), store.used
        state.update((used, [t for t, _ in entries], [c for _, c in entries]))
        shown = [("", "")] + entries
        yield pd.DataFrame({
            "agent_id": [key[0]] * len(shown), "position": range(-1, len(entries)), "topic": [t for t, _ in shown],
            "content": [c for _, c in shown], "writes_used": [used] * len(shown),
        })

    return acts.groupBy("agent_id").applyInPandasWithState(
        fold, MEMORY_ROW, MEMORY_STATE, "update", GroupStateTimeout.NoTimeout
    )


def answers_in_time_stream(questions: DataFrame, answers: DataFrame, *, limit: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Each question with its answer if one came within ``limit``, else unanswered.

    ``questions``: question_id, asked_at. ``answers``: answer_id (the question's id), answered_at, correct. A
    question without an answer comes out by itself once the watermark has passed its limit; ``with_beats``
    moves the watermark where rows stop coming. Rows may come in any order up to ``late`` behind the newest
    row of the slower side; Spark leaves out and counts (numRowsDroppedByWatermark) what comes later still.
    Beats have no id and must reach the watermark of both sides, so no filter on the ids stands here, nor a
    plain equality, which would bring one: drop rows without question_id from what comes out.
    """
    q = questions.withWatermark("asked_at", late)
    a = answers.withWatermark("answered_at", late)
    in_time = F.expr(f"answer_id <=> question_id AND answered_at >= asked_at AND answered_at < asked_at + interval {limit}")
    return q.join(a, in_time, "left_outer").select(
        "question_id", "asked_at", "answered_at", F.coalesce("correct", F.lit(False)).alias("correct"),
        F.when(F.col("answer_id").isNull(), "wallclock:unanswered").otherwise("answered").alias("status"),
    )


def with_beats(stream: DataFrame, folder: str, time_col: str) -> DataFrame:
    """``stream`` and the beats written to ``folder``: rows of nulls but for ``time_col``, which tell how late it is."""
    beats = file_stream(stream.sparkSession, folder, "*.parquet", "beat timestamp")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema if f.name != time_col]
    return stream.unionByName(beats.select(F.col("beat").alias(time_col), *nothing))


def beat(spark: SparkSession, folder: str, at: str) -> None:
    """Tell the streams that read ``folder`` that it is ``at``: no row from before then is still to come."""
    spark.sql(f"SELECT TIMESTAMP '{at}' AS beat").coalesce(1).write.mode("append").parquet(folder)


def beat_folder(spark: SparkSession) -> str:
    """A new shared folder for beats, with no beat in it."""
    folder = shared_dir(spark, "stream-beats")
    spark.createDataFrame([], "beat timestamp").coalesce(1).write.parquet(folder)
    return folder


def run_to_table(stream: DataFrame, mode: str = "update", at_end: Callable[[], None] | None = None) -> DataFrame:
    """Process what is available and return all emitted rows with their batch number.

    ``at_end`` is called when the input is used up and may write more, such as a last beat; the
    same query then goes on from its checkpoint.
    """
    spark = stream.sparkSession
    out, checkpoint = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-checkpoint")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    def run() -> None:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(sink).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    if at_end is not None:
        at_end()
        run()
    schema = stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).parquet(out)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key's newest batch."""
    keys = list(keys)
    newest = rows.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, [*keys, "batch_id"], "left_semi").drop("batch_id")
