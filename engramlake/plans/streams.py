"""Streaming twins (K5-K8) driven over the driver's files until the input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.plans.fixtures import Tables, number_in
from engramlake.plans.memory import BUDGET, replay_sql
from engramlake.plans.registry import query
from engramlake.streaming import jobs as S

# Longer than the events' span, and a time that far behind all of them.
REPLAY = "36500 days"
LAST_BEAT = "2400-01-01 00:00:00"


def events(t: Tables) -> DataFrame:
    return S.file_stream(t.spark, t.sf_dir, "events.parquet", t.raw("events").schema)


@query("stream_current_state", """
SELECT user_id AS entity, event_type AS attr, arg_max(value, event_id) AS value, MAX(event_id) AS seq, COUNT(*) AS n_seen FROM events GROUP BY user_id, event_type""")
def _(t: Tables) -> DataFrame:
    changes = events(t).select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("attr"), F.col("event_id").alias("seq"), F.col("value").alias("new_val")
    )
    keys = ["entity", "attr"]
    return S.latest(S.run_to_table(S.current_state_stream(changes, keys)), keys)


@query("stream_running_scores", """
SELECT user_id AS run_id, COUNT(*) FILTER (WHERE event_type = 'signup') AS writes_used, COUNT(*) FILTER (WHERE event_type = 'view') AS questions_answered,
  COUNT(*) FILTER (WHERE event_type = 'view' AND CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) > 40) AS correct_count, COUNT(*) AS n_steps
FROM events GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    e = F.col("event_type")
    steps = events(t).select(
        F.col("user_id").alias("run_id"), (e == "signup").alias("accepted"), (e == "view").alias("answered"),
        (number_in(F.col("props")) > 40).alias("correct"),
    )
    return S.latest(S.run_to_table(S.running_scores_stream(steps, ["run_id"])), ["run_id"])


@query("stream_budgeted_memory", replay_sql("TRUE", "FALSE"))
def _(t: Tables) -> DataFrame:
    kind, k = F.col("event_type"), number_in(F.col("props"))
    item = F.concat(F.lit("item "), k)
    ops = events(t).select(
        F.col("user_id").alias("agent_id"), F.col("event_id").alias("seq"),
        F.when(kind.isin("signup", "error"), "add").when(kind == "purchase", "replace").when(kind == "click", "remove")
        .otherwise("search").alias("action"),
        F.concat(F.lit("t"), k % 3).alias("topic"),
        F.when(kind == "purchase", F.concat(F.lit("changed "), item)).otherwise(item).alias("content"),
        item.alias("old_text"), (kind != "error").alias("ok"),
    )
    rows = S.latest(S.run_to_table(S.budgeted_memory_stream(ops, BUDGET)), ["agent_id"])
    return rows.where(F.col("position") >= 0)


@query("stream_answers_in_time", """
SELECT q.event_id AS question_id, epoch_us(CAST(q.ts AS TIMESTAMP)) AS asked_us, epoch_us(a.answered_at) AS answered_us,
  COALESCE(a.correct, FALSE) AS correct, CASE WHEN a.answer_id IS NULL THEN 'wallclock:unanswered' ELSE 'answered' END AS status
FROM events q LEFT JOIN (
  SELECT event_id AS answer_id, CAST(ts AS TIMESTAMP) + to_minutes(k) AS answered_at, k % 2 = 0 AS correct
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events WHERE event_type = 'view') e WHERE k > 30) a
ON a.answer_id = q.event_id AND a.answered_at >= CAST(q.ts AS TIMESTAMP) AND a.answered_at < CAST(q.ts AS TIMESTAMP) + INTERVAL 1 HOUR
WHERE q.event_type = 'view'""")
def _(t: Tables) -> DataFrame:
    e, k = F.col("event_type"), number_in(F.col("props"))
    folder = S.beat_folder(t.spark)
    q = events(t).where(e == "view").select(F.col("event_id").alias("question_id"), F.col("ts").cast("timestamp").alias("asked_at"))
    a = events(t).where((e == "view") & (k > 30)).select(
        F.col("event_id").alias("answer_id"), (F.col("ts").cast("timestamp") + F.make_interval(mins=k)).alias("answered_at"), (k % 2 == 0).alias("correct")
    )
    # a replay of files in any order: nothing is late before the last beat
    stream = S.answers_in_time_stream(S.with_beats(q, folder, "asked_at"), S.with_beats(a, folder, "answered_at"), late=REPLAY)
    d = S.run_to_table(stream, "append", at_end=lambda: S.beat(t.spark, folder, LAST_BEAT)).where("question_id is not null")
    return d.select("question_id", F.unix_micros("asked_at").alias("asked_us"), F.unix_micros("answered_at").alias("answered_us"), "correct", "status")
