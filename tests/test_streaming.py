import random

from pyspark.sql import functions as F

from engramlake.operators import memory as M
from engramlake.streaming import jobs as S
from tests.test_memory import SCHEMA, make_ops


def as_files(spark, rows, schema, path, n=4):
    step = (len(rows) + n - 1) // n
    for i in range(n):
        spark.createDataFrame(rows[i * step:(i + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(path))
    return S.file_stream(spark, str(path), "*.parquet", spark.read.parquet(str(path)).schema, files_per_batch=1)


def test_current_state_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(1, 5), i, rng.random()) for i in range(200)]
    stream = as_files(spark, rows, "k int, seq int, new_val double", tmp_path / "in")
    out = S.run_to_table(S.current_state_stream(stream, ["k"]))
    assert out.select("batch_id").distinct().count() > 1
    want = {k: (max((s, v) for kk, s, v in rows if kk == k)[1], sum(kk == k for kk, _, _ in rows)) for k in {r[0] for r in rows}}
    assert {r.k: (r.value, r.n_seen) for r in S.latest(out, ["k"]).collect()} == want


def test_budgeted_memory_equals_replay(spark, tmp_path):
    ops = make_ops(400, 11)
    stream = as_files(spark, ops, SCHEMA, tmp_path / "in")
    rows = S.latest(S.run_to_table(S.budgeted_memory_stream(stream, 20)), ["agent_id"]).where("position >= 0")
    cols = ["agent_id", "position", "topic", "content", "writes_used"]
    want = M.replay_memory(spark.createDataFrame(ops, SCHEMA), 20).select(cols)
    assert sorted(map(tuple, rows.select(cols).collect())) == sorted(map(tuple, want.collect()))


def test_running_scores(spark, tmp_path):
    rows = [(i % 2, i % 3 == 0, i % 5 == 0, i % 10 == 0) for i in range(60)]
    stream = as_files(spark, rows, "run int, accepted boolean, answered boolean, correct boolean", tmp_path / "in")
    got = {r.run: (r.writes_used, r.questions_answered, r.correct_count, r.n_steps) for r in S.latest(S.run_to_table(S.running_scores_stream(stream, ["run"])), ["run"]).collect()}
    want = {k: (sum(r[1] for r in rows if r[0] == k), sum(r[2] for r in rows if r[0] == k), sum(r[2] and r[3] for r in rows if r[0] == k), 30) for k in (0, 1)}
    assert got == want


def test_answers_in_time(spark, tmp_path):
    def ts(minute):
        return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"

    q = [(i, ts(i * 10)) for i in range(60)]
    a = [(i, ts(i * 10 + (5 if i % 2 else 75)), True) for i in range(0, 60, 1) if i % 3]
    qs = as_files(spark, q, "question_id int, t string", tmp_path / "q").select("question_id", F.to_timestamp("t").alias("asked_at"))
    an = as_files(spark, a, "answer_id int, t string, correct boolean", tmp_path / "a").select("answer_id", F.to_timestamp("t").alias("answered_at"), "correct")
    rows = {r.question_id: r.status for r in S.run_to_table(S.answers_in_time_stream(qs, an), "append").collect()}
    in_time = {i for i in range(60) if i % 3 and i % 2}
    assert all((s == "answered") == (i in in_time) for i, s in rows.items())
    assert in_time <= set(rows) and any(s != "answered" for s in rows.values())


def test_beats_complete_the_answers_whatever_the_order_of_files(spark, tmp_path):
    def ts(minute):
        return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"

    q = [(i, ts(i * 10)) for i in range(60)]
    a = [(i, ts(i * 10 + (5 if i % 2 else 75)), True) for i in range(60) if i % 3]
    in_time = {i for i in range(60) if i % 3 and i % 2}
    random.Random(2).shuffle(q)
    a.reverse()
    qs = as_files(spark, q, "question_id int, t string", tmp_path / "q").select("question_id", F.to_timestamp("t").alias("asked_at"))
    an = as_files(spark, a, "answer_id int, t string, correct boolean", tmp_path / "a", 2).select("answer_id", F.to_timestamp("t").alias("answered_at"), "correct")
    folder = S.beat_folder(spark)
    stream = S.answers_in_time_stream(S.with_beats(qs, folder, "asked_at"), S.with_beats(an, folder, "answered_at"), late="3650 days")
    rows = S.run_to_table(stream, "append", at_end=lambda: S.beat(spark, folder, "2100-01-01 00:00:00")).where("question_id is not null").collect()
    assert sorted((r.question_id, r.status == "answered", r.correct) for r in rows) == [(i, i in in_time, i in in_time) for i in range(60)]
