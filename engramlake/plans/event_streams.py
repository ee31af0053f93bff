"""Event streams in batch form (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators import events as K
from engramlake.plans.fixtures import SQL, Tables
from engramlake.plans.grading_scoring import graded
from engramlake.plans.registry import query

BATCH = 10

SQL["batched"] = f"""
SELECT world_id, entity, arrival, CAST((rn - 1) // {BATCH} AS BIGINT) AS batch, CAST(GREATEST(1, n // {BATCH}) AS BIGINT) AS n_batches,
       CAST(LEAST(((rn - 1) // {BATCH} + 1) * {BATCH}, n) AS BIGINT) AS entities_seen
FROM (SELECT c_nationkey AS world_id, c_name AS entity, c_custkey AS arrival, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn,
        COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) x WHERE (rn - 1) // {BATCH} < GREATEST(1, n // {BATCH})
"""


def batched(t: Tables, keep_tail: bool = False) -> DataFrame:
    e = t.raw("customer").select(F.col("c_nationkey").alias("world_id"), F.col("c_name").alias("entity"), F.col("c_custkey").alias("arrival"))
    return K.assign_batches(e, ["world_id"], "arrival", BATCH, keep_tail=keep_tail)


@query("assign_batches", f"""
SELECT world_id, entity, arrival, (rn - 1) // {BATCH} AS batch, (n + {BATCH} - 1) // {BATCH} AS n_batches, LEAST(((rn - 1) // {BATCH} + 1) * {BATCH}, n) AS entities_seen
FROM (SELECT c_nationkey AS world_id, c_name AS entity, c_custkey AS arrival, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn,
        COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) x""")
def _(t: Tables) -> DataFrame:
    return batched(t, keep_tail=True)


@query("assign_batches_floor", "SELECT world_id, entity, arrival, batch, n_batches, entities_seen FROM batched")
def _(t: Tables) -> DataFrame:
    return batched(t)


SQL["world_plan"] = """
SELECT world_id, n_batches, LEAST(n_batches - 1, GREATEST(0, CAST(FLOOR(n_batches * 0.5) AS BIGINT))) AS corr_batch,
  CASE WHEN n_batches > 1 THEN LEAST(n_batches - 1, GREATEST(LEAST(n_batches - 1, GREATEST(0, CAST(FLOOR(n_batches * 0.5) AS BIGINT))) + 1, CAST(FLOOR(n_batches * 0.75) AS BIGINT))) ELSE 0 END AS contra_batch
FROM (SELECT world_id, MAX(n_batches) AS n_batches FROM batched GROUP BY world_id) b
"""
SQL["world_batch"] = "SELECT world_id, n_batches, unnest(range(n_batches)) AS batch FROM world_plan"
SQL["asked_q"] = "SELECT s_nationkey AS world_id, s_suppkey AS seq FROM supplier"
SQL["fix"] = "SELECT c_nationkey AS world_id, c_custkey AS seq FROM customer WHERE c_acctbal < 0"
SQL["contra"] = "SELECT c_nationkey AS world_id, c_custkey AS seq FROM customer WHERE c_acctbal > 9700"
SQL["event_list"] = """
SELECT *, ROW_NUMBER() OVER (PARTITION BY world_id ORDER BY batch, phase, seq) - 1 AS event_idx FROM (
  SELECT world_id, batch, 1 AS phase, CAST(0 AS BIGINT) AS seq, 'ingest' AS type FROM world_batch
  UNION ALL SELECT world_id, batch, 0, 0, 'noise' FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY world_id ORDER BY substr(md5(CAST(batch AS VARCHAR)), 1, 2), batch) AS r
      FROM world_batch WHERE batch >= 1 AND n_batches > 2) n WHERE r <= GREATEST(1, n_batches // 3)
  UNION ALL SELECT f.world_id, p.corr_batch, 2, f.seq, 'correction' FROM fix f JOIN world_plan p ON p.world_id = f.world_id
  UNION ALL SELECT f.world_id, p.contra_batch, 3, f.seq, 'contradiction' FROM contra f JOIN world_plan p ON p.world_id = f.world_id
  UNION ALL SELECT q.world_id, COALESCE(d.batch, p.n_batches), 4, q.seq, 'question'
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY world_id ORDER BY seq) AS nth FROM asked_q) q JOIN world_plan p ON p.world_id = q.world_id
    LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY world_id ORDER BY batch) AS nth FROM (
        SELECT b.*, ROW_NUMBER() OVER (PARTITION BY b.world_id ORDER BY substr(md5(CAST(batch AS VARCHAR)), 1, 2), batch) AS r, GREATEST(1, CAST(FLOOR(nq * 0.4) AS BIGINT)) AS mid
        FROM world_batch b JOIN (SELECT world_id, COUNT(*) AS nq FROM asked_q GROUP BY world_id) c ON c.world_id = b.world_id WHERE batch >= 2 AND n_batches > 2) x WHERE r <= mid) d
      ON d.world_id = q.world_id AND d.nth = q.nth) u
"""


def event_list(t: Tables) -> DataFrame:
    c = t.raw("customer").select(F.col("c_nationkey").alias("world_id"), F.col("c_custkey").alias("seq"), "c_acctbal")
    worlds = batched(t).groupBy("world_id").agg(F.max("n_batches").alias("n_batches")).select(
        "*", F.lit(0.5).alias("corr_frac"), F.lit(0.75).alias("contra_frac")
    )
    q = t.raw("supplier").select(F.col("s_nationkey").alias("world_id"), F.col("s_suppkey").alias("seq"))
    return K.interleave_events(
        worlds, c.where("c_acctbal < 0").drop("c_acctbal"), c.where("c_acctbal > 9700").drop("c_acctbal"), q, ["world_id"]
    )


@query("interleave_events", "SELECT world_id, batch, phase, seq, type, event_idx FROM event_list")
def _(t: Tables) -> DataFrame:
    return event_list(t)


SQL["session_event"] = """
SELECT e.user_id AS run_id, e.event_id AS seq, e.event_type, e.idx AS event_idx,
  CASE WHEN n < 3 THEN 0 ELSE CAST(idx >= b1 AS BIGINT) + CASE WHEN b2 <> b1 THEN CAST(idx >= b2 AS BIGINT) ELSE 0 END END AS session
FROM (SELECT *, GREATEST(1, CAST(FLOOR(1 * (n / 3.0::DOUBLE)) AS BIGINT)) AS b1, GREATEST(1, CAST(FLOOR(2 * (n / 3.0::DOUBLE)) AS BIGINT)) AS b2 FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events) a) e
"""


def session_events(t: Tables) -> DataFrame:
    e = t.raw("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type", "props")
    e = K.running_sum(e, ["run_id"], "seq", {"event_idx": F.lit(1)}, inclusive=False)
    return K.split_sessions(e, ["run_id"], 3)


@query("split_sessions", "SELECT run_id, seq, event_idx, CAST(session AS BIGINT) AS session FROM session_event")
def _(t: Tables) -> DataFrame:
    return session_events(t).select("run_id", "seq", F.col("event_idx").cast("bigint").alias("event_idx"), "session")


_ENT = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"


@query("cross_session_updates", f"""
WITH s AS (SELECT x.*, {_ENT} AS entity FROM session_event x JOIN events e ON e.event_id = x.seq),
f AS (SELECT run_id, entity, MIN(event_idx) AS ingest_idx, arg_min(session, event_idx) AS ingest_session FROM s WHERE event_type <> 'purchase' GROUP BY run_id, entity)
SELECT s.run_id, s.entity, s.event_idx, CAST(s.session AS BIGINT) AS session, f.ingest_idx, CAST(f.ingest_session AS BIGINT) AS ingest_session
FROM s JOIN f ON f.run_id = s.run_id AND f.entity = s.entity WHERE s.event_type = 'purchase' AND s.session <> f.ingest_session""")
def _(t: Tables) -> DataFrame:
    e = session_events(t).select(
        "run_id", F.col("event_idx").cast("bigint").alias("event_idx"), "session", F.expr(_ENT).alias("entity"),
        F.when(F.col("event_type") == "purchase", "correction").otherwise("ingest").alias("type"),
    )
    return K.cross_session_updates(e, ["run_id"])


@query("answers_before_deadline", """
SELECT step, reason, COUNT(*) AS n, COUNT(*) FILTER (WHERE correct) AS n_correct FROM (
  SELECT o.o_custkey % 50 AS step, COALESCE(a.correct, FALSE) AS correct, COALESCE(a.reason, 'wallclock:unanswered_after_timeout(deadline)') AS reason
  FROM orders o LEFT JOIN (SELECT g.question_id, g.correct, g.reason FROM (
      SELECT question_id, BOOL_OR(correct) AS correct, MIN(reason) AS reason FROM graded GROUP BY question_id) g
      JOIN orders p ON p.o_orderkey = g.question_id WHERE p.o_orderdate < TIMESTAMP '1998-06-01' + to_days(CAST(p.o_custkey % 50 AS INT))) a
    ON a.question_id = o.o_orderkey) x GROUP BY step, reason""")
def _(t: Tables) -> DataFrame:
    o = t.raw("orders").select((F.col("o_custkey") % 50).alias("step"), F.col("o_orderkey").alias("question_id"), F.col("o_orderdate").alias("ts"))
    verdicts = graded(t).groupBy("question_id").agg(
        F.bool_or("correct").alias("correct"), F.min("reason").alias("reason"), F.max("answer").alias("answer")
    )
    answers = verdicts.join(o, "question_id")
    deadlines = o.select("step").distinct().withColumn(
        "deadline", F.expr("timestamp_ntz '1998-06-01' + make_interval(0, 0, 0, cast(step as int))")
    )
    d = K.answers_before_deadline(o.drop("ts"), answers, deadlines, ["step", "question_id"], ["step"])
    return d.groupBy("step", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))


# few corrections and few ingests, so that many streams have no break between the two
_RARE = "CASE WHEN event_type = 'purchase' AND k >= 90 THEN 'correction' WHEN event_type = 'signup' THEN 'ingest' ELSE 'noise' END"


@query("split_sessions_crossing", f"""
WITH a AS (SELECT *, {_RARE} AS type FROM (
  SELECT user_id AS run_id, event_id AS seq, event_type, {_ENT} AS k, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
         COUNT(*) OVER (PARTITION BY user_id) AS n FROM events) e),
b AS (SELECT DISTINCT run_id, GREATEST(1, CAST(FLOOR(1 * (n / 3.0::DOUBLE)) AS BIGINT)) AS b1,
        GREATEST(1, CAST(FLOOR(2 * (n / 3.0::DOUBLE)) AS BIGINT)) AS b2 FROM a WHERE n >= 3),
p AS (SELECT c.run_id, c.i AS fix, f.start FROM a c
      JOIN (SELECT run_id, k % 50 AS entity, MIN(i) AS start FROM a WHERE type = 'ingest' GROUP BY 1, 2) f
        ON f.run_id = c.run_id AND f.entity = c.k % 50 WHERE c.type = 'correction'),
m AS (SELECT b.run_id, BOOL_OR((start < b1 AND b1 <= fix) OR (start < b2 AND b2 <= fix) OR (fix < b1 AND b1 <= start) OR (fix < b2 AND b2 <= start)) AS parted,
        MIN(fix) FILTER (WHERE start < fix) AS fix, arg_min(start, fix) FILTER (WHERE start < fix) AS start
      FROM b JOIN p ON p.run_id = b.run_id GROUP BY b.run_id),
s AS (SELECT b.run_id, CASE WHEN NOT m.parted AND m.fix IS NOT NULL THEN (m.start + m.fix) // 2 + 1 ELSE b1 END AS b1, b2
      FROM b LEFT JOIN m ON m.run_id = b.run_id)
SELECT a.run_id, a.seq, a.i AS event_idx, COALESCE(CAST(a.i >= s.b1 AS BIGINT) + CAST(a.i >= s.b2 AS BIGINT), 0) AS session
FROM a LEFT JOIN s ON s.run_id = a.run_id""")
def _(t: Tables) -> DataFrame:
    e = t.raw("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type", F.expr(_ENT).alias("k"))
    e = e.select("run_id", "seq", F.expr(_RARE).alias("type"), (F.col("k") % 50).alias("entity"))
    e = K.running_sum(e, ["run_id"], "seq", {"event_idx": F.lit(1)}, inclusive=False)
    return K.split_sessions(e, ["run_id"], 3, entity="entity").select(
        "run_id", "seq", F.col("event_idx").cast("bigint").alias("event_idx"), "session"
    )


_TYPES = ["ingest", "noise", "correction", "contradiction", "question"]


@query("event_mix", "SELECT world_id, " + ", ".join(f"COUNT(*) FILTER (WHERE type = '{x}') AS n_{x}" for x in _TYPES) + " FROM event_list GROUP BY world_id")
def _(t: Tables) -> DataFrame:
    return K.event_mix(event_list(t), ["world_id"], _TYPES)
