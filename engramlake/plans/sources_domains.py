"""Sources and sinks (A) on files Spark writes from the driver's tables, and the extension surface (L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators import grading as G
from engramlake.operators.domains import vectorised_judge
from engramlake.plans.conversations_rewards import trajectory
from engramlake.plans.fixtures import SQL, Tables, number_in
from engramlake.plans.grading_scoring import graded, run_info, scored_runs
from engramlake.plans.registry import query
from engramlake.session import shared_dir
from engramlake.sources import readers as A


def result_rows(t: Tables) -> DataFrame:
    """Scored runs in the shape of result files; runs of three suppliers' kinds are faulty."""
    runs = scored_runs(t).join(run_info(t), "run_id")
    extra = F.struct(
        "model", "template", F.col("run_id").alias("seed"), "n_entities", F.lit(20).alias("n_questions"), "write_budget",
        F.lit(7).alias("writes_used"), F.col("stored_count").alias("stored_entities"),
        F.when(F.col("model") != "N", F.struct("breadth", "maintenance", "reasoning", "efficiency", F.round("composite", 9).alias("composite"))).alias("per_axis"),
        F.create_map(F.lit("retrieval"), F.round("breadth", 9)).alias("by_competency"),
    )
    return runs.select(
        F.when(F.col("breadth") > 0, F.concat(F.lit("eval:"), "template")).alias("task_name"), F.round("reasoning", 9).alias("score"),
        F.lit(True).alias("success"), F.lit(1.5).alias("time_taken"), F.when(F.col("efficiency") == 0, "provider down").alias("error"),
        extra.alias("extra"),
    )


@query("read_eval_results", """
SELECT 'eval:' || s.template AS task_name, s.model, s.template, s.run_id AS seed, ROUND(reasoning, 9) AS score,
  CASE WHEN s.model <> 'N' THEN ROUND(composite, 9) ELSE ROUND(reasoning, 9) END AS composite,
  CASE WHEN n_entities <= 30 THEN 'lite' WHEN n_entities <= 60 THEN 'standard' ELSE 'hard' END AS tier, ROUND(breadth, 9) AS retrieval
FROM scored_run s JOIN run_info r ON r.run_id = s.run_id WHERE breadth > 0 AND efficiency > 0""")
def _(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "results")
    result_rows(t).write.json(path)
    d = A.read_eval_results(t.spark, path, multi_line=False)
    return d.select("task_name", "model", "template", "seed", "score", "composite", "tier", F.try_element_at("by_competency", F.lit("retrieval")).alias("retrieval"))


@query("read_trajectories", """
SELECT CASE kind WHEN 'signup' THEN 'system' ELSE 'event' END AS type, COUNT(*) AS n, 2 * COUNT(*) AS n_turns,
  CAST(SUM(CASE WHEN kind = 'error' THEN 0 WHEN value > 25 THEN 2 ELSE 1 END) AS BIGINT) AS n_calls
FROM traj GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "trajectories")
    trajectory(t).withColumn("conv_id", F.col("conv_id").cast("string")).write.json(path)
    d = A.read_trajectories(t.spark, path, multi_line=False)
    calls = F.aggregate("turns", F.lit(0), lambda a, x: a + F.size(x["tool_calls"]))
    return d.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("turns")).alias("n_turns"), F.sum(calls).alias("n_calls")
    )


@query("link_result_trajectory", """
SELECT 'run_' || s_suppkey AS file_key, s_acctbal AS score, s_acctbal > 5000 AS has_trajectory FROM supplier""")
def _(t: Tables) -> DataFrame:
    s = t.raw("supplier")
    key = F.concat(F.lit("run_"), "s_suppkey")
    results = s.select(A.file_key(F.concat(F.lit("/eval/"), key, F.lit(".json"))).alias("file_key"), F.col("s_acctbal").alias("score"))
    files = s.where("s_acctbal > 5000").select(A.file_key(F.concat(F.lit("/eval/"), key, F.lit("_trajectory.json"))).alias("file_key"))
    return A.link_result_trajectory(results, files)


def trace_lines(t: Tables) -> DataFrame:
    """Trace lines of every user, in event order; some broken, some with their data as JSON text."""
    e, p, k = F.col("event_type"), F.col("props"), number_in(F.col("props"))
    obj = (
        F.when(e == "signup", F.concat(F.lit('{"type": "tool.request", "data": {"tool": "memory", "args": {"action": "add", "content": '), p, F.lit("}}}")))
        .when(e == "purchase", F.concat(F.lit('{"type": "tool.result", "data": "{\\"result_summary\\": \\"r'), k, F.lit('\\"}"}')))
        .when((e == "click") & (k < 50), F.concat(F.lit('{"type": "message.done", "data": {"text": "<think>hm</think> said '), k, F.lit('"}}')))
        .when(e == "click", F.lit('{"type": "usage"}'))
        .when((e == "view") & (k < 5), F.concat(F.lit('{"type": "error", "data": {"message": "e'), k, F.lit('"}}')))
        .when((e == "view") & (k < 10), F.lit('{"type": "turn.end", "data": {"reason": "max_turns"}}'))
        .when(e == "view", F.lit('{"type": "turn.end", "data": {"reason": "completed"}}'))
        .otherwise(F.lit('{"type": "tool.req'))
    )
    return t.raw("events").select("user_id", "event_id", obj.alias("value"))


SQL["trace_line"] = """
SELECT user_id, event_id, event_type AS e, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events
"""


@query("read_agent_trace", """
SELECT user_id AS trace, n_req AS n_tool_calls, n_req AS n_writes, n_res AS n_results,
  CASE WHEN n_use = 0 AND (n_req > 0 OR t IS NOT NULL) THEN 1 ELSE n_use END AS api_calls, COALESCE(t, '') AS final_text, err AS error, stop AS stop_reason
FROM (SELECT user_id, COUNT(*) FILTER (WHERE e = 'signup') AS n_req, COUNT(*) FILTER (WHERE e = 'purchase') AS n_res, COUNT(*) FILTER (WHERE e = 'click' AND k >= 50) AS n_use,
  arg_max('said ' || k, event_id) FILTER (WHERE e = 'click' AND k < 50) AS t, arg_max('e' || k, event_id) FILTER (WHERE e = 'view' AND k < 5) AS err,
  MAX('max_turns') FILTER (WHERE e = 'view' AND k >= 5 AND k < 10) AS stop FROM trace_line GROUP BY user_id HAVING COUNT(*) FILTER (WHERE e <> 'error') > 0) x""")
def _(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "traces")
    lines = trace_lines(t).repartition("user_id").sortWithinPartitions("user_id", "event_id")
    mark = F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit("\t"))
    marked = F.concat(mark, F.regexp_replace("value", F.lit(r"(\r\n|\r|\n)"), F.concat(F.lit("$1"), mark)))
    lines.select(marked.alias("value")).where("value is not null").write.text(path)
    d = A.rollup_trace(A.read_agent_trace(t.spark, path, ["trace"], sep="\t"), ["trace"])
    return d.withColumn("trace", F.col("trace").cast("bigint"))


@query("parse_training_logs", """
SELECT * FROM (
SELECT 'episode' AS kind, CAST(NULL AS DOUBLE) AS loss, CAST(o_custkey % 50 AS BIGINT) AS step, o_orderstatus AS template, o_orderkey AS seed, 0.25::DOUBLE AS reward, CAST(3 AS BIGINT) AS correct, CAST(NULL AS DOUBLE) AS mean_reward, COUNT(*) AS n
FROM orders GROUP BY ALL
UNION ALL SELECT 'step', CAST(-0.5 AS DOUBLE), c_custkey, NULL, NULL, NULL, NULL, 0.125, COUNT(*) FROM customer GROUP BY ALL
UNION ALL SELECT 'metric', CAST(s_suppkey AS DOUBLE), NULL, NULL, NULL, NULL, NULL, NULL, COUNT(*) FROM supplier GROUP BY ALL) x""")
def _(t: Tables) -> DataFrame:
    line = F.format_string(
        "[%d/50] G1S2 %s(s=%d): r=0.25 (ok) correct=3/10 writes=4 msgs=9", F.col("o_custkey") % 50, F.col("o_orderstatus"), F.col("o_orderkey")
    )
    step = F.format_string("Step %d: loss=-0.5 mean_r=0.125", F.col("c_custkey"))
    metric = F.format_string("{'loss': '%d', 'grad_norm': '1.5', 'learning_rate': '1e-05', 'epoch': '0.5'}", F.col("s_suppkey"))
    lines = (
        t.raw("orders").select(line.alias("value"))
        .unionByName(t.raw("customer").select(step.alias("value")))
        .unionByName(t.raw("supplier").select(metric.alias("value")))
        .unionByName(t.raw("documents").select(F.translate("text", "\n", " ").alias("value")))
    )
    path = shared_dir(t.spark, "logs")
    lines.write.text(path)
    d = A.parse_training_logs(t.spark.read.text(path))
    return d.groupBy("kind", "loss", "step", "template", "seed", "reward", "correct", "mean_reward").agg(F.count(F.lit(1)).alias("n"))


@query("read_memory_snapshot", r"""
SELECT source AS agent, lang || CAST(doc_id AS VARCHAR) AS topic, CAST(p.i AS INT) AS position,
       md5(CASE p.i WHEN 0 THEN body ELSE 'second of ' || doc_id END) AS content_md5
FROM (SELECT *, regexp_replace(replace(text, '§', '%'), '^\s+|\s+$', '', 'g') AS body FROM documents) d JOIN (VALUES (0), (1)) p(i) ON TRUE""")
def _(t: Tables) -> DataFrame:
    # the mark that parts entries may not stand inside one
    d = t.raw("documents").withColumn("text", F.translate("text", "§", "%"))
    body = F.concat(F.lit("[2024-01-02T03:04:05Z]\n"), "text", F.lit(A.MEMORY_DELIMITER), F.lit(" second of "), "doc_id", F.lit("\n"))
    files = d.select(F.col("source").alias("agent"), A.normal_topic(F.concat(F.upper("lang"), F.lit(" "), "doc_id")).alias("topic"), body.alias("value"))
    out = A.snapshot_entries(files, ["agent", "topic"])
    return out.select("agent", "topic", "position", F.md5("content").alias("content_md5"))


SQL["chat"] = """
SELECT conv_id, CASE WHEN COUNT(*) FILTER (WHERE role = 'system') > 0 THEN 'guided' ELSE 'plain' END AS template, COUNT(*) AS n FROM message GROUP BY conv_id
"""


@query("dataset_stats", """
SELECT template, COUNT(*) AS trajectories, CAST(SUM(n) AS BIGINT) AS total_messages, ROUND(AVG(n), 9) AS avg_messages FROM chat GROUP BY template""")
def _(t: Tables) -> DataFrame:
    guided = F.exists("messages", lambda m: m["role"] == "system")
    records = A.chat_records(t.message, ["conv_id"]).withColumn("template", F.when(guided, "guided").otherwise("plain"))
    path = shared_dir(t.spark, "chat")
    A.write_chat_dataset(records, path)
    return A.dataset_stats(A.read_chat_dataset(t.spark, path)).withColumn("avg_messages", F.round("avg_messages", 9))


@query("pending_evaluations", """
SELECT m.model, v.template, s.seed FROM (SELECT s_name AS model, s_suppkey FROM supplier) m
CROSS JOIN (VALUES ('O'), ('F'), ('P')) v(template) CROSS JOIN (SELECT unnest(range(10)) AS seed) s
WHERE NOT EXISTS (SELECT 1 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  WHERE l.l_suppkey = m.s_suppkey AND o.o_orderstatus = v.template AND l.l_linenumber = s.seed AND l.l_quantity > 45)""")
def _(t: Tables) -> DataFrame:
    s = t.raw("supplier").select("s_suppkey", F.col("s_name").alias("model"))
    done = t.raw("lineitem").where("l_quantity > 45").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    done = done.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "model", F.col("o_orderstatus").alias("template"), F.col("l_linenumber").alias("seed")
    )
    return A.pending_evaluations(t.spark, s, ["O", "F", "P"], 10, done)


def _lenient(question: str, truth: str, answer: str, competency: str) -> tuple[bool, str]:
    if "K" in answer:
        raise ValueError("suffix")
    return truth in answer, "contains" if truth in answer else "differs"


@query("judge_pending", """
SELECT competency, reason, COUNT(*) AS n, COUNT(*) FILTER (WHERE correct) AS n_correct FROM (
  SELECT competency, CASE WHEN reason <> 'rule:fail' THEN correct ELSE NOT contains(answer, 'K') AND contains(answer, truth) END AS correct,
    CASE WHEN reason <> 'rule:fail' THEN reason WHEN contains(answer, 'K') THEN 'judge:failed(suffix)' WHEN contains(answer, truth) THEN 'judge:contains' ELSE 'judge:differs' END AS reason
  FROM graded) x GROUP BY competency, reason""")
def _(t: Tables) -> DataFrame:
    g = graded(t).withColumn("question", F.col("question_id").cast("string"))
    return G.grading_audit(G.judge_pending(g, vectorised_judge(_lenient)), ["competency"])
