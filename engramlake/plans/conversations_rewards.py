"""Trajectories and conversations (I) and reward analytics (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators import convo as I
from engramlake.operators import rewards as J

from engramlake.plans.fixtures import SQL, Tables, number_in
from engramlake.plans.grading_scoring import graded, scored_runs
from engramlake.plans.registry import query
from engramlake.session import spread

# Every user is a conversation, every event of the user one logged trajectory event.
SQL["traj"] = """
SELECT user_id AS conv_id, event_id AS event_idx, event_type AS kind, props, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'error' THEN 0 WHEN value > 25 THEN 2 ELSE 1 END AS n_calls
FROM events
"""


def trajectory(t: Tables) -> DataFrame:
    e = t.raw("events")
    kind, k = F.col("event_type"), number_in(F.col("props"))
    call = lambda name, args: F.struct(F.lit(name).alias("name"), args.alias("arguments"))
    calls = (
        F.when(kind == "error", F.array().cast("array<struct<name: string, arguments: string>>"))
        .when(F.col("value") > 25, F.array(call("memory_search", F.col("props")), call("Edit", F.col("props"))))
        .otherwise(F.array(call("Write", F.col("props"))))
    )
    done = F.concat(F.lit("[tool] done "), k)
    results = (
        F.when(kind == "error", F.array().cast("array<string>"))
        .when(kind == "click", F.concat(F.transform(calls, lambda c: done), F.array(F.lit(" extra "))))
        .otherwise(F.transform(calls, lambda c: done))
    )
    said = F.when(kind.isin("view", "error"), "").otherwise(F.concat(F.lit("thinking "), k))
    turn = F.struct(F.lit("assistant").alias("role"), said.alias("content"), calls.alias("tool_calls"), results.alias("tool_results"))
    echo = F.struct(
        F.lit("user").alias("role"), F.lit("echo").alias("content"),
        F.array().cast("array<struct<name: string, arguments: string>>").alias("tool_calls"), F.array().cast("array<string>").alias("tool_results"),
    )
    return e.select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("event_idx"),
        F.when(kind == "signup", "system").otherwise("event").alias("type"),
        F.when(kind == "purchase", "").otherwise(F.col("props")).alias("content"), F.array(turn, echo).alias("turns"),
    )


@query("trajectory_to_messages", """
WITH base AS (SELECT *, COALESCE(SUM(n_calls) OVER (PARTITION BY conv_id ORDER BY event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM traj)
SELECT conv_id, event_idx, -1 AS turn_idx, 0 AS part, 0 AS item, CASE kind WHEN 'signup' THEN 'system' ELSE 'user' END AS role,
       props AS content, CAST(NULL AS VARCHAR) AS tool_call_id, CAST(NULL AS VARCHAR) AS name, 0 AS n_calls FROM base WHERE kind <> 'purchase'
UNION ALL SELECT conv_id, event_idx, 0, 1, 0, 'assistant', CASE WHEN kind = 'view' THEN '' ELSE 'thinking ' || k END,
       CASE n_calls WHEN 2 THEN 'call_' || b || ',call_' || (b + 1) ELSE 'call_' || b END,
       CASE n_calls WHEN 2 THEN 'memory_search,Edit' ELSE 'Write' END, n_calls FROM base WHERE kind NOT IN ('signup', 'error')
UNION ALL SELECT conv_id, event_idx, 0, 2, i.i, 'tool', CASE WHEN i.i < n_calls THEN 'done ' || k ELSE 'extra' END,
       CASE WHEN i.i < n_calls THEN 'call_' || (b + i.i) END,
       CASE WHEN i.i < n_calls THEN CASE WHEN n_calls = 1 THEN 'Write' WHEN i.i = 0 THEN 'memory_search' ELSE 'Edit' END END, 0
FROM base JOIN (VALUES (0), (1), (2)) i(i) ON i.i < n_calls + CASE kind WHEN 'click' THEN 1 ELSE 0 END WHERE kind NOT IN ('signup', 'error')""")
def _(t: Tables) -> DataFrame:
    return I.trajectory_to_messages(trajectory(t))


@query("clean_messages", r"""
SELECT conv_id, turn, md5(strip(replace(replace(replace(regexp_replace(raw, '(?s)<think>.*?</think>\s*', '', 'g'), '<|im_end|>', ''), '<|endoftext|>', ''), '<|im_start|>', ''))) AS text_md5
FROM (SELECT conv_id, turn, '<|im_start|>' || '<think>' || text || '</think> ' || chr(10) || text || '<think>x</think>' || '<|im_end|>' AS raw FROM message) m""")
def _(t: Tables) -> DataFrame:
    raw = F.concat(
        F.lit("<|im_start|><think>"), "text", F.lit("</think> \n"), "text", F.lit("<think>x</think><|im_end|>")
    )
    d = I.clean_messages(t.message.withColumn("text", raw))
    return d.select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query("extract_tool_calls", """
SELECT event_id, i.i AS call_idx, CASE event_type WHEN 'signup' THEN 'Write' WHEN 'purchase' THEN 'Edit' WHEN 'click' THEN 'memory_search'
         ELSE CASE i.i WHEN 0 THEN 'Read' ELSE 'memory_get' END END AS tool,
       CASE WHEN event_type = 'view' AND i.i = 1 THEN '{}' ELSE replace(props, ' ', '') END AS arguments
FROM events JOIN (VALUES (0), (1)) i(i) ON i.i = 0 OR event_type = 'view' WHERE event_type <> 'error'""")
def _(t: Tables) -> DataFrame:
    e, p = F.col("event_type"), F.col("props")
    call = lambda name: F.concat(F.lit(f'{{"name": "{name}", "arguments": '), p, F.lit("}"))
    broken = F.concat(F.lit('{"name": "Read", "arguments": '), p)  # last brace missing
    text = (
        F.when(e == "signup", F.concat(F.lit("I will store.\n<tool_call>"), call("Write"), F.lit("</tool_call>")))
        .when(e == "error", F.concat(F.lit("<tool_call>"), call("Fly"), F.lit("</tool_call>")))
        .when(e == "purchase", F.concat(F.lit("```json\n"), call("Edit"), F.lit("\n```")))
        .when(e == "click", F.concat(F.lit("so: "), call("memory_search"), F.lit(" done")))
        .otherwise(F.concat(
            F.lit("<function_call>"), broken, F.lit('</function_call> and <tool_call>{"name": "memory_get"}</tool_call>'), call("Write")
        ))
    )
    e = spread(t.raw("events").select("event_id", "event_type", "props"))
    return I.extract_tool_calls(e.select("event_id", text.alias("text")), ["event_id"])


@query("merge_same_role", """
SELECT agent_id, CAST(island AS BIGINT) AS message_idx, role, COUNT(*) AS n_merged, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq) AS text
FROM (SELECT *, SUM(CASE WHEN role = prev THEN 0 ELSE 1 END) OVER (PARTITION BY agent_id ORDER BY seq) AS island FROM (
        SELECT user_id AS agent_id, event_id AS seq, event_type AS role, props AS text, LAG(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) a) b
GROUP BY agent_id, island, role""")
def _(t: Tables) -> DataFrame:
    m = t.raw("events").select(
        F.col("user_id").alias("agent_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("role"), F.col("props").alias("text")
    )
    return I.merge_same_role(m, "agent_id", "seq")


@query("action_chain", """
SELECT agent_id, day, string_agg(CASE WHEN a IS DISTINCT FROM prev THEN a END, ' → ' ORDER BY seq) AS chain,
       COUNT(*) FILTER (WHERE tool IN ('Write', 'Edit')) AS n_writes, COUNT(*) FILTER (WHERE tool IN ('memory_search', 'Read')) AS n_searches
FROM (SELECT *, LAG(a) OVER (PARTITION BY agent_id, day ORDER BY seq) AS prev FROM (
        SELECT agent_id, CAST(EXTRACT(DAY FROM ts) AS INT) AS day, seq, tool, lower(replace(replace(tool, 'memory_', ''), 'submit_', '')) AS a FROM tool_call) x) y
GROUP BY agent_id, day""")
def _(t: Tables) -> DataFrame:
    c = t.tool_call.select("agent_id", F.dayofmonth("ts").alias("day"), "seq", "tool")
    return I.action_chain(c, ["agent_id", "day"], "seq")


@query("search_queries", """
SELECT agent_id, seq, 'q' || k AS query FROM tool_call WHERE tool = 'memory_search' AND k > 20""")
def _(t: Tables) -> DataFrame:
    q = F.when(F.col("k") > 20, F.concat(F.lit("q"), "k")).otherwise("")
    return I.search_queries(t.tool_call.withColumn("arguments", F.create_map(F.lit("query"), q)), ["agent_id"], "seq")


@query("stored_keys", """
SELECT agent_id, seq, CASE WHEN k > 50 THEN 'item ' || k ELSE substr(payload || payload || payload || payload || payload, 1, 40) END AS stored_key
FROM tool_call WHERE tool = 'Write'""")
def _(t: Tables) -> DataFrame:
    c = F.when(F.col("k") > 50, F.concat(F.lit("item "), "k", F.lit(" | v: 1"))).otherwise(F.repeat("payload", 5))
    return I.stored_keys(t.tool_call.withColumn("arguments", F.create_map(F.lit("content"), c)), ["agent_id"], "seq")


SQL["traj_event"] = """
SELECT user_id AS run_id, event_id AS event_idx, CASE event_type WHEN 'view' THEN 'ingest' WHEN 'purchase' THEN 'correction' WHEN 'click' THEN 'question' ELSE 'noise' END AS type,
       k % 10 AS n_entities, k % 7 AS writes, k % 3 AS searches, 1 + k % 4 AS api_calls, 30 - k % 30 AS budget_remaining, value > 20 AS correct, value > 30 AS did_store
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""


def trajectory_events(t: Tables) -> DataFrame:
    k, e = number_in(F.col("props")), F.col("event_type")
    return t.raw("events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("event_idx"),
        F.when(e == "view", "ingest").when(e == "purchase", "correction").when(e == "click", "question").otherwise("noise").alias("type"),
        (k % 10).alias("n_entities"), (k % 7).alias("writes"), (k % 3).alias("searches"), (1 + k % 4).alias("api_calls"),
        (30 - k % 30).alias("budget_remaining"), (F.col("value") > 20).alias("correct"), (F.col("value") > 30).alias("did_store"),
    )


@query("trajectory_summary", """
SELECT *, CASE WHEN n_questions > 0 THEN CAST(n_correct AS DOUBLE) / n_questions ELSE 0 END AS accuracy FROM (
  SELECT run_id, COUNT(*) AS n_events, CAST(COALESCE(SUM(n_entities) FILTER (WHERE type = 'ingest'), 0) AS BIGINT) AS entities_seen,
    CAST(COALESCE(SUM(writes) FILTER (WHERE type IN ('ingest', 'correction')), 0) AS BIGINT) AS total_writes,
    CAST(COALESCE(SUM(searches) FILTER (WHERE type IN ('ingest', 'question')), 0) AS BIGINT) AS total_searches,
    CAST(COALESCE(SUM(api_calls) FILTER (WHERE type <> 'noise'), 0) AS BIGINT) AS total_api_calls,
    COUNT(*) FILTER (WHERE type = 'question') AS n_questions, COUNT(*) FILTER (WHERE type = 'question' AND correct) AS n_correct,
    COUNT(*) FILTER (WHERE type = 'correction') AS n_corrections, COUNT(*) FILTER (WHERE type = 'correction' AND did_store) AS n_corrections_stored
  FROM traj_event GROUP BY run_id) x""")
def _(t: Tables) -> DataFrame:
    return I.trajectory_summary(trajectory_events(t), ["run_id"])


@query("batch_store_rates", """
SELECT run_id, event_idx, writes, n_entities, CASE WHEN n_entities > 0 THEN CAST(writes AS DOUBLE) / n_entities ELSE 0 END AS store_rate, budget_remaining
FROM traj_event WHERE type = 'ingest'""")
def _(t: Tables) -> DataFrame:
    return I.batch_store_rates(trajectory_events(t), ["run_id"])


@query("last_submitted_answer", """
SELECT conv_id, 'answer ' || MAX(turn) || ' of ' || conv_id AS answer, MAX(turn) AS answer_turn FROM message WHERE role = 'assistant' GROUP BY conv_id""")
def _(t: Tables) -> DataFrame:
    marked = F.concat("text", F.lit("\nANSWER_SUBMITTED:  answer "), "turn", F.lit(" of "), "conv_id", F.lit(" \nbye"))
    m = t.message.withColumn("text", F.when(F.col("role") == "assistant", marked).otherwise(F.col("text")))
    return I.last_submitted_answer(m)


@query("trim_context", """
SELECT agent_id, seq FROM (SELECT user_id AS agent_id, event_id AS seq, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
  COUNT(*) OVER (PARTITION BY user_id) AS n FROM events) x WHERE n <= 24 OR rn = 1 OR rn > n - 22""")
def _(t: Tables) -> DataFrame:
    m = t.raw("events").select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("seq"))
    return I.trim_context(m, "agent_id", "seq")


@query("stalled_runs", """
WITH e AS (SELECT user_id AS agent_id, event_id AS seq, event_type AS ev, value > 15 AS dead FROM events),
r AS (SELECT agent_id, MAX(n) - 1 AS max_repeats FROM (SELECT agent_id, g, ev, COUNT(*) AS n FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY agent_id ORDER BY seq) - ROW_NUMBER() OVER (PARTITION BY agent_id, ev ORDER BY seq) AS g FROM e) a GROUP BY ALL) b GROUP BY agent_id),
d AS (SELECT agent_id, COALESCE(MAX(CASE WHEN dead THEN n END), 0) AS max_dead_turns FROM (SELECT agent_id, g, dead, COUNT(*) AS n FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY agent_id ORDER BY seq) - ROW_NUMBER() OVER (PARTITION BY agent_id, dead ORDER BY seq) AS g FROM e) a GROUP BY ALL) b GROUP BY agent_id)
SELECT r.agent_id, max_repeats, max_dead_turns, max_repeats >= 5 AS stuck, max_dead_turns >= 2 AS dead_budget FROM r JOIN d ON d.agent_id = r.agent_id""")
def _(t: Tables) -> DataFrame:
    turns = t.raw("events").select(
        F.col("user_id").alias("agent_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"),
        (F.col("value") > 15).alias("only_rejected"),
    )
    return I.stalled_runs(turns, ["agent_id"], "seq")


@query("assistant_spans", """
WITH m AS (SELECT conv_id, turn, role, length(text) AS n, 12 + length(role) + 1 AS head, 12 + length(role) + 1 + length(text) + 10 + 1 AS size FROM message),
p AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM m)
SELECT conv_id, turn, CAST(pos + head AS BIGINT) AS start, CAST(pos + head + n + 10 AS BIGINT) AS "end" FROM p WHERE role = 'assistant'""")
def _(t: Tables) -> DataFrame:
    return I.assistant_spans(t.message)


@query("span_stats", """
SELECT conv_id, COUNT(*) FILTER (WHERE role = 'assistant') AS n_assistant, CAST(SUM(24 + length(role) + length(text)) AS BIGINT) AS n_chars,
  CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) + 10 ELSE 0 END) AS BIGINT) AS n_trainable,
  ROUND(CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) + 10 ELSE 0 END) AS DOUBLE) / SUM(24 + length(role) + length(text)), 9) AS trainable_share
FROM message GROUP BY conv_id""")
def _(t: Tables) -> DataFrame:
    return I.span_stats(t.message).withColumn("trainable_share", F.round("trainable_share", 9))


# --- J ------------------------------------------------------------------------------------------

SQL["advantage"] = """
SELECT * FROM (SELECT *, (reward - AVG(reward) OVER (PARTITION BY step, group_id)) / (STDDEV_POP(reward) OVER (PARTITION BY step, group_id) + 1e-6) AS advantage
  FROM episode) a WHERE abs(advantage) >= 1e-6
"""


def advantages(t: Tables) -> DataFrame:
    return J.group_advantage(t.episode, ["step", "group_id"])


@query("group_advantage", "SELECT step, group_id, sample_id, ROUND(advantage, 6) AS advantage FROM advantage")
def _(t: Tables) -> DataFrame:
    return advantages(t).select("step", "group_id", "sample_id", F.round("advantage", 6).alias("advantage"))


@query("ips_weights", """
SELECT step, group_id, sample_id, CAST(bucket AS BIGINT) AS bucket, ROUND(CASE WHEN n > 1 THEN w / AVG(w) OVER (PARTITION BY step, group_id) ELSE 1 END, 9) AS weight FROM (
  SELECT *, CAST(COUNT(*) OVER (PARTITION BY step, group_id) AS DOUBLE) / COUNT(*) OVER (PARTITION BY step, group_id, bucket) AS w,
         COUNT(*) OVER (PARTITION BY step, group_id) AS n
  FROM (SELECT *, round_even(reward / 0.05::DOUBLE, 0) AS bucket FROM episode) a) b""")
def _(t: Tables) -> DataFrame:
    d = J.ips_weights(t.episode, ["step", "group_id"])
    return d.select("step", "group_id", "sample_id", "bucket", F.round("weight", 9).alias("weight"))


@query("turn_advantage", """
SELECT t.sample_id, t.turn, t.part, ROUND(a.advantage * (1.0 + (t.reward - s.m) / (s.sd + 1e-6)), 5) AS turn_advantage
FROM (SELECT l_orderkey AS sample_id, l_linenumber AS turn, l_partkey AS part, l_discount AS reward FROM lineitem) t
JOIN (SELECT l_orderkey AS sample_id, AVG(l_discount) AS m, STDDEV_POP(l_discount) AS sd FROM lineitem GROUP BY l_orderkey HAVING MAX(abs(l_discount)) > 1e-8) s ON s.sample_id = t.sample_id
JOIN advantage a ON a.sample_id = t.sample_id""")
def _(t: Tables) -> DataFrame:
    turns = t.raw("lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("turn"), F.col("l_partkey").alias("part"), F.col("l_discount").alias("reward")
    )
    d = J.turn_advantage(turns, advantages(t), ["sample_id"])
    return d.select("sample_id", "turn", "part", F.round("turn_advantage", 5).alias("turn_advantage"))


SQL["mention"] = """
SELECT c.c_nationkey AS world_id, o.o_orderkey AS seq, c.c_name AS entity FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
UNION SELECT c.c_nationkey, o.o_orderkey, d.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN orders o2 ON o2.o_orderkey = o.o_orderkey + 1 JOIN customer d ON d.c_custkey = o2.o_custkey WHERE d.c_nationkey = c.c_nationkey
"""


@query("shaped_write_reward", """
WITH w AS (SELECT c.c_nationkey AS world_id, o.o_orderkey AS seq, o.o_orderstatus <> 'P' AS valid FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
v AS (SELECT m.* FROM mention m JOIN w ON w.world_id = m.world_id AND w.seq = m.seq AND w.valid),
f AS (SELECT world_id, entity, MIN(seq) AS first_seq FROM v GROUP BY world_id, entity),
x AS (SELECT v.world_id, v.seq, COUNT(*) AS n_matched, COUNT(*) FILTER (WHERE f.first_seq = v.seq) AS n_new,
        BOOL_OR(f.first_seq = v.seq AND c.c_acctbal > 5000) AS hot FROM v JOIN f ON f.world_id = v.world_id AND f.entity = v.entity JOIN customer c ON c.c_name = v.entity GROUP BY v.world_id, v.seq)
SELECT w.world_id, w.seq, w.valid, COALESCE(n_matched, 0) AS n_matched, COALESCE(n_new, 0) AS n_new,
  ROUND(CAST(CASE WHEN NOT valid THEN -0.05 WHEN n_matched IS NULL THEN 0 WHEN n_new = 0 THEN -0.1 ELSE CASE WHEN hot THEN 0.5 ELSE 0.3 END + 0.1 * (n_new - 1) END AS DOUBLE), 6) AS reward
FROM w LEFT JOIN x ON x.world_id = w.world_id AND x.seq = w.seq""")
def _(t: Tables) -> DataFrame:
    c = t.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("world_id"), F.col("c_name").alias("entity"), "c_acctbal")
    o = t.raw("orders").join(c, "o_custkey").select("world_id", F.col("o_orderkey").alias("seq"), "entity", "o_orderstatus")
    writes = o.select("world_id", "seq", (F.col("o_orderstatus") != "P").alias("valid"))
    also = o.select("world_id", (F.col("seq") - 1).alias("seq"), "entity").join(writes.select("world_id", "seq"), ["world_id", "seq"], "left_semi")
    mentions = o.select("world_id", "seq", "entity").unionByName(also)
    asked = c.where(F.col("c_acctbal") > 5000).select("world_id", "entity")
    return J.shaped_write_reward(writes, mentions, asked, ["world_id"]).withColumn("reward", F.round("reward", 6))


SQL["corr_step"] = """
SELECT agent_id, CAST(EXTRACT(DAY FROM ts) AS INT) AS day, seq, CASE tool WHEN 'memory_search' THEN 'search' WHEN 'Edit' THEN 'edit' ELSE 'other' END AS action, k > 50 AS has_new FROM tool_call
"""


@query("correction_reward", """
SELECT s.*, CAST(CASE action WHEN 'search' THEN CASE WHEN seq = first_seq THEN 0.1 ELSE 0 END
  WHEN 'edit' THEN CASE WHEN NOT has_new THEN 0.1 WHEN first_seq < seq THEN 0.6 ELSE 0.5 END ELSE 0 END AS DOUBLE) AS reward
FROM corr_step s LEFT JOIN (SELECT agent_id AS a, day AS d, MIN(seq) AS first_seq FROM corr_step WHERE action = 'search' GROUP BY agent_id, day) f
  ON f.a = s.agent_id AND f.d = s.day""".replace("SELECT s.*,", "SELECT s.agent_id, s.day, s.seq, s.action, s.has_new,"))
def _(t: Tables) -> DataFrame:
    tool = F.col("tool")
    s = t.tool_call.select(
        "agent_id", F.dayofmonth("ts").alias("day"), "seq",
        F.when(tool == "memory_search", "search").when(tool == "Edit", "edit").otherwise("other").alias("action"), (F.col("k") > 50).alias("has_new"),
    )
    return J.correction_reward(s, ["agent_id", "day"])


@query("episode_stats", """
SELECT s.run_id, s.writes_used, s.questions_answered, s.correct_count, s.corrections, s.with_search, s.with_edit, s.edit_success,
       GREATEST(30 - s.writes_used, 0) AS budget_remaining, ROUND(r.reward, 9) AS reward
FROM (SELECT agent_id AS run_id, COUNT(*) FILTER (WHERE tool = 'Write' AND ok) AS writes_used, COUNT(*) FILTER (WHERE tool = 'Read') AS questions_answered,
        COUNT(*) FILTER (WHERE tool = 'Read' AND k > 40) AS correct_count, COUNT(*) FILTER (WHERE value > 30) AS corrections,
        COUNT(*) FILTER (WHERE value > 30 AND tool = 'memory_search') AS with_search, COUNT(*) FILTER (WHERE value > 30 AND tool = 'Edit') AS with_edit,
        COUNT(*) FILTER (WHERE value > 30 AND tool = 'Edit' AND k > 20) AS edit_success FROM tool_call GROUP BY agent_id) s
LEFT JOIN (SELECT run_id, AVG(composite) AS reward FROM scored_run GROUP BY run_id) r ON r.run_id = s.run_id""")
def _(t: Tables) -> DataFrame:
    tool = F.col("tool")
    steps = t.tool_call.select(
        F.col("agent_id").alias("run_id"), "tool", ((tool == "Write") & F.col("ok")).alias("accepted"), (tool == "Read").alias("answered"),
        (F.col("k") > 40).alias("correct"), (F.col("value") > 30).alias("correction"), (tool == "memory_search").alias("searched"),
        (tool == "Edit").alias("edited"), (F.col("k") > 20).alias("edit_ok"),
    )
    reward = scored_runs(t).groupBy("run_id").agg(F.round(F.avg("composite"), 9).alias("reward"))
    return J.episode_stats(steps, ["run_id"], 30).join(reward, "run_id", "left")


SQL["ep_correct"] = """
SELECT o.o_custkey % 50 AS step, o.o_orderkey AS sample_id, o.o_totalprice / 500000.0 AS reward, COALESCE(g.n, 0) AS correct
FROM orders o LEFT JOIN (SELECT question_id, COUNT(*) FILTER (WHERE correct) AS n FROM graded GROUP BY question_id) g ON g.question_id = o.o_orderkey
"""
SQL["curve"] = """
SELECT step, COUNT(*) AS n, AVG(reward) AS mean_reward, MAX(reward) AS max_reward, AVG(correct) AS mean_correct,
  arg_min(sample_id, {'r': -reward, 'e': sample_id}) AS best_episode, arg_min(sample_id, {'r': reward, 'e': sample_id}) AS worst_episode
FROM ep_correct GROUP BY step
"""


def curve(t: Tables) -> DataFrame:
    g = graded(t).groupBy(F.col("question_id").alias("sample_id")).agg(F.count_if("correct").alias("n"))
    e = t.episode.join(g, "sample_id", "left").withColumn("correct", F.coalesce("n", F.lit(0)))
    return J.training_curve(e)


@query("training_curve", "SELECT step, n, ROUND(mean_reward, 9) AS mean_reward, max_reward, ROUND(mean_correct, 9) AS mean_correct, best_episode, worst_episode FROM curve")
def _(t: Tables) -> DataFrame:
    return curve(t).withColumn("mean_reward", F.round("mean_reward", 9)).withColumn("mean_correct", F.round("mean_correct", 9))


@query("training_summary", """
SELECT COUNT(*) AS steps, ROUND(arg_min(mean_reward, step), 9) AS first_reward, ROUND(arg_max(mean_reward, step), 9) AS last_reward, MAX(max_reward) AS best_reward,
  ROUND(arg_min(mean_correct, step), 9) AS first_correct, ROUND(arg_max(mean_correct, step), 9) AS last_correct FROM curve""")
def _(t: Tables) -> DataFrame:
    d = J.training_summary(curve(t))
    return d.select("steps", "best_reward", *[F.round(c, 9).alias(c) for c in ("first_reward", "last_reward", "first_correct", "last_correct")])


