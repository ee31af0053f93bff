"""Memory store and retrieval (F) bound to documents, embeddings, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators import hybrid, keyword
from engramlake.operators import memory as M
from engramlake.plans import catalogue
from engramlake.plans.entities_changes import documents
from engramlake.plans.fixtures import SQL, Tables
from engramlake.plans.grading_scoring import sql_numeric
from engramlake.plans.registry import query
from engramlake.session import materialise, sized

DIMS = 64
BUDGET = 30

# Memory entries of a world: one per order, naming the customer with or without a value.
SQL["entry"] = """
SELECT e.world_id, o.o_orderkey AS entry_id, o.o_orderkey AS seq,
  CASE o.o_orderpriority
    WHEN '1-URGENT' THEN e.entity || ' | account balance: $' || COALESCE(format('{:,.2f}', e.acctbal), 'unknown')
    WHEN '2-HIGH' THEN 'Saw ' || upper(e.entity) || ' | order count: ' || CAST(CAST(e.order_count AS BIGINT) AS VARCHAR)
    WHEN '3-MEDIUM' THEN 'Note about x' || e.entity || 'y, nothing final'
    WHEN '4-NOT SPECIFIED' THEN e.entity || ' | last order: ' || CAST(e.last_order AS VARCHAR)
    ELSE 'quiet day' END AS content
FROM orders o JOIN entity e ON e.arrival = o.o_custkey
"""


def entries(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    name = F.col("entity")
    lit = F.lit
    content = (
        F.when(p == "1-URGENT", F.concat(name, lit(" | account balance: $"), F.coalesce(F.format_number("acctbal", 2), lit("unknown"))))
        .when(p == "2-HIGH", F.concat(lit("Saw "), F.upper(name), lit(" | order count: "), F.col("order_count").cast("bigint").cast("string")))
        .when(p == "3-MEDIUM", F.concat(lit("Note about x"), name, lit("y, nothing final")))
        .when(p == "4-NOT SPECIFIED", F.concat(name, lit(" | last order: "), F.col("last_order").cast("string")))
        .otherwise("quiet day")
    )
    o = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return o.join(t.entity, F.col("arrival") == F.col("o_custkey")).select(
        "world_id", F.col("o_orderkey").alias("entry_id"), F.col("o_orderkey").alias("seq"), content.alias("content")
    )


SQL["variant"] = """
SELECT a.world_id, a.entity, d.label, unnest(CASE a.dtype
    WHEN 'int' THEN [CAST(CAST(num AS BIGINT) AS VARCHAR)]
    WHEN 'float' THEN ['$' || format('{:.2f}', num), regexp_replace(format('{:.2f}', num), '0$', ''),
                       CAST(CAST(round_even(num, 0) AS BIGINT) AS VARCHAR), printf('%.1f', num), printf('%.0f', num)]
    WHEN 'date' THEN [CAST(dt AS VARCHAR)] ELSE [lower(str)] END) AS v, a.attr
FROM entity_attr a JOIN attr_def d ON d.attr = a.attr
"""
SQL["name_hit"] = """
SELECT e.world_id, e.entity, n.entry_id,
  EXISTS (SELECT 1 FROM variant v WHERE v.world_id = e.world_id AND v.entity = e.entity AND contains(replace(lower(n.content), ',', ''), v.v)) AS has_value
FROM entity e JOIN entry n ON n.world_id = e.world_id AND contains(lower(n.content), lower(e.entity))
"""
SQL["stored_flag"] = """
SELECT e.world_id, e.entity, COALESCE(h.s, FALSE) AS stored FROM entity e
LEFT JOIN (SELECT world_id, entity, BOOL_OR(has_value) AS s FROM name_hit GROUP BY world_id, entity) h
  ON h.world_id = e.world_id AND h.entity = e.entity
"""


def variants(t: Tables) -> DataFrame:
    return M.value_variants(t.entity_attr, t.attr_def)


def held_entries(t: Tables) -> DataFrame:
    """The entries written once, and the entities, which several branches read, with them."""
    t.keep("entity")
    t.entity = sized(t.entity)
    return materialise(entries(t), "entries")


def stored(t: Tables) -> DataFrame:
    held = held_entries(t)
    return M.detect_stored_entities(t.entity, variants(t), held)


@query("detect_stored_entities", "SELECT world_id, entity, stored FROM stored_flag")
def _(t: Tables) -> DataFrame:
    return stored(t)


@query("missed_entities", "SELECT world_id, entity FROM stored_flag WHERE NOT stored")
def _(t: Tables) -> DataFrame:
    return M.missed_entities(stored(t))


@query("storage_coverage", """
SELECT world_id, COUNT(*) FILTER (WHERE stored) AS n_stored, COUNT(*) AS n_entities, ROUND(AVG(CAST(stored AS INT)), 9) AS coverage
FROM stored_flag GROUP BY world_id""")
def _(t: Tables) -> DataFrame:
    return M.storage_coverage(stored(t)).withColumn("coverage", F.round("coverage", 9))


@query("noise_documents", """
SELECT world_id, entry_id, COUNT(*) AS n_mentioned FROM name_hit GROUP BY world_id, entry_id HAVING NOT BOOL_OR(has_value)""")
def _(t: Tables) -> DataFrame:
    held = held_entries(t)
    return M.noise_documents(t.entity, variants(t), held)


# Each benchmark item asks the memory of the agent that owns the document with the same number.
SQL["query_text"] = """
SELECT b.item_id AS query_id, d.source AS agent_id, b.text FROM benchmark b JOIN documents d ON d.doc_id = b.item_id
"""
SQL["vec_entry"] = """
SELECT d.source AS agent_id, d.doc_id AS entry_id, d.doc_id AS seq, d.text AS content, CAST(e.embedding AS DOUBLE[]) AS embedding
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
"""
SQL["word"] = r"""
SELECT agent_id, entry_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) AS tok FROM vec_entry
"""


def _bm25_sql(entry: str, exact: bool = False) -> str:
    """With ``exact`` the parts are added as decimals, so that entries of equal parts tie."""
    part = "q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.5 / (f.tf + 1.5 * (0.25 + 0.75 * f.dl / s.avgdl))"
    part = f"CAST({part} AS DECIMAL(38,18))" if exact else part
    return f"""
SELECT q.agent_id, q.query_id, f.entry_id, SUM({part}) AS score
FROM (SELECT agent_id, query_id, tok, COUNT(*) AS qtf FROM (
        SELECT agent_id, query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM query_text) a GROUP BY ALL) q
JOIN (SELECT agent_id, entry_id, tok, COUNT(*) AS tf, MAX(dl) AS dl FROM (
        SELECT agent_id, entry_id, len(w) AS dl, unnest(w) AS tok FROM (
          SELECT agent_id, entry_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {entry}) b) c GROUP BY ALL) f
  ON f.agent_id = q.agent_id AND f.tok = q.tok
JOIN (SELECT agent_id, tok, COUNT(DISTINCT entry_id) AS df FROM (
        SELECT agent_id, entry_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM {entry}) e GROUP BY ALL) d
  ON d.agent_id = q.agent_id AND d.tok = q.tok
JOIN (SELECT agent_id, COUNT(*) AS n, AVG(len(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'))) AS avgdl FROM {entry} GROUP BY agent_id) s
  ON s.agent_id = q.agent_id
GROUP BY q.agent_id, q.query_id, f.entry_id"""


SQL["bm25_vec"] = _bm25_sql("vec_entry")
SQL["cos_vec"] = """
SELECT q.agent_id, q.query_id, e.entry_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), e.embedding) AS score
FROM query_text q JOIN embeddings v ON v.vec_id = q.query_id JOIN vec_entry e ON e.agent_id = q.agent_id
WHERE e.embedding IS NOT NULL
"""
SQL["fused"] = """
SELECT b.agent_id, b.query_id, b.entry_id, v.rank_vec, b.rank_bm25, coalesce(0.7::DOUBLE / (60 + v.rank_vec), 0) + 0.3::DOUBLE / (60 + b.rank_bm25) AS rrf
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY agent_id, query_id ORDER BY ROUND(score, 9) DESC, entry_id) AS rank_vec FROM cos_vec) v
RIGHT JOIN (SELECT c.agent_id, c.query_id, c.entry_id, ROW_NUMBER() OVER (PARTITION BY c.agent_id, c.query_id
        ORDER BY ROUND(COALESCE(b.score, 0), 9) DESC, c.entry_id) AS rank_bm25
      FROM (SELECT q.agent_id, q.query_id, e.entry_id FROM query_text q JOIN embeddings v ON v.vec_id = q.query_id
            JOIN vec_entry e ON e.agent_id = q.agent_id) c LEFT JOIN bm25_vec b ON b.query_id = c.query_id AND b.entry_id = c.entry_id) b
  ON b.query_id = v.query_id AND b.entry_id = v.entry_id
"""
SQL["decayed"] = """
SELECT f.*, f.rrf * pow(0.99, m.latest - e.seq) AS score FROM fused f
JOIN vec_entry e ON e.agent_id = f.agent_id AND e.entry_id = f.entry_id
JOIN (SELECT agent_id, MAX(seq) AS latest FROM vec_entry GROUP BY agent_id) m ON m.agent_id = f.agent_id
"""


def query_text(t: Tables) -> DataFrame:
    d = t.raw("documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("agent_id"))
    return t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text").join(d, "query_id")


def query_vec(t: Tables) -> DataFrame:
    v = t.raw("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return query_text(t).join(v, "query_id")


def vec_entries(t: Tables) -> DataFrame:
    v = t.raw("embeddings").select(F.col("vec_id").alias("entry_id"), "embedding")
    return t.memory_entry.join(v, "entry_id", "left")


@query("bm25_scores", f"SELECT agent_id, query_id, entry_id, ROUND(score, 6) AS score FROM ({_bm25_sql('memory_entry')}) x")
def _(t: Tables) -> DataFrame:
    return M.bm25_scores(query_text(t), t.memory_entry).withColumn("score", F.round("score", 6))


@query("bm25_topk", f"""
SELECT agent_id, query_id, entry_id, ROUND(CAST(score AS DOUBLE), 6) AS score, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY agent_id, query_id ORDER BY score DESC, entry_id) AS rank
  FROM ({_bm25_sql('memory_entry', exact=True)}) x) y WHERE rank <= 10""")
def _(t: Tables) -> DataFrame:
    d = keyword.bm25_topk(query_text(t), t.memory_entry, 10)
    return d.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


SQL["centroid"] = """
SELECT label, list(v ORDER BY i) AS qvec FROM (
  SELECT label, i, AVG(x) AS v FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) a
  GROUP BY label, i) b GROUP BY label
"""


@query("vector_topk", """
SELECT label, query_id, entry_id, ROUND(score, 6) AS score, rank FROM (
  SELECT c.label, c.label AS query_id, e.vec_id AS entry_id, list_cosine_similarity(c.qvec, CAST(e.embedding AS DOUBLE[])) AS score,
         ROW_NUMBER() OVER (PARTITION BY c.label ORDER BY list_cosine_similarity(c.qvec, CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank
  FROM centroid c JOIN embeddings e ON e.label = c.label) x WHERE rank <= 10""")
def _(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    mean = F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(DIMS)])
    q = e.groupBy("label").agg(mean.alias("qvec")).withColumn("query_id", F.col("label"))
    d = M.vector_topk(q, e.withColumnRenamed("vec_id", "entry_id"), 10, DIMS, ["label"])
    return d.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query("rrf_fuse", "SELECT agent_id, query_id, entry_id, rank_vec, rank_bm25, ROUND(rrf, 9) AS rrf FROM fused")
def _(t: Tables) -> DataFrame:
    d = M.fused_ranks(query_vec(t), vec_entries(t), DIMS, digits=9)
    return d.select("agent_id", "query_id", "entry_id", "rank_vec", "rank_bm25", F.round("rrf", 9).alias("rrf"))


@query("recency_decay", """
SELECT d.source AS agent_id, d.doc_id AS entry_id, ROUND(l.quality * pow(0.99, (m.latest - d.doc_id)), 9) AS score
FROM documents d JOIN labels l ON l.doc_id = d.doc_id
JOIN (SELECT source, MAX(doc_id) AS latest FROM documents GROUP BY source) m ON m.source = d.source""")
def _(t: Tables) -> DataFrame:
    seqs = t.memory_entry.select("agent_id", "entry_id", "seq")
    scored = t.raw("labels").select(F.col("doc_id").alias("entry_id"), "quality").join(
        seqs.select("agent_id", "entry_id"), "entry_id"
    )
    d = M.recency_decay(scored, seqs, ["agent_id"], score="quality")
    return d.select("agent_id", "entry_id", F.round("score", 9).alias("score"))


@query("hybrid_search", """
SELECT agent_id, query_id, entry_id, ROUND(score, 9) AS score, position FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY agent_id, query_id ORDER BY score DESC, entry_id) AS position FROM decayed WHERE score > 0) x
WHERE position <= 5""")
def _(t: Tables) -> DataFrame:
    d = hybrid.hybrid_search(query_vec(t), vec_entries(t), 5, DIMS, digits=9)
    return d.select("agent_id", "query_id", "entry_id", F.round("score", 9).alias("score"), F.col("position").cast("bigint").alias("position"))


# One question per world to its own memory: the first customer's full name, number, name with
# more words around it, or the name of their segment, by region.
SQL["name_query"] = """
SELECT world_id, qkey AS query_id, CASE n_regionkey WHEN 0 THEN entity WHEN 1 THEN substr(entity, 10) WHEN 2 THEN entity || ' details' ELSE '1-URGENT' END AS text
FROM (SELECT c_nationkey AS world_id, MIN(c_custkey) AS qkey, arg_min(c_name, c_custkey) AS entity FROM customer GROUP BY c_nationkey) q
JOIN nation n ON n.n_nationkey = q.world_id
"""
SQL["name_entry"] = """
SELECT d.world_id, c.c_custkey AS entry_id, d.entity || ' | ' || d.document AS content FROM document_line d JOIN customer c ON c.c_name = d.entity
"""


def name_entries(t: Tables) -> DataFrame:
    c = t.raw("customer").select(F.col("c_name").alias("entity"), F.col("c_custkey").alias("entry_id"))
    return documents(t).join(c, "entity").select(
        "world_id", "entry_id", F.concat("entity", F.lit(" | "), "document").alias("content")
    )


@query("name_priority_rerank", """
WITH pool AS (
  SELECT q.world_id, q.query_id, e.entry_id, ROW_NUMBER() OVER (PARTITION BY q.query_id
           ORDER BY ROUND(list_cosine_similarity(CAST(qv.embedding AS DOUBLE[]), CAST(ev.embedding AS DOUBLE[])), 9) DESC, e.entry_id) AS rank
  FROM name_query q JOIN embeddings qv ON qv.vec_id = q.query_id
  JOIN name_entry e ON e.world_id = q.world_id JOIN embeddings ev ON ev.vec_id = e.entry_id),
x AS (
  SELECT q.world_id, q.query_id, e.entry_id, lower(strip(q.text)) AS q, lower(strip(split_part(e.content, ' | ', 1))) AS name, lower(e.content) AS content, p.rank
  FROM name_query q JOIN name_entry e ON e.world_id = q.world_id
  LEFT JOIN pool p ON p.query_id = q.query_id AND p.entry_id = e.entry_id AND p.rank <= 15),
y AS (SELECT *, CASE WHEN name = q THEN 0 WHEN contains(name, q) OR contains(q, name) THEN 1 WHEN contains(content, q) THEN 2 ELSE 3 END AS match_class FROM x)
SELECT world_id, query_id, entry_id, match_class, position FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY match_class, rank NULLS LAST, entry_id) AS position
  FROM y WHERE rank IS NOT NULL OR match_class <= 2) z WHERE position <= 5""")
def _(t: Tables) -> DataFrame:
    first = t.raw("customer").groupBy(F.col("c_nationkey").alias("world_id")).agg(
        F.min("c_custkey").alias("query_id"), F.min_by("c_name", "c_custkey").alias("entity")
    ).join(t.raw("nation").select(F.col("n_nationkey").alias("world_id"), "n_regionkey"), "world_id")
    r, name = F.col("n_regionkey"), F.col("entity")
    q = first.select(
        "world_id", "query_id",
        F.when(r == 0, name).when(r == 1, F.substr(name, F.lit(10))).when(r == 2, F.concat(name, F.lit(" details")))
        .otherwise("1-URGENT").alias("text"),
    )
    e = name_entries(t)
    vec = t.raw("embeddings")
    qv = q.join(vec.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id")
    ev = e.select("world_id", "entry_id").join(vec.select(F.col("vec_id").alias("entry_id"), "embedding"), "entry_id")
    scores = M.vector_scores(qv, ev, DIMS, ["world_id"]).withColumn("score", F.round("score", 9))
    ranked = M.top_k(scores, ["world_id", "query_id"], [F.col("score").desc(), F.col("entry_id")], 15, "rank")
    d = M.name_priority_rerank(q, e, ranked, 5)
    return d.select("world_id", "query_id", "entry_id", "match_class", F.col("position").cast("bigint").alias("position"))


@query("extract_kv", """
SELECT world_id, entry_id, lower(strip(split_part(part, ':', 1))) AS label, strip(substr(part, instr(part, ':') + 1)) AS value
FROM (SELECT world_id, entry_id, unnest(string_split(content, '|')) AS part FROM name_entry) p WHERE contains(part, ':')""")
def _(t: Tables) -> DataFrame:
    return M.extract_kv(name_entries(t), ["world_id", "entry_id"])


@query("retrieval_quality", f"""
WITH res AS (
  SELECT * FROM (SELECT h.world_id, h.entity, n.content, ROW_NUMBER() OVER (PARTITION BY h.world_id, h.entity ORDER BY n.entry_id DESC) AS rank
    FROM name_hit h JOIN entry n ON n.world_id = h.world_id AND n.entry_id = h.entry_id) r WHERE rank <= 3),
asked AS (SELECT a.world_id, a.entity, a.entity || '/' || a.attr AS question_id, d.label,
      CASE a.dtype WHEN 'int' THEN CAST(CAST(num AS BIGINT) AS VARCHAR) WHEN 'float' THEN format('{{:.2f}}', num) WHEN 'date' THEN CAST(dt AS VARCHAR) ELSE str END AS truth
    FROM entity_attr a JOIN attr_def d ON d.attr = a.attr),
part AS (SELECT q.world_id, q.question_id, q.truth, q.label AS asked, r.content, strip(split_part(p.part, ':', 1)) AS label, strip(substr(p.part, instr(p.part, ':') + 1)) AS value, contains(p.part, ':') AS kv
    FROM asked q LEFT JOIN res r ON r.world_id = q.world_id AND r.entity = q.entity
    LEFT JOIN LATERAL (SELECT unnest(string_split(r.content, '|')) AS part) p ON TRUE),
verdict AS (SELECT world_id, question_id, BOOL_OR(COALESCE(contains(replace(content, ',', ''), truth)
      OR (kv AND (contains(lower(label), lower(asked)) OR contains(lower(asked), lower(label))) AND (lower(value) = lower(truth) OR {sql_numeric('value', 'truth')})), FALSE)) AS ok
    FROM part GROUP BY world_id, question_id)
SELECT e.world_id, e.n_entities, ROUND(e.recall, 9) AS recall, ROUND(p.preservation, 9) AS preservation, a.n_questions, ROUND(a.accuracy, 9) AS accuracy
FROM (SELECT e.world_id, COUNT(*) AS n_entities, AVG(CAST(r.entity IS NOT NULL AS INT)) AS recall
      FROM entity e LEFT JOIN (SELECT DISTINCT world_id, entity FROM res) r ON r.world_id = e.world_id AND r.entity = e.entity GROUP BY e.world_id) e
LEFT JOIN (SELECT world_id, AVG(CAST(hit AS INT)) AS preservation FROM (
      SELECT r.world_id, r.entity, v.attr, BOOL_OR(contains(replace(lower(r.content), ',', ''), v.v)) AS hit
      FROM res r JOIN variant v ON v.world_id = r.world_id AND v.entity = r.entity WHERE r.rank = 1 GROUP BY r.world_id, r.entity, v.attr) x GROUP BY world_id) p
  ON p.world_id = e.world_id
JOIN (SELECT world_id, COUNT(*) AS n_questions, AVG(CAST(ok AS INT)) AS accuracy FROM verdict GROUP BY world_id) a ON a.world_id = e.world_id""")
def _(t: Tables) -> DataFrame:
    e = held_entries(t)
    v = variants(t)
    hits = M.name_value_hits(t.entity, v, e).join(e.select("world_id", "entry_id", "content"), ["world_id", "entry_id"])
    results = M.top_k(hits, ["world_id", "entity"], [F.col("entry_id").desc()], 3, "rank")
    d = t.entity_attr.drop("dtype").join(F.broadcast(t.attr_def.select("attr", "dtype", "label")), "attr")
    truth = (
        F.when(F.col("dtype") == "int", F.col("num").cast("bigint").cast("string"))
        .when(F.col("dtype") == "float", F.format_string("%.2f", "num"))
        .when(F.col("dtype") == "date", F.col("dt").cast("string")).otherwise(F.col("str"))
    )
    questions = d.select(
        "world_id", "entity", F.concat("entity", F.lit("/"), "attr").alias("question_id"), "label", truth.alias("truth"),
        F.lit("retrieval").alias("competency"),
    )
    out = M.retrieval_quality(t.entity, results, v, questions)
    return out.select(
        "world_id", "n_entities", F.round("recall", 9).alias("recall"), F.round("preservation", 9).alias("preservation"),
        "n_questions", F.round("accuracy", 9).alias("accuracy"),
    )


@query("enforce_write_budget", """
SELECT agent_id, seq, verdict, CAST(GREATEST(30 - before - CASE WHEN before < 30 THEN cost ELSE 0 END, 0) AS BIGINT) AS remaining FROM (
  SELECT *, CASE WHEN tool = 'Write' AND n_chars > 2000 THEN 'too_long' WHEN (tool = 'Write' OR (tool = 'Edit' AND NOT free)) AND before >= 30 THEN 'rejected'
      WHEN tool = 'Edit' AND NOT free AND NOT ok THEN 'refunded' WHEN tool IN ('Write', 'Edit') THEN 'accepted' ELSE 'free' END AS verdict FROM (
    SELECT *, COALESCE(SUM(cost) OVER (PARTITION BY agent_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
      SELECT *, CASE WHEN (tool = 'Write' AND n_chars <= 2000) OR (tool = 'Edit' AND NOT free AND ok) THEN 1 ELSE 0 END AS cost FROM (
        SELECT agent_id, seq, tool, k * 25 AS n_chars, k < 70 AS ok, value > 40 AS free FROM tool_call) a) b) c) d""")
def _(t: Tables) -> DataFrame:
    return M.enforce_write_budget(budget_ops(t), ["agent_id"], "seq", BUDGET).select("agent_id", "seq", "verdict", "remaining")


def budget_ops(t: Tables) -> DataFrame:
    return t.tool_call.select(
        "agent_id", "seq", "tool", (F.col("k") * 25).alias("n_chars"), (F.col("k") < 70).alias("ok"), (F.col("value") > 40).alias("free")
    )


def memory_ops(t: Tables) -> DataFrame:
    kind, k = F.col("event_type"), F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    item = F.concat(F.lit("item "), k)
    return t.raw("events").select(
        F.col("user_id").alias("agent_id"), F.col("event_id").alias("seq"),
        F.when(kind.isin("signup", "error"), "add").when(kind == "purchase", "replace").when(kind == "click", "remove")
        .otherwise("search").alias("action"),
        F.concat(F.lit("t"), k % 3).alias("topic"),
        F.when(kind == "purchase", F.concat(F.lit("changed "), item)).otherwise(item).alias("content"),
        item.alias("old_text"), (kind != "error").alias("ok"),
    )


SQL["memory_op"] = """
SELECT user_id AS agent_id, event_id AS seq, k, value,
       CASE WHEN event_type IN ('signup', 'error') THEN 'add' WHEN event_type = 'purchase' THEN 'replace' WHEN event_type = 'click' THEN 'remove' ELSE 'search' END AS action,
       't' || (k % 3) AS topic, CASE WHEN event_type = 'purchase' THEN 'changed ' ELSE '' END || 'item ' || k AS content,
       'item ' || k AS old_text, event_type <> 'error' AS ok
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""


def replay_sql(acts: str, given: str) -> str:
    """The fold as a recursive query: each step takes every agent's entry list through its next operation."""
    return f"""
WITH RECURSIVE act AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY agent_id ORDER BY seq) AS i FROM memory_op WHERE ok AND action <> 'search' AND {acts}),
start AS (
  SELECT agent_id, list({{'t': topic, 'c': content}} ORDER BY seq) AS entries FROM memory_op WHERE {given} GROUP BY agent_id),
fold AS (
  SELECT a.agent_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, COALESCE(s.entries, CAST([] AS STRUCT(t VARCHAR, c VARCHAR)[])) AS entries
  FROM (SELECT agent_id FROM act UNION SELECT agent_id FROM start) a LEFT JOIN start s ON s.agent_id = a.agent_id
  UNION ALL
  SELECT agent_id, i, used + CAST(go AS BIGINT),
         CASE WHEN NOT go THEN entries WHEN action = 'add' THEN list_append(entries, {{'t': topic, 'c': content}})
              WHEN action = 'replace' THEN list_concat(list_concat(entries[1:spot - 1], [{{'t': topic, 'c': content}}]), entries[spot + 1:])
              ELSE list_concat(entries[1:spot - 1], entries[spot + 1:]) END
  FROM (SELECT *, used < {BUDGET} AND CASE WHEN action = 'add' THEN NOT list_contains(entries, {{'t': topic, 'c': content}}) ELSE kinds = 1 END AS go
        FROM (SELECT f.agent_id, a.i, f.used, f.entries, a.action, a.topic, a.content,
                list_position([x.t = a.topic AND contains(x.c, a.old_text) for x in f.entries], TRUE) AS spot,
                len(list_distinct([x.c for x in f.entries if x.t = a.topic AND contains(x.c, a.old_text)])) AS kinds
              FROM fold f JOIN act a ON a.agent_id = f.agent_id AND a.i = f.i + 1) m) g)
SELECT agent_id, CAST(position - 1 AS BIGINT) AS position, entries[position].t AS topic, entries[position].c AS content, used AS writes_used
FROM (SELECT agent_id, used, entries, unnest(range(1, len(entries) + 1)) AS position
      FROM (SELECT agent_id, arg_max(used, i) AS used, arg_max(entries, i) AS entries FROM fold GROUP BY agent_id) z) y"""


@query("replay_memory", replay_sql("TRUE", "FALSE"))
def _(t: Tables) -> DataFrame:
    return M.replay_memory(memory_ops(t), BUDGET)


@query("replay_memory_resumed", replay_sql("value <= 80", "action = 'search' AND k < 30"))
def _(t: Tables) -> DataFrame:
    """Searches stand for entries held from before, and some operations mean another store."""
    value = t.raw("events").select(F.col("event_id").alias("seq"), F.when(F.col("value") > 80, "user").alias("target"))
    ops = memory_ops(t)
    held = ops.where((F.col("action") == "search") & (F.regexp_extract("content", "([0-9]+)", 1).cast("int") < 30))
    return M.replay_memory(ops.join(value, "seq"), BUDGET, initial=held)


@query("upsert_entries", """
SELECT agent_id, entry_id, seq, content FROM (
  SELECT user_id AS agent_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS entry_id, event_id AS seq, event_type || ' ' || props AS content, event_type,
         ROW_NUMBER() OVER (PARTITION BY user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) ORDER BY event_id DESC) AS rn FROM events) x
WHERE rn = 1 AND event_type <> 'error'""")
def _(t: Tables) -> DataFrame:
    return M.upsert_entries(upserts(t))


def upserts(t: Tables) -> DataFrame:
    return t.raw("events").select(
        F.col("user_id").alias("agent_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("entry_id"),
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "forget").otherwise("upsert").alias("op"),
        F.concat("event_type", F.lit(" "), "props").alias("content"),
    )


@query("edit_entries", """
SELECT d.source AS agent_id, d.doc_id AS entry_id, CASE WHEN hit THEN d.doc_id + 1000000 ELSE d.doc_id END AS seq,
       md5(CASE WHEN hit THEN substr(d.text, 1, instr(d.text, 'the') - 1) || 'THE' || substr(d.text, instr(d.text, 'the') + 3) ELSE d.text END) AS content_md5, hit AS edited
FROM (SELECT x.*, contains(x.text, 'the') AND l.doc_id IS NOT NULL AS hit FROM documents x LEFT JOIN labels l ON l.doc_id = x.doc_id AND l.quality = 1) d""")
def _(t: Tables) -> DataFrame:
    docs = t.raw("documents").select("doc_id", F.col("source").alias("agent_id"))
    edits = t.raw("labels").where("quality = 1").join(docs, "doc_id").select(
        "agent_id", F.col("doc_id").alias("entry_id"), F.lit("the").alias("old_text"), F.lit("THE").alias("new_text"),
        (F.col("doc_id") + 1000000).alias("edit_seq"),
    )
    d = M.edit_entries(t.memory_entry, edits)
    return d.select("agent_id", "entry_id", "seq", F.md5("content").alias("content_md5"), "edited")


@query("memory_inventory", """
SELECT e.world_id, COUNT(*) AS n_entries, string_agg(CASE WHEN rn <= 30 THEN strip(split_part(content, '|', 1)) END, '; ' ORDER BY seq) AS names,
       GREATEST(30 - MAX(n.n_regionkey) * 10, 0) AS remaining
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY world_id ORDER BY seq) AS rn FROM entry) e JOIN nation n ON n.n_nationkey = e.world_id GROUP BY e.world_id""")
def _(t: Tables) -> DataFrame:
    w = t.raw("nation").select(F.col("n_nationkey").alias("world_id"), (F.col("n_regionkey") * 10).alias("writes_used"))
    return M.memory_inventory(entries(t), BUDGET, w, "world_id")
