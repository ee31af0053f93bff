"""Question ground truths (C) bound to nations, customers, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators import questions as C
from engramlake.operators import scoring as H
from engramlake.plans import catalogue
from engramlake.plans.entities_changes import current
from engramlake.plans.fixtures import SQL, Tables
from engramlake.plans.registry import query
from engramlake.session import spread

NUMS = ["acctbal", "order_count", "total_spend"]
PAIRS = [(a, b) for a in NUMS for b in NUMS if a != b]
KEYS = ["world_id", "entity", "category"]

SQL["num_attr"] = "SELECT world_id, entity, category, attr, num FROM entity_attr WHERE dtype IN ('int', 'float')"
SQL["pair"] = """
SELECT a.world_id, a.entity, a.category, a.attr AS attr1, a.num AS v1, b.attr AS attr2, b.num AS v2
FROM num_attr a JOIN num_attr b ON b.world_id = a.world_id AND b.entity = a.entity AND b.attr <> a.attr
"""
SQL["set5"] = """
SELECT world_id, attr, entity, num FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY world_id, attr ORDER BY md5(attr || entity), entity) AS rn FROM num_attr) s
WHERE rn <= 5
"""
SQL["known_edge"] = """
SELECT e.* FROM edge e JOIN entity a ON a.world_id = e.world_id AND a.entity = e.source AND a.total_spend IS NOT NULL
JOIN entity b ON b.world_id = e.world_id AND b.entity = e.target AND b.total_spend IS NOT NULL
"""


def order():
    return F.md5(F.concat(F.col("attr"), F.col("entity")))


def pairs(t: Tables) -> DataFrame:
    return C.pair_table(t.entity, PAIRS, KEYS)


def sets(t: Tables) -> DataFrame:
    return C.candidate_sets(t.entity_attr, order())


def edges(t: Tables) -> DataFrame:
    return C.known_edges(t.edge, t.entity.where(F.col("total_spend").isNotNull()))


_ASK = "CASE c_mktsegment WHEN 'BUILDING' THEN 'acctbal' WHEN 'MACHINERY' THEN 'priority' WHEN 'HOUSEHOLD' THEN 'last_order' ELSE 'total_spend' END"


@query("q_retrieval", f"""
SELECT q.world_id, q.entity, q.attr, a.num, a.str, a.dt, q.entity AS required
FROM (SELECT c_nationkey AS world_id, c_name AS entity, {_ASK} AS attr FROM customer) q
JOIN entity_attr a ON a.world_id = q.world_id AND a.entity = q.entity AND a.attr = q.attr""")
def _(t: Tables) -> DataFrame:
    q = t.raw("customer").select(
        F.col("c_nationkey").alias("world_id"), F.col("c_name").alias("entity"), F.expr(_ASK).alias("attr")
    )
    return C.q_retrieval(q, t.entity_attr)


@query("q_update", """
SELECT c.world_id, c.entity, c.attr, v.value AS answer_value
FROM (SELECT DISTINCT world_id, entity, attr FROM change WHERE kind = 'correction') c
JOIN current_value v ON v.world_id = c.world_id AND v.entity = c.entity AND v.attr = c.attr""")
def _(t: Tables) -> DataFrame:
    return C.q_update(t.change.where(F.col("kind") == "correction"), current(t))


@query("q_synthesis", """
SELECT world_id, attr, (arg_min(entity, {'v': -num, 'n': entity})) AS highest, MAX(num) AS highest_value,
       (arg_min(entity, {'v': num, 'n': entity})) AS lowest, MIN(num) AS lowest_value,
       string_agg(entity, '|' ORDER BY entity) AS required
FROM set5 GROUP BY world_id, attr HAVING COUNT(*) >= 5""")
def _(t: Tables) -> DataFrame:
    return C.q_synthesis(sets(t))


_OPS = " UNION ALL ".join(
    f"SELECT '{r[0]}' AS attr, '{op}' AS op" for r in catalogue.ATTR_DEFS for op in r[6]
)


@query("q_aggregation", f"""
SELECT p.world_id, p.attr, p.category, o.op, p.n_members,
       ROUND(CASE o.op WHEN 'total' THEN p.total ELSE p.total / p.n_members END, 6) AS answer_value, p.required
FROM (SELECT world_id, attr, category, COUNT(*) AS n_members, SUM(num) AS total, string_agg(entity, '|' ORDER BY entity) AS required
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY world_id, attr, category ORDER BY md5(attr || entity), entity) AS rn FROM num_attr) s
      WHERE rn <= 4 GROUP BY world_id, attr, category HAVING COUNT(*) >= 2) p
JOIN ({_OPS}) o ON o.attr = p.attr""")
def _(t: Tables) -> DataFrame:
    d = C.q_aggregation(t.entity_attr, t.attr_def, order())
    return d.withColumn("answer_value", F.round("answer_value", 6))


@query("q_cross_category", """
SELECT r.world_id, r.attr1, r.attr2, r.direction, k.k, ROUND(SUM(v2), 6) AS total, ROUND(SUM(v2) / k.k, 6) AS average,
       COUNT(DISTINCT category) AS n_categories, string_agg(entity, '|' ORDER BY entity) AS required
FROM (SELECT p.*, d.direction, COUNT(*) OVER (PARTITION BY world_id, attr1, attr2, d.direction) AS n,
        ROW_NUMBER() OVER (PARTITION BY world_id, attr1, attr2, d.direction
                           ORDER BY CASE d.direction WHEN 'highest' THEN -v1 ELSE v1 END, entity) AS rn
      FROM pair p CROSS JOIN (VALUES ('highest'), ('lowest')) d(direction)) r
JOIN (VALUES (3), (4), (5)) k(k) ON r.rn <= k.k
WHERE n >= 5 GROUP BY r.world_id, r.attr1, r.attr2, r.direction, k.k HAVING COUNT(DISTINCT category) >= 2""")
def _(t: Tables) -> DataFrame:
    d = C.q_cross_category(pairs(t))
    return d.withColumn("total", F.round("total", 6)).withColumn("average", F.round("average", 6))


@query("q_conditional", """
SELECT p.world_id, p.attr1, p.attr2, p.threshold, p.n_above, p.entity AS answer, p.v2 AS answer_value FROM (
  SELECT x.*, m.v1 AS threshold, COUNT(*) OVER (PARTITION BY x.world_id, x.attr1, x.attr2) AS n_above,
         ROW_NUMBER() OVER (PARTITION BY x.world_id, x.attr1, x.attr2 ORDER BY x.v2 DESC, x.entity DESC) AS best
  FROM pair x JOIN (
    SELECT world_id, attr1, attr2, v1 FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY world_id, attr1, attr2 ORDER BY v1) AS rn,
             COUNT(*) OVER (PARTITION BY world_id, attr1, attr2) AS n FROM pair) y WHERE rn = n // 2 + 1 AND n >= 4) m
  ON m.world_id = x.world_id AND m.attr1 = x.attr1 AND m.attr2 = x.attr2 WHERE x.v1 > m.v1) p
WHERE best = 1 AND n_above >= 2""")
def _(t: Tables) -> DataFrame:
    return C.q_conditional(pairs(t))


_RATIO = " UNION ALL ".join(f"SELECT '{a}' AS attr1, '{b}' AS attr2, '{c}' AS label" for a, b, c in catalogue.RATIO_PAIRS)


@query("q_ratio", f"""
SELECT a.world_id, a.entity, a.attr AS attr1, b.attr AS attr2, r.label, a.num / b.num AS answer_value
FROM num_attr a JOIN ({_RATIO}) r ON r.attr1 = a.attr
JOIN num_attr b ON b.world_id = a.world_id AND b.entity = a.entity AND b.attr = r.attr2 WHERE b.num <> 0""")
def _(t: Tables) -> DataFrame:
    return C.q_ratio(t.entity_attr, t.spark.createDataFrame(catalogue.RATIO_PAIRS, catalogue.RATIO_SCHEMA))


@query("q_comparison", """
SELECT e.world_id, e.first, e.second, a.attr, CASE WHEN a.num >= b.num THEN e.first ELSE e.second END AS answer,
       abs(a.num - b.num) AS answer_value
FROM (SELECT DISTINCT world_id, source AS first, target AS second FROM edge) e
JOIN num_attr a ON a.world_id = e.world_id AND a.entity = e.first
JOIN num_attr b ON b.world_id = e.world_id AND b.entity = e.second AND b.attr = a.attr""")
def _(t: Tables) -> DataFrame:
    p = t.edge.select("world_id", F.col("source").alias("first"), F.col("target").alias("second")).distinct()
    return C.q_comparison(p, t.entity_attr)


@query("q_delta", "SELECT world_id, entity, attr, seq, abs(new_val - old_val) AS answer_value FROM change "
       "WHERE kind = 'correction' AND old_val IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return C.q_delta(t.change)


@query("q_counterfactual", "SELECT world_id, entity, attr, seq, old_val AS answer_value FROM change "
       "WHERE kind = 'correction' AND old_val IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return C.q_counterfactual(t.change)


@query("q_multi_hop", """
WITH cats AS (
  SELECT world_id, attr1, attr2, category, COUNT(*) AS n, AVG(v1) AS mean1 FROM pair GROUP BY ALL HAVING COUNT(*) >= 2),
best AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY world_id, attr1, attr2 ORDER BY mean1 DESC, category) AS hi,
         ROW_NUMBER() OVER (PARTITION BY world_id, attr1, attr2 ORDER BY mean1, category) AS lo,
         COUNT(*) OVER (PARTITION BY world_id, attr1, attr2) AS nc FROM cats),
picked AS (SELECT *, 'highest' AS cd FROM best WHERE hi = 1 AND nc >= 2 UNION ALL SELECT *, 'lowest' FROM best WHERE lo = 1 AND nc >= 2),
members AS (
  SELECT b.world_id, b.attr1, b.attr2, b.category, b.cd, b.n, p.entity, p.v2,
         ROW_NUMBER() OVER (PARTITION BY b.world_id, b.attr1, b.attr2, b.cd ORDER BY p.v2 DESC, p.entity) AS top,
         ROW_NUMBER() OVER (PARTITION BY b.world_id, b.attr1, b.attr2, b.cd ORDER BY p.v2, p.entity) AS low
  FROM picked b JOIN pair p ON p.world_id = b.world_id AND p.attr1 = b.attr1 AND p.attr2 = b.attr2 AND p.category = b.category)
SELECT world_id, attr1, attr2, cd AS category_direction, 'highest' AS entity_direction, category, n AS n_members, entity AS answer, v2 AS answer_value
FROM members WHERE top = 1
UNION ALL SELECT world_id, attr1, attr2, cd, 'lowest', category, n, entity, v2 FROM members WHERE low = 1""")
def _(t: Tables) -> DataFrame:
    return C.q_multi_hop(pairs(t))


@query("q_outlier", """
SELECT world_id, attr, entity AS answer, ROUND(dev, 6) AS answer_value, required FROM (
  SELECT s.*, abs(num - mean) AS dev, ROW_NUMBER() OVER (PARTITION BY world_id, attr ORDER BY abs(num - mean) DESC, entity) AS rn
  FROM (SELECT x.*, m.mean, m.required FROM set5 x JOIN (
     SELECT world_id, attr, AVG(num) AS mean, string_agg(entity, '|' ORDER BY entity) AS required FROM set5
     GROUP BY world_id, attr HAVING COUNT(*) >= 5) m ON m.world_id = x.world_id AND m.attr = x.attr) s) y WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    return C.q_outlier(sets(t)).withColumn("answer_value", F.round("answer_value", 6))


_TREND = """
SELECT entity, slope, CASE WHEN slope > 0.15 THEN 'strongly rising' WHEN slope > 0.03 THEN 'slightly rising'
  WHEN slope < -0.15 THEN 'strongly falling' WHEN slope < -0.03 THEN 'slightly falling' ELSE 'flat' END AS answer
FROM (SELECT entity, ROUND(CASE WHEN AVG(v) = 0 THEN 0 ELSE regr_slope(v, i) / abs(AVG(v)) END, 9) AS slope
  FROM (SELECT entity, v, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY period) AS i FROM series) s
  GROUP BY entity HAVING COUNT(*) >= 3) t
"""


def series(t: Tables) -> DataFrame:
    return C.fold_series(t.series, ["entity"], "period", "v")


@query("q_temporal_trend", _TREND)
def _(t: Tables) -> DataFrame:
    return C.q_temporal_trend(series(t), ["entity"]).withColumn("slope", F.round("slope", 9))


@query("q_temporal_extreme", """
SELECT s.entity, MIN(CASE WHEN v = hi THEN i END) AS highest_period, MIN(CASE WHEN v = lo THEN i END) AS lowest_period
FROM (SELECT entity, v, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY period) AS i,
        MAX(v) OVER (PARTITION BY entity) AS hi, MIN(v) OVER (PARTITION BY entity) AS lo FROM series) s
GROUP BY s.entity HAVING COUNT(*) >= 3""")
def _(t: Tables) -> DataFrame:
    return C.q_temporal_extreme(series(t), ["entity"])


@query("q_text_match", """
WITH w AS (SELECT source AS world_id, doc_id, lower(text) AS low,
             list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''), lambda x: trim(x, '.,;:!?()"''')) AS ws
           FROM documents WHERE length(text) > 20),
g AS (SELECT DISTINCT world_id, doc_id, unnest(list_concat(
        list_filter(ws, lambda x: length(x) > 4),
        list_transform(list_filter(list_zip(ws[1:len(ws) - 1], ws[2:]), lambda p: length(p[1]) > 2 AND length(p[2]) > 2),
                       lambda p: p[1] || ' ' || p[2]))) AS phrase FROM w),
single AS (SELECT world_id, phrase, MIN(doc_id) AS doc_id FROM g GROUP BY world_id, phrase HAVING MIN(doc_id) = MAX(doc_id)),
tried AS (SELECT * FROM single)
SELECT t.world_id, t.phrase, t.doc_id AS answer FROM tried t JOIN w ON w.world_id = t.world_id AND contains(w.low, t.phrase)
GROUP BY t.world_id, t.phrase, t.doc_id HAVING COUNT(*) = 1 AND MIN(w.doc_id) = t.doc_id""")
def _(t: Tables) -> DataFrame:
    texts = spread(t.raw("documents").select(F.col("source").alias("world_id"), "doc_id", "text"))
    return C.q_text_match(texts, ["world_id"], "doc_id", "text")


@query("q_enum_filter", """
SELECT world_id, priority AS enum_value, attr, COUNT(*) AS n_members, arg_min(entity, {'v': -num, 'n': entity}) AS highest,
       arg_min(entity, {'v': num, 'n': entity}) AS lowest
FROM (SELECT a.world_id, a.entity, e.priority, a.attr, a.num FROM num_attr a
      JOIN entity e ON e.world_id = a.world_id AND e.entity = a.entity WHERE e.priority IS NOT NULL) x
GROUP BY world_id, priority, attr HAVING COUNT(*) >= 2""")
def _(t: Tables) -> DataFrame:
    return C.q_enum_filter(t.entity, "priority", NUMS)


@query("q_relationship_lookup", "SELECT world_id, source, relation, target AS answer FROM known_edge")
def _(t: Tables) -> DataFrame:
    return C.q_relationship_lookup(edges(t))


@query("q_relationship_hop", """
SELECT e.world_id, e.source, e.relation, e.target, a.attr, a.num AS answer_value
FROM known_edge e JOIN num_attr a ON a.world_id = e.world_id AND a.entity = e.target""")
def _(t: Tables) -> DataFrame:
    return C.q_relationship_hop(edges(t), t.entity_attr)


@query("q_relationship_chain", """
SELECT x.world_id, x.source AS a, x.relation AS r1, x.target AS b, y.relation AS r2, y.target AS c, n.attr, n.num AS answer_value
FROM known_edge x JOIN known_edge y ON y.world_id = x.world_id AND y.source = x.target AND y.target <> x.source
JOIN num_attr n ON n.world_id = y.world_id AND n.entity = y.target""")
def _(t: Tables) -> DataFrame:
    return C.q_relationship_chain(edges(t), t.entity_attr)


@query("q_relationship_count", "SELECT world_id, source, relation, COUNT(*) AS answer_value FROM known_edge "
       "GROUP BY world_id, source, relation HAVING COUNT(*) >= 2")
def _(t: Tables) -> DataFrame:
    return C.q_relationship_count(edges(t))


@query("q_relationship_filter", """
SELECT e.world_id, e.source, e.relation, n.attr, COUNT(*) AS n_targets, arg_min(e.target, {'v': -n.num, 'n': e.target}) AS highest,
       arg_min(e.target, {'v': n.num, 'n': e.target}) AS lowest
FROM known_edge e JOIN num_attr n ON n.world_id = e.world_id AND n.entity = e.target
GROUP BY e.world_id, e.source, e.relation, n.attr HAVING COUNT(*) >= 2""")
def _(t: Tables) -> DataFrame:
    return C.q_relationship_filter(edges(t), t.entity_attr)


@query("q_multi_constraint", """
WITH lo AS (SELECT world_id, acctbal AS cut FROM (SELECT world_id, acctbal, ROW_NUMBER() OVER (PARTITION BY world_id ORDER BY acctbal) AS rn,
      COUNT(*) OVER (PARTITION BY world_id) AS n FROM entity WHERE acctbal IS NOT NULL) x WHERE rn = n // 3 + 1),
hi AS (SELECT world_id, total_spend AS cut FROM (SELECT world_id, total_spend, ROW_NUMBER() OVER (PARTITION BY world_id ORDER BY total_spend) AS rn,
      COUNT(*) OVER (PARTITION BY world_id) AS n FROM entity WHERE total_spend IS NOT NULL) x WHERE rn = n - n // 3),
d AS (SELECT e.world_id, e.priority, lo.cut AS above, hi.cut AS below, COALESCE(e.acctbal > lo.cut AND e.total_spend < hi.cut, FALSE) AS hit,
        COUNT(*) OVER (PARTITION BY e.world_id) AS t
      FROM entity e JOIN lo ON lo.world_id = e.world_id JOIN hi ON hi.world_id = e.world_id)
SELECT world_id, above, below, CAST(NULL AS VARCHAR) AS enum_value, COUNT(*) FILTER (WHERE hit) AS answer_value FROM d WHERE t >= 5 GROUP BY world_id, above, below
UNION ALL SELECT world_id, above, below, priority, COUNT(*) FILTER (WHERE hit) FROM d WHERE t >= 5 AND priority IS NOT NULL GROUP BY world_id, above, below, priority""")
def _(t: Tables) -> DataFrame:
    return C.q_multi_constraint(t.entity, "acctbal", "total_spend", "priority")


@query("q_abstention", """
SELECT n.n_nationkey AS world_id, s.s_name AS entity, 'ABSTAIN' AS answer
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
UNION ALL SELECT (c.c_nationkey + 1) % 25, c.c_name, 'ABSTAIN' FROM customer c""")
def _(t: Tables) -> DataFrame:
    s = t.raw("supplier").select(F.col("s_nationkey").alias("world_id"), F.col("s_name").alias("entity"))
    c = t.raw("customer")
    real = c.select(F.col("c_nationkey").alias("world_id"), F.col("c_name").alias("entity"))
    moved = c.select(((F.col("c_nationkey") + 1) % 25).cast("int").alias("world_id"), F.col("c_name").alias("entity"))
    return C.q_abstention(s.unionByName(real).unionByName(moved), t.entity)


SQL["quota_in"] = """
SELECT n.n_nationkey AS world_id, COUNT(c.c_custkey) AS n_questions,
       COUNT(*) FILTER (WHERE c.c_acctbal < CASE WHEN n.n_regionkey = 0 THEN -2000 ELSE 0 END) AS n_corrections,
       COUNT(*) FILTER (WHERE c.c_acctbal > 9700) AS n_contradictions,
       CASE WHEN n.n_regionkey = 1 THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS w_retrieval,
       CASE WHEN n.n_regionkey = 1 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS w_update, 0.15::DOUBLE AS w_abstention
FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_regionkey
"""
SQL["quota"] = """
SELECT *, n_questions - n_retrieval - n_update - n_abstention - n_trick - n_delta - n_contradiction AS n_comprehension FROM (
  SELECT *, CAST(round_even(n_questions * CASE WHEN n_corrections > 0 THEN w_retrieval ELSE w_retrieval + w_update * 0.5::DOUBLE END, 0) AS BIGINT) - n_trick AS n_retrieval,
         GREATEST(1, CAST(round_even(n_questions * CASE WHEN n_corrections > 0 THEN w_abstention ELSE w_abstention * 0.67::DOUBLE END, 0) AS BIGINT)) AS n_abstention,
         CASE WHEN n_update > 0 THEN GREATEST(1, n_update // 3) ELSE 0 END AS n_delta FROM (
    SELECT *, CASE WHEN n_corrections > 0 THEN GREATEST(0, LEAST(GREATEST(1, CAST(round_even(n_questions * w_update, 0) AS BIGINT)) - n_contradiction, n_corrections)) ELSE 0 END AS n_update FROM (
      SELECT *, LEAST(2, GREATEST(1, n_questions // 10)) AS n_trick,
             CASE WHEN n_contradictions > 0 THEN LEAST(n_contradictions, GREATEST(1, n_questions // 10)) ELSE 0 END AS n_contradiction FROM quota_in) a) b) c
"""


def quota_in(t: Tables) -> DataFrame:
    c = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    one = F.col("n_regionkey") == 1
    return c.groupBy(F.col("n_nationkey").alias("world_id"), "n_regionkey").agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if(F.col("c_acctbal") < F.when(F.col("n_regionkey") == 0, -2000).otherwise(0)).alias("n_corrections"),
        F.count_if(F.col("c_acctbal") > 9700).alias("n_contradictions"),
    ).select(
        "world_id", "n_questions", "n_corrections", "n_contradictions",
        F.when(one, 0.3).otherwise(0.4).alias("w_retrieval"), F.when(one, 0.3).otherwise(0.2).alias("w_update"),
        F.lit(0.15).alias("w_abstention"),
    )


_Q = ["n_retrieval", "n_update", "n_delta", "n_contradiction", "n_comprehension", "n_abstention", "n_trick"]


@query("question_quota", "SELECT world_id, n_questions, n_corrections, n_contradictions, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _Q) + " FROM quota")
def _(t: Tables) -> DataFrame:
    return C.question_quota(quota_in(t)).select("world_id", "n_questions", "n_corrections", "n_contradictions", *_Q)


@query("question_slots", "SELECT world_id, kind, unnest(range(n)) AS slot FROM (" + " UNION ALL ".join(
    f"SELECT world_id, '{k}' AS kind, CAST(n_{k} AS BIGINT) AS n FROM quota" for k in C.QUOTA_KINDS) + ") x WHERE n > 0")
def _(t: Tables) -> DataFrame:
    return C.question_slots(C.question_quota(quota_in(t)), ["world_id"])


SQL["candidate"] = """
SELECT world_id, 'ratio' AS competency, entity AS candidate_id FROM entity WHERE total_spend IS NOT NULL
UNION ALL SELECT world_id, 'enum_filter', entity FROM entity WHERE priority = '5-LOW'
UNION ALL SELECT world_id, 'multi_constraint', entity FROM entity WHERE acctbal > 9800
UNION ALL SELECT DISTINCT world_id, 'relationship_lookup', source FROM known_edge
"""


def candidates(t: Tables) -> DataFrame:
    e = t.entity
    named = lambda d, n, c="entity": d.select("world_id", F.lit(n).alias("competency"), F.col(c).alias("candidate_id"))
    return (
        named(e.where(F.col("total_spend").isNotNull()), "ratio")
        .unionByName(named(e.where(F.col("priority") == "5-LOW"), "enum_filter"))
        .unionByName(named(e.where(F.col("acctbal") > 9800), "multi_constraint"))
        .unionByName(named(edges(t), "relationship_lookup", "source").distinct())
    )


_TYPES = ", ".join(f"'{x}'" for x in C.COMPREHENSION_TYPES)


def _fill_sql(slots: str, slot_id: str, primary: str) -> str:
    return f"""
SELECT s.world_id, s.{slot_id}, s.competency, c.candidate_id FROM (
  SELECT *, (ROW_NUMBER() OVER (PARTITION BY world_id, competency
               ORDER BY substr(md5(CAST({slot_id} AS VARCHAR)), 1, 2), {slot_id}) - 1) % n + 1 AS pos FROM (
    SELECT x.*, h.competency, h.n, ROW_NUMBER() OVER (PARTITION BY x.world_id, x.{slot_id}
        ORDER BY CASE WHEN h.competency = {primary} THEN 0 ELSE list_position([{_TYPES}], h.competency) END) AS pref
    FROM ({slots}) x JOIN (SELECT world_id, competency, COUNT(*) AS n FROM candidate GROUP BY world_id, competency) h
      ON h.world_id = x.world_id) y WHERE pref = 1) s
JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY world_id, competency
        ORDER BY substr(md5(candidate_id), 1, 2), candidate_id) AS pos FROM candidate) c
  ON c.world_id = s.world_id AND c.competency = s.competency AND c.pos = s.pos"""


@query("assign_questions", _fill_sql(
    "SELECT world_id, unnest(range(CAST(n_comprehension AS BIGINT))) AS slot FROM quota WHERE n_comprehension > 0",
    "slot", f"[{_TYPES}][CAST(x.slot % {len(C.COMPREHENSION_TYPES)} AS INT) + 1]"))
def _(t: Tables) -> DataFrame:
    slots = C.question_slots(C.question_quota(quota_in(t)), ["world_id"]).where(F.col("kind") == "comprehension")
    return C.assign_questions(slots.drop("kind"), candidates(t), ["world_id"])


# Questions asked about entities: the required ones are the customer and the customer of the next order.
SQL["asked"] = """
SELECT c.c_nationkey AS world_id, o.o_orderkey AS question_id,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'retrieval' WHEN '2-HIGH' THEN 'comparison' WHEN '3-MEDIUM' THEN 'update'
            WHEN '4-NOT SPECIFIED' THEN 'ratio' ELSE 'abstention' END AS competency
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
"""
SQL["required"] = """
SELECT c.c_nationkey AS world_id, o.o_orderkey AS question_id, c.c_name AS entity FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
UNION ALL SELECT c.c_nationkey, o.o_orderkey, d.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN orders o2 ON o2.o_orderkey = o.o_orderkey + 1 JOIN customer d ON d.c_custkey = o2.o_custkey WHERE d.c_nationkey = c.c_nationkey
"""
SQL["stored"] = "SELECT world_id, entity FROM entity WHERE total_spend IS NOT NULL"
SQL["updated"] = "SELECT world_id, entity FROM entity WHERE acctbal IS NOT NULL"
SQL["coverage"] = "SELECT world_id, COUNT(total_spend) AS n_stored, CAST(COUNT(total_spend) AS DOUBLE) / COUNT(*) AS coverage FROM entity GROUP BY world_id"
SQL["answerable"] = """
SELECT q.world_id, q.question_id, q.competency,
  CASE WHEN q.competency = 'abstention' THEN c.coverage >= 0.5 WHEN q.competency IN ('update', 'delta', 'counterfactual') THEN r.s AND r.u
       ELSE r.s END AS answerable
FROM asked q JOIN coverage c ON c.world_id = q.world_id
JOIN (SELECT r.world_id, r.question_id, BOOL_AND(s.entity IS NOT NULL) AS s, BOOL_AND(u.entity IS NOT NULL) AS u
      FROM required r LEFT JOIN stored s ON s.world_id = r.world_id AND s.entity = r.entity
      LEFT JOIN updated u ON u.world_id = r.world_id AND u.entity = r.entity GROUP BY r.world_id, r.question_id) r
  ON r.world_id = q.world_id AND r.question_id = q.question_id
"""


def coverage(t: Tables) -> DataFrame:
    return t.entity.groupBy("world_id").agg(
        F.count("total_spend").alias("n_stored"), (F.count("total_spend") / F.count(F.lit(1))).alias("coverage")
    )


def answerable(t: Tables) -> DataFrame:
    c = t.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("world_id"), F.col("c_name").alias("entity"))
    o = t.raw("orders").join(c, "o_custkey")
    p = F.col("o_orderpriority")
    asked = o.select(
        "world_id", F.col("o_orderkey").alias("question_id"),
        F.when(p == "1-URGENT", "retrieval").when(p == "2-HIGH", "comparison").when(p == "3-MEDIUM", "update")
        .when(p == "4-NOT SPECIFIED", "ratio").otherwise("abstention").alias("competency"),
    )
    own = o.select("world_id", F.col("o_orderkey").alias("question_id"), "entity")
    nxt = o.select("world_id", (F.col("o_orderkey") - 1).alias("question_id"), "entity")
    also = nxt.join(asked.select("world_id", "question_id"), ["world_id", "question_id"], "left_semi")
    return H.answerability(
        asked, own.unionByName(also), t.entity.where(F.col("total_spend").isNotNull()),
        t.entity.where(F.col("acctbal").isNotNull()), coverage(t).select("world_id", "coverage"), ["world_id"],
    )


@query("answerability", "SELECT world_id, question_id, competency, answerable FROM answerable")
def _(t: Tables) -> DataFrame:
    return answerable(t)


@query("replace_unanswerable", f"""
SELECT a.world_id, a.question_id, a.competency AS asked_competency, COALESCE(f.competency, a.competency) AS competency, f.candidate_id,
       f.candidate_id IS NOT NULL AS replaced
FROM answerable a LEFT JOIN ({_fill_sql('''SELECT q.* FROM (SELECT world_id, question_id, competency AS asked FROM answerable
  WHERE NOT answerable AND competency NOT IN ('retrieval', 'update', 'abstention', 'delta')) q
  JOIN coverage c ON c.world_id = q.world_id AND c.n_stored >= 2''', 'question_id', 'x.asked')}) f
ON f.world_id = a.world_id AND f.question_id = a.question_id""")
def _(t: Tables) -> DataFrame:
    t.keep("entity")
    return C.replace_unanswerable(answerable(t), candidates(t), coverage(t), ["world_id"])
