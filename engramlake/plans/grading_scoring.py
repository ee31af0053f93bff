"""Grading (G) and scoring (H) bound to the answer fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.functions import answers as A
from engramlake.operators import grading as G
from engramlake.operators import scoring as H
from engramlake.plans.fixtures import SQL, Tables
from engramlake.plans.registry import query


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _sql_stripped(x: str) -> str:
    return f"strip(translate({x}, ',$', ''))"


NUM_RE = r"(-?(?:\d+\.?\d*|\.\d+))\s*([KkMm])?"


def _sql_num(x: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({_sql_stripped(x)}, '{NUM_RE}', 1), '') AS DOUBLE)"


def _sql_suffix(x: str) -> str:
    return f"upper(regexp_extract({_sql_stripped(x)}, '{NUM_RE}', 2))"


def _sql_factor(x: str) -> str:
    return f"(CASE {_sql_suffix(x)} WHEN 'K' THEN 1000.0 WHEN 'M' THEN 1000000.0 ELSE 1.0 END)"


def _sql_close(v: str, goal: str, truth: str) -> str:
    return (
        f"(CASE WHEN NOT contains({truth}, '.') THEN round_even({v}, 0) = round_even({goal}, 0) "
        f"WHEN {goal} = 0 THEN {v} = 0 ELSE abs({v} - {goal}) / abs({goal}) <= 0.02 END)"
    )


def sql_numeric(a: str, t: str) -> str:
    goal = (
        f"(CASE WHEN regexp_matches(strip({t}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') "
        f"THEN TRY_CAST(strip({t}) AS DOUBLE) ELSE {_sql_num(t)} END)"
    )
    plain = _sql_num(a)
    return (
        f"COALESCE({_sql_close(f'({plain} * {_sql_factor(a)})', goal, t)} OR {_sql_close(plain, goal, t)}, FALSE)"
    )


def _sql_bare(x: str) -> str:
    return (
        f"strip(regexp_replace(regexp_replace({x}, '\\s*\\([^)]*\\)\\s*$', ''), "
        f"'(?i)^(dr|mr|mrs|ms|prof|sr|jr)\\.?\\s+', ''))"
    )


def sql_entity(a: str, t: str) -> str:
    goal, said = _sql_bare(t), _sql_bare(a)
    gt = f"regexp_extract_all(lower({goal}), '[a-z0-9]+')"
    at = f"regexp_extract_all(lower({said}), '[a-z0-9]+')"
    return (
        f"COALESCE(CASE WHEN len({gt}) = 0 THEN lower({said}) = lower({goal}) "
        f"WHEN length({said}) < length({goal}) * 0.5 THEN FALSE "
        f"ELSE CAST(len(list_filter({gt}, lambda w: list_contains({at}, w))) AS DOUBLE) / len({gt}) >= 0.67 END, FALSE)"
    )


NV_RE = r"^(.+?)\s*\(([^)]+)\)\s*$"


def sql_name_value(a: str, t: str) -> str:
    name = f"strip(regexp_extract(strip({t}), '{NV_RE}', 1))"
    value = f"strip(regexp_extract(strip({t}), '{NV_RE}', 2))"
    return (
        f"(CASE WHEN regexp_matches(strip({t}), '{NV_RE}') THEN {sql_entity(a, name)} AND {sql_numeric(a, value)} "
        f"ELSE {sql_entity(a, f'strip({t})')} END)"
    )


def sql_abstention(a: str) -> str:
    any_phrase = " OR ".join("contains(lower({0}), '{1}')".format(a, p.replace("'", "''")) for p in A.REFUSAL_PHRASES)
    return f"(({any_phrase}) AND NOT regexp_matches({a}, '\\d'))"


def sql_rule(a: str, t: str, c: str) -> str:
    return (
        f"(CASE WHEN lower(strip({a})) = lower(strip({t})) THEN TRUE "
        f"WHEN {c} IN ({_sql_list(A.NUMERIC_TYPES)}) THEN {sql_numeric(f'strip({a})', t)} "
        f"WHEN {c} IN ({_sql_list(A.NAME_VALUE_TYPES)}) THEN {sql_name_value(f'strip({a})', t)} "
        f"WHEN {c} IN ({_sql_list(A.ENTITY_TYPES)}) THEN {sql_entity(f'strip({a})', f'strip({t})')} "
        f"WHEN {c} = 'temporal_trend' THEN contains(lower({a}), lower(strip({t}))) "
        f"WHEN {c} = 'abstention' THEN {sql_abstention(a)} ELSE FALSE END)"
    )


SQL["graded"] = f"""
SELECT *, CASE WHEN competency = 'abstention' THEN 'rule:abstention' WHEN strip(answer) = '' THEN 'rule:empty_answer'
          WHEN correct THEN 'rule:pass' ELSE 'rule:fail' END AS reason
FROM (SELECT *, {sql_rule('answer', 'truth', 'competency')} AS correct FROM answer) g
"""

_REASONING = _sql_list(H.REASONING)
SQL["run_info"] = """
SELECT s_suppkey AS run_id, CAST(20 + s_suppkey % 100 AS BIGINT) AS n_entities,
       CAST(s_nationkey AS BIGINT) AS stored_count, CAST(CASE WHEN s_acctbal > 0 THEN 300 ELSE 0 END AS BIGINT) AS write_budget
FROM supplier
"""
SQL["axis"] = f"""
SELECT g.run_id, g.model, g.template,
  COALESCE(AVG(CASE WHEN competency = 'retrieval' THEN CAST(correct AS INT) END), 0) AS breadth,
  COALESCE(AVG(CASE WHEN competency = 'update' THEN CAST(correct AS INT) END), 0)
    * LEAST(CAST(MAX(stored_count) AS DOUBLE) / MAX(n_entities) / 0.5, 1.0) AS maintenance,
  COALESCE(AVG(CASE WHEN competency IN ({_REASONING}) THEN CAST(correct AS INT) END), 0) AS reasoning,
  CASE WHEN MAX(write_budget) > 0 THEN LEAST(CAST(COUNT(*) FILTER (WHERE correct AND competency <> 'abstention') AS DOUBLE)
    / MAX(write_budget), 1.0) ELSE 0.0 END AS efficiency,
  COALESCE(AVG(CASE WHEN competency = 'abstention' THEN CAST(correct AS INT) END), 0) AS abstention_diagnostic,
  COALESCE(AVG(CASE WHEN competency = 'update' THEN CAST(correct AS INT) END), 0) AS maintenance_ungated
FROM graded g JOIN run_info r ON r.run_id = g.run_id GROUP BY g.run_id, g.model, g.template
"""
SQL["scored_run"] = """
SELECT a.*, 0.30 * breadth + 0.25 * maintenance + 0.25 * reasoning + 0.20 * efficiency AS composite,
       0.30 * breadth + 0.25 * maintenance_ungated + 0.25 * reasoning + 0.20 * efficiency AS composite_ungated
FROM axis a
"""
SQL["run_competency"] = """
SELECT run_id, model, template, competency, COUNT(*) FILTER (WHERE correct) AS n_correct, COUNT(*) AS n_total,
       CAST(COUNT(*) FILTER (WHERE correct) AS DOUBLE) / COUNT(*) AS rate
FROM graded GROUP BY run_id, model, template, competency
"""
AXES = ["breadth", "maintenance", "reasoning", "efficiency", "abstention_diagnostic"]


def graded(t: Tables) -> DataFrame:
    return G.grade_answers(t.answer)


def run_info(t: Tables) -> DataFrame:
    return t.raw("supplier").select(
        F.col("s_suppkey").alias("run_id"),
        (20 + F.col("s_suppkey") % 100).cast("bigint").alias("n_entities"),
        F.col("s_nationkey").cast("bigint").alias("stored_count"),
        F.when(F.col("s_acctbal") > 0, 300).otherwise(0).cast("bigint").alias("write_budget"),
    )


RUN = ["run_id", "model", "template"]


def axes(t: Tables) -> DataFrame:
    counts = run_competency(t)
    runs = counts.select(*RUN).distinct().join(run_info(t), "run_id")
    return H.axes_from_counts(counts, runs, RUN)


def scored_runs(t: Tables) -> DataFrame:
    return H.composite(axes(t))


def run_competency(t: Tables) -> DataFrame:
    return H.group_accuracy(graded(t), [*RUN, "competency"])


def rounded(df: DataFrame, cols: list[str], digits: int = 9) -> DataFrame:
    """Presentation step of a registered query: hide float summation order."""
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("extract_numbers", f"""
SELECT competency, COUNT(*) AS n, COUNT(*) FILTER (WHERE num IS NULL) AS n_unparsable,
       COUNT(*) FILTER (WHERE suffix <> '') AS n_suffix, MIN(num * factor) AS min_number, MAX(num * factor) AS max_number
FROM (SELECT competency, {_sql_num('answer')} AS num, {_sql_suffix('answer')} AS suffix, {_sql_factor('answer')} AS factor
      FROM answer) a GROUP BY competency""")
def _(t: Tables) -> DataFrame:
    return G.number_audit(t.answer, ["competency"])


def _audit(df: DataFrame) -> DataFrame:
    return df.groupBy("model", "competency").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_pass")
    )


def _audit_sql(rule: str) -> str:
    return (
        f"SELECT model, competency, COUNT(*) AS n, COUNT(*) FILTER (WHERE correct) AS n_pass "
        f"FROM (SELECT model, competency, {rule} AS correct FROM answer) a GROUP BY model, competency"
    )


@query("grade_numeric", _audit_sql(sql_numeric("strip(answer)", "truth")))
def _(t: Tables) -> DataFrame:
    return _audit(G.grade_numeric(t.answer))


@query("grade_entity", _audit_sql(sql_entity("strip(answer)", "strip(truth)")))
def _(t: Tables) -> DataFrame:
    return _audit(G.grade_entity(t.answer))


@query("grade_name_value", _audit_sql(sql_name_value("strip(answer)", "truth")))
def _(t: Tables) -> DataFrame:
    return _audit(G.grade_name_value(t.answer))


@query("grade_abstention", _audit_sql(sql_abstention("strip(answer)")))
def _(t: Tables) -> DataFrame:
    return _audit(G.grade_abstention(t.answer))


@query("grade_answers", """
SELECT model, template, competency, reason, COUNT(*) AS n, COUNT(*) FILTER (WHERE correct) AS n_correct
FROM graded GROUP BY model, template, competency, reason""")
def _(t: Tables) -> DataFrame:
    return G.grading_audit(graded(t), ["model", "template", "competency"])


# One logged judge reply per (run, question): the reply text quotes both tokens, the last one counts.
SQL["reply"] = """
SELECT o_orderkey AS question_id,
       CASE o_orderstatus WHEN 'F' THEN 'answer says VERDICT_INCORRECT but VERDICT_CORRECT'
            WHEN 'O' THEN 'VERDICT_CORRECT is wrong here: verdict_incorrect' ELSE 'cannot tell' END AS reply
FROM orders WHERE o_orderpriority <> '5-LOW'
"""


@query("apply_judge_verdicts", """
SELECT competency, reason, COUNT(*) AS n, COUNT(*) FILTER (WHERE correct) AS n_correct FROM (
  SELECT competency,
    CASE WHEN g.reason <> 'rule:fail' THEN correct ELSE COALESCE(upper(v) = 'VERDICT_CORRECT', FALSE) END AS correct,
    CASE WHEN g.reason <> 'rule:fail' THEN g.reason WHEN reply IS NULL THEN 'judge:no_reply' WHEN v IS NULL THEN 'judge:no_verdict'
         WHEN upper(v) = 'VERDICT_CORRECT' THEN 'judge:correct' ELSE 'judge:incorrect' END AS reason
  FROM graded g LEFT JOIN (
    SELECT question_id, reply, regexp_extract_all(reply, '(?i)(VERDICT_CORRECT|VERDICT_INCORRECT)', 1)[-1] AS v FROM reply
  ) r ON r.question_id = g.question_id) x
GROUP BY competency, reason""")
def _(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    replies = t.raw("orders").where(F.col("o_orderpriority") != "5-LOW").select(
        F.col("o_orderkey").alias("question_id"),
        F.when(s == "F", "answer says VERDICT_INCORRECT but VERDICT_CORRECT")
        .when(s == "O", "VERDICT_CORRECT is wrong here: verdict_incorrect").otherwise("cannot tell").alias("reply"),
    )
    return G.grading_audit(G.apply_judge_verdicts(graded(t), replies, ["question_id"]), ["competency"])


_N = "TRY_CAST(translate(lower(strip({0})), ',%', '') AS DOUBLE)"


@query("single_turn_score", f"""
SELECT model, competency, score, COUNT(*) AS n FROM (
  SELECT model, competency, COALESCE(CAST(reward AS DOUBLE),
    CASE WHEN answer = '' OR truth = '' THEN CAST(0 AS DOUBLE) WHEN lower(strip(answer)) = lower(strip(truth)) THEN 1.0
         WHEN COALESCE(CASE WHEN {_N.format('truth')} = 0 THEN {_N.format('answer')} = 0
              ELSE abs({_N.format('answer')} - {_N.format('truth')}) / abs({_N.format('truth')}) <= 0.02 END, FALSE) THEN 1.0
         ELSE 0.0 END) AS score
  FROM (SELECT *, CASE WHEN model = 'N' AND template = 'O' THEN 0.25 END AS reward FROM answer) a) b
GROUP BY model, competency, score""")
def _(t: Tables) -> DataFrame:
    a = t.answer.withColumn("reward", F.when((F.col("model") == "N") & (F.col("template") == "O"), 0.25))
    return G.single_turn_score(a).groupBy("model", "competency", "score").agg(F.count(F.lit(1)).alias("n"))


@query("competency_accuracy", "SELECT run_id, competency, SUM(CAST(correct AS BIGINT))::BIGINT AS n_correct, COUNT(*) AS n_total, "
       "CAST(SUM(CAST(correct AS BIGINT)) AS DOUBLE) / COUNT(*) AS rate FROM graded GROUP BY run_id, competency")
def _(t: Tables) -> DataFrame:
    return H.group_accuracy(graded(t), ["run_id", "competency"])


@query("purpose_accuracy", "SELECT run_id, purpose, COUNT(*) FILTER (WHERE correct) AS n_correct, COUNT(*) AS n_total, "
       "CAST(COUNT(*) FILTER (WHERE correct) AS DOUBLE) / COUNT(*) AS rate FROM (SELECT *, CASE competency WHEN 'retrieval' THEN 'recall' "
       "WHEN 'update' THEN 'update' WHEN 'abstention' THEN 'abstention' ELSE 'comprehension' END AS purpose FROM graded) g "
       "GROUP BY run_id, purpose")
def _(t: Tables) -> DataFrame:
    c = F.col("competency")
    g = graded(t).withColumn(
        "purpose",
        F.when(c == "retrieval", "recall").when(c.isin("update", "abstention"), c).otherwise("comprehension"),
    )
    return H.group_accuracy(g, ["run_id", "purpose"])


_AXCOLS = ", ".join(f"ROUND({c}, 9) AS {c}" for c in [*AXES, "maintenance_ungated"])


@query("axis_scores", f"SELECT run_id, model, template, {_AXCOLS} FROM axis")
def _(t: Tables) -> DataFrame:
    return rounded(axes(t), [*AXES, "maintenance_ungated"])


@query("composite", "SELECT run_id, model, template, ROUND(composite, 9) AS composite, "
       "ROUND(composite_ungated, 9) AS composite_ungated FROM scored_run")
def _(t: Tables) -> DataFrame:
    d = scored_runs(t).select(*RUN, "composite", "composite_ungated")
    return rounded(d, ["composite", "composite_ungated"])


_MS = ", ".join(
    f"ROUND(AVG({c}), 9) AS {c}_mean, ROUND(CASE WHEN COUNT({c}) > 1 THEN STDDEV_SAMP({c}) / SQRT(COUNT({c})) ELSE 0.0 END, 9) AS {c}_stderr"
    for c in ["composite", *AXES]
)


@query("mean_stderr", f"SELECT model, template, COUNT(*) AS n, {_MS} FROM scored_run GROUP BY model, template")
def _(t: Tables) -> DataFrame:
    d = H.mean_stderr(scored_runs(t), ["model", "template"], ["composite", *AXES])
    return rounded(d, [c for c in d.columns if c.endswith(("_mean", "_stderr"))])


@query("leaderboard", """
SELECT b.model, ROUND(avg_score, 9) AS avg_score, ROUND(avg_composite, 9) AS avg_composite, n_evals, templates,
       ROUND(retrieval, 9) AS retrieval, ROUND("update", 9) AS "update", ROUND(abstention, 9) AS abstention,
       ROUND(reasoning_mean, 9) AS reasoning_mean,
       ROW_NUMBER() OVER (ORDER BY avg_composite DESC, b.model) AS position
FROM (SELECT s.model, AVG(score) AS avg_score, AVG(composite) AS avg_composite, COUNT(*) AS n_evals,
             string_agg(DISTINCT s.template, ',' ORDER BY s.template) AS templates
      FROM scored_run s JOIN (SELECT run_id, model, template, AVG(CAST(correct AS INT)) AS score FROM graded
                              GROUP BY run_id, model, template) g
        ON g.run_id = s.run_id AND g.model = s.model AND g.template = s.template GROUP BY s.model) b
JOIN (SELECT model, COALESCE(AVG(CASE WHEN competency = 'retrieval' THEN rate END), 0) AS retrieval,
             COALESCE(AVG(CASE WHEN competency = 'update' THEN rate END), 0) AS "update",
             COALESCE(AVG(CASE WHEN competency = 'abstention' THEN rate END), 0) AS abstention,
             AVG(CASE WHEN competency NOT IN ('retrieval', 'update', 'abstention') THEN rate END) AS reasoning_mean
      FROM run_competency GROUP BY model) r ON r.model = b.model""")
def leaderboard(t: Tables) -> DataFrame:
    counts = run_competency(t)
    score = counts.groupBy(*RUN).agg((F.sum("n_correct") / F.sum("n_total")).alias("score"))
    # the joins below ask for non-null keys; asking here too lets every branch share one grading
    keyed = counts.where(F.col("run_id").isNotNull() & F.col("model").isNotNull() & F.col("template").isNotNull())
    d = H.leaderboard(scored_runs(t).join(score, RUN), keyed)
    return rounded(d, ["avg_score", "avg_composite", "retrieval", "update", "abstention", "reasoning_mean"])


@query("score_rollup", """
SELECT template, run_id AS seed, CAST(GROUPING(template) * 2 + GROUPING(run_id) AS BIGINT) AS level, COUNT(*) AS n,
       ROUND(AVG(composite), 9) AS mean,
       ROUND(CASE WHEN COUNT(*) > 1 THEN STDDEV_SAMP(composite) / SQRT(COUNT(*)) ELSE 0.0 END, 9) AS stderr
FROM scored_run GROUP BY ROLLUP (template, run_id)""")
def _(t: Tables) -> DataFrame:
    d = H.score_rollup(scored_runs(t).withColumnRenamed("run_id", "seed"))
    return rounded(d, ["mean", "stderr"])


@query("pooled_competency", """
SELECT competency, template, CAST(SUM(n_correct) AS BIGINT) AS n_correct, CAST(SUM(n_total) AS BIGINT) AS n_total,
       CAST(SUM(n_correct) AS DOUBLE) / SUM(n_total) AS rate FROM run_competency GROUP BY competency, template""")
def _(t: Tables) -> DataFrame:
    return H.pooled_competency(run_competency(t), ["competency", "template"])


_WIDE = ["retrieval", "update", "synthesis", "aggregation", "abstention", "multi_constraint", "enum_filter"]


@query("score_wide", "SELECT run_id, " + ", ".join(
    f"ROUND(AVG(CASE WHEN competency = '{c}' THEN CAST(correct AS DOUBLE) END), 9) AS comp_{c}" for c in _WIDE
) + " FROM graded GROUP BY run_id")
def _(t: Tables) -> DataFrame:
    d = H.score_wide(graded(t), ["run_id"], "competency", _WIDE, "comp")
    return rounded(d, d.columns[1:])


@query("grade_labels", """
SELECT d.source AS run_id, d.lang AS competency, COUNT(*) FILTER (WHERE l.quality = 1) AS n_correct, COUNT(*) AS n_total,
       CAST(COUNT(*) FILTER (WHERE l.quality = 1) AS DOUBLE) / COUNT(*) AS rate
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source, d.lang""")
def _(t: Tables) -> DataFrame:
    g = t.raw("labels").join(t.raw("documents").select("doc_id", "source", "lang"), "doc_id").select(
        F.col("source").alias("run_id"), F.col("lang").alias("competency"), (F.col("quality") == 1).alias("correct")
    )
    return H.group_accuracy(g, ["run_id", "competency"])


_STRATEGY = "CASE l_linenumber WHEN 1 THEN 'perfect' WHEN 2 THEN 'strategic' WHEN 3 THEN 'naive' WHEN 4 THEN 'guesser' WHEN 5 THEN 'abstainer' WHEN 6 THEN 'smart_guesser' ELSE 'priority_strategic' END"
_WIN = "CASE l_linenumber WHEN 1 THEN l_quantity >= 0 WHEN 2 THEN l_quantity > 18 WHEN 3 THEN l_quantity > 40 WHEN 4 THEN l_quantity < 0 WHEN 5 THEN l_quantity > 45 WHEN 6 THEN l_quantity > 49 ELSE l_quantity > 16 END"
SQL["strategy_run"] = f"""
SELECT strategy, template, seed, AVG(CAST(correct AS INT)) AS accuracy FROM (
  SELECT {_STRATEGY} AS strategy, l_returnflag AS template, l_suppkey AS seed, {_WIN} AS correct FROM lineitem) s
GROUP BY strategy, template, seed
"""


def strategy_runs(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(
        F.expr(_STRATEGY).alias("strategy"), F.col("l_returnflag").alias("template"),
        F.col("l_suppkey").alias("seed"), F.expr(_WIN).alias("correct"),
    ).groupBy("strategy", "template", "seed").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"))


@query("strategy_means", "SELECT strategy, template, ROUND(AVG(accuracy), 9) AS mean_accuracy, COUNT(*) AS n "
       "FROM strategy_run GROUP BY strategy, template")
def _(t: Tables) -> DataFrame:
    return rounded(H.strategy_means(strategy_runs(t)), ["mean_accuracy"])


@query("strategy_compare", """
SELECT a.template, COUNT(*) AS n, COUNT(*) FILTER (WHERE a.accuracy > b.accuracy) AS wins,
       COUNT(*) FILTER (WHERE a.accuracy = b.accuracy) AS ties, COUNT(*) FILTER (WHERE a.accuracy < b.accuracy) AS losses,
       ROUND(AVG(a.accuracy - b.accuracy), 9) AS mean_gap
FROM strategy_run a JOIN strategy_run b ON b.template = a.template AND b.seed = a.seed
WHERE a.strategy = 'priority_strategic' AND b.strategy = 'strategic' GROUP BY a.template""")
def _(t: Tables) -> DataFrame:
    return rounded(H.strategy_compare(strategy_runs(t), "priority_strategic", "strategic"), ["mean_gap"])


_NAMES = ["perfect", "strategic", "naive", "guesser", "abstainer", "smart_guesser"]


# what an answer of a strategy's run is about; each tenth order asks a trick
_ASKED = "CASE l_orderkey % 5 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'update' WHEN 2 THEN 'synthesis' WHEN 3 THEN 'aggregation' ELSE 'abstention' END"
RUN_ENTITIES, RUN_STORED, RUN_WRITES = 60, 40, 30
SQL["strategy_composite"] = f"""
SELECT strategy, template, seed, tricks_right, {H.WEIGHTS['breadth']} * breadth + {H.WEIGHTS['maintenance']} * maintenance
       + {H.WEIGHTS['reasoning']} * reasoning + {H.WEIGHTS['efficiency']} * LEAST(n_right / {RUN_WRITES}::DOUBLE, 1) AS composite
FROM (SELECT strategy, template, seed, COUNT(*) FILTER (WHERE correct AND asked <> 'abstention') AS n_right,
        COALESCE(AVG(CASE WHEN asked = 'retrieval' THEN CAST(correct AS INT) END), 0) AS breadth,
        COALESCE(AVG(CASE WHEN asked = 'update' THEN CAST(correct AS INT) END), 0)
          * LEAST({RUN_STORED / RUN_ENTITIES}::DOUBLE / {H.COVERAGE_GATE}, 1) AS maintenance,
        COALESCE(AVG(CASE WHEN asked IN ('synthesis', 'aggregation') THEN CAST(correct AS INT) END), 0) AS reasoning,
        SUM(CASE WHEN trick THEN CAST(correct AS INT) END) AS tricks_right
      FROM (SELECT {_STRATEGY} AS strategy, l_returnflag AS template, l_suppkey AS seed, {_WIN} AS correct, {_ASKED} AS asked,
              l_orderkey % 10 = 0 AS trick FROM lineitem) a GROUP BY strategy, template, seed) r
"""


def strategy_composites(t: Tables) -> DataFrame:
    """Composite and right answers to tricks of every run of a strategy."""
    keys = ["strategy", "template", "seed"]
    a = t.raw("lineitem").select(
        F.expr(_STRATEGY).alias("strategy"), F.col("l_returnflag").alias("template"), F.col("l_suppkey").alias("seed"),
        F.expr(_WIN).alias("correct"), F.expr(_ASKED).alias("competency"), (F.col("l_orderkey") % 10 == 0).alias("trick"),
    )
    runs = a.groupBy(*keys).agg(F.sum(F.when(F.col("trick"), F.col("correct").cast("int"))).alias("tricks_right")).select(
        "*", F.lit(RUN_ENTITIES).alias("n_entities"), F.lit(RUN_STORED).alias("stored_count"), F.lit(RUN_WRITES).alias("write_budget")
    )
    scored = H.composite(H.axis_scores(a, runs, keys))
    return scored.select(*keys, "composite").join(runs.select(*keys, "tricks_right"), keys)


def _by_strategy(column: str, names: list[str], how: str = "AVG") -> str:
    end = "" if column == "accuracy" else f"_{column}"
    return ", ".join(f"{how}(CASE WHEN strategy = '{n}' THEN {column} END) AS {n}{end}" for n in names)


_COMPOSED = ["perfect", "strategic", "naive", "guesser", "abstainer"]


@query("check_invariants", "WITH strat AS (SELECT a.*, c.* EXCLUDE (template) FROM (SELECT template, "
       + _by_strategy("accuracy", _NAMES) + " FROM strategy_run GROUP BY template) a JOIN (SELECT template, "
       + _by_strategy("composite", _COMPOSED) + ", " + _by_strategy("tricks_right", ["guesser"], "SUM")
       + " FROM strategy_composite GROUP BY template) c ON c.template = a.template) SELECT * FROM ("
       + " UNION ALL ".join(
           f"SELECT template, '{name}' AS check_name, " + (pred if name in H.OPTIONAL_RULES else f"COALESCE({pred}, FALSE)") + " AS passed FROM strat"
           for name, pred in H.STRATEGY_RULES.items()) + ") u WHERE passed IS NOT NULL")
def _(t: Tables) -> DataFrame:
    s = strategy_runs(t).groupBy("template").agg(
        *[F.avg(F.when(F.col("strategy") == n, F.col("accuracy"))).alias(n) for n in _NAMES]
    )
    c = strategy_composites(t).groupBy("template").agg(
        *[F.avg(F.when(F.col("strategy") == n, F.col("composite"))).alias(f"{n}_composite") for n in _COMPOSED],
        F.sum(F.when(F.col("strategy") == "guesser", F.col("tricks_right"))).alias("guesser_tricks_right"),
    )
    return H.check_invariants(s.join(c, "template"), H.STRATEGY_RULES, ["template"], optional=H.OPTIONAL_RULES)


@query("check_invariants_overall", "WITH strat AS (SELECT " + _by_strategy("composite", _COMPOSED) + " FROM strategy_composite) "
       + " UNION ALL ".join(
           f"SELECT '{name}' AS check_name, COALESCE({pred}, FALSE) AS passed FROM strat" for name, pred in H.OVERALL_RULES.items()))
def _(t: Tables) -> DataFrame:
    c = strategy_composites(t).agg(
        *[F.avg(F.when(F.col("strategy") == n, F.col("composite"))).alias(f"{n}_composite") for n in _COMPOSED]
    )
    return H.check_invariants(c, H.OVERALL_RULES, [])


_ERR = """CASE event_type WHEN 'error' THEN 'llm_request failed: 503 upstream' WHEN 'signup' THEN 'max_turns reached'
 WHEN 'click' THEN 'no wallclock remaining' WHEN 'purchase' THEN 'disk full' ELSE '' END"""


@query("classify_errors", f"""
SELECT event_type, error_class, COUNT(*) AS n FROM (SELECT event_type,
  CASE WHEN e = '' THEN 'none' WHEN contains(lower(e), 'wallclock') OR contains(lower(e), 'turn timed out') THEN 'wallclock'
       WHEN contains(lower(e), 'max_turns') THEN 'capability'
       WHEN regexp_matches(lower(e), '{"|".join(H.RETRYABLE_TOKENS)}') AND NOT regexp_matches(lower(e), '{"|".join(H.FINAL_TOKENS)}')
       THEN 'infra_retryable' ELSE 'infra' END AS error_class
  FROM (SELECT event_type, {_ERR} AS e FROM events) x) y GROUP BY event_type, error_class""")
def _(t: Tables) -> DataFrame:
    e = t.raw("events").select("event_type", F.expr(_ERR).alias("error"))
    return H.classify_errors(e).groupBy("event_type", "error_class").agg(F.count(F.lit(1)).alias("n"))


@query("failure_streaks", """
SELECT agent_id, MAX(len) AS longest_streak, COUNT(*) AS n_streaks, MAX(len) >= 8 AS provider_down FROM (
  SELECT agent_id, grp, COUNT(*) AS len FROM (
    SELECT agent_id, failed, SUM(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY agent_id ORDER BY seq) AS grp
    FROM (SELECT agent_id, seq, k < 60 AS failed FROM tool_call) a) b WHERE failed GROUP BY agent_id, grp) c
GROUP BY agent_id""")
def _(t: Tables) -> DataFrame:
    d = t.tool_call.select("agent_id", "seq", (F.col("k") < 60).alias("failed"))
    return H.failure_streaks(d, ["agent_id"], "seq", "failed")


@query("fill_unanswered", """
SELECT step, reason, COUNT(*) AS n, COUNT(*) FILTER (WHERE correct) AS n_correct FROM (
  SELECT o.o_custkey % 50 AS step, COALESCE(a.correct, FALSE) AS correct,
         COALESCE(a.reason, 'wallclock:unanswered_after_timeout(deadline)') AS reason
  FROM orders o LEFT JOIN (SELECT question_id, BOOL_OR(correct) AS correct, MIN(reason) AS reason FROM graded GROUP BY question_id) a
    ON a.question_id = o.o_orderkey) x GROUP BY step, reason""")
def _(t: Tables) -> DataFrame:
    answers = graded(t).groupBy("question_id").agg(
        F.bool_or("correct").alias("correct"), F.min("reason").alias("reason"), F.max("answer").alias("answer")
    )
    q = t.raw("orders").select((F.col("o_custkey") % 50).alias("step"), F.col("o_orderkey").alias("question_id"))
    d = H.fill_unanswered(q, answers, ["question_id"], "deadline")
    return d.groupBy("step", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))


@query("timing_summary", """
SELECT l_suppkey AS run_id, ROUND(AVG(CASE WHEN l_quantity - 5 > 0 THEN l_quantity - 5 END), 9) AS avg_elapsed,
       MAX(CASE WHEN l_quantity - 5 > 0 THEN l_quantity - 5 END) AS max_elapsed, SUM(l_quantity - 5) AS total_elapsed,
       CAST(SUM(l_linenumber) AS BIGINT) AS retries, COUNT(*) AS api_calls
FROM lineitem GROUP BY l_suppkey""")
def _(t: Tables) -> DataFrame:
    d = t.raw("lineitem").select(
        F.col("l_suppkey").alias("run_id"), (F.col("l_quantity") - 5).alias("elapsed"),
        F.col("l_linenumber").alias("retries"), F.lit(1).alias("api_calls"),
    )
    return rounded(H.timing_summary(d, ["run_id"]), ["avg_elapsed"])
