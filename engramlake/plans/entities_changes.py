"""Entity tables (B), sampling and selection (D), change data (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators import changes as E
from engramlake.operators import entity as B
from engramlake.plans import catalogue
from engramlake.plans.fixtures import SQL, Tables
from engramlake.plans.registry import query

ENTITY_KEYS = ["world_id", "entity", "arrival", "category"]


@query("entity_long", "SELECT world_id, entity, category, attr, dtype, num, str, dt FROM entity_attr")
def _(t: Tables) -> DataFrame:
    return t.entity_attr.select("world_id", "entity", "category", "attr", "dtype", "num", "str", "dt")


@query("entity_wide", "SELECT world_id, entity, acctbal, order_count, total_spend, priority, last_order FROM entity "
       "WHERE COALESCE(acctbal, order_count, total_spend) IS NOT NULL OR priority IS NOT NULL OR last_order IS NOT NULL")
def _(t: Tables) -> DataFrame:
    slots = {"acctbal": "num", "order_count": "num", "total_spend": "num", "priority": "str", "last_order": "dt"}
    return B.entity_wide(t.entity_attr, ["world_id", "entity"], slots)


@query("attr_profile", """
SELECT world_id, attr, dtype, n_entities, min_num, max_num, avg_length,
       dtype IN ('int', 'float') AND n_entities >= 2 AS ok_for_aggregation,
       dtype IN ('int', 'float') AND n_entities >= 4 AS ok_for_condition,
       dtype IN ('int', 'float') AND n_entities >= 5 AS ok_for_set
FROM (SELECT world_id, attr, dtype, COUNT(*) AS n_entities, MIN(num) AS min_num, MAX(num) AS max_num,
             ROUND(AVG(LENGTH(str)), 9) AS avg_length FROM entity_attr GROUP BY world_id, attr, dtype) p""")
def _(t: Tables) -> DataFrame:
    return B.attr_profile(t.entity_attr).withColumn("avg_length", F.round("avg_length", 9))


SQL["attr_def"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r[0]}', '{r[1]}', '{r[4]}', '{r[5]}', {r[8]})" for r in catalogue.ATTR_DEFS
) + ") v(attr, dtype, unit, label, pos)"

SQL["document_line"] = """
SELECT world_id, entity, string_agg(label || ': ' || unit || body, ' | ' ORDER BY pos) AS document
FROM (SELECT a.world_id, a.entity, d.label, d.unit, d.pos,
        CASE a.dtype WHEN 'int' THEN format('{:,}', CAST(num AS BIGINT)) WHEN 'float' THEN format('{:,.2f}', num)
             WHEN 'date' THEN CAST(dt AS VARCHAR) ELSE str END AS body
      FROM entity_attr a JOIN attr_def d ON d.attr = a.attr) x
GROUP BY world_id, entity
"""


def documents(t: Tables) -> DataFrame:
    return B.compact_document(t.entity_attr, t.attr_def, ["world_id", "entity"])


@query("compact_document", "SELECT world_id, entity, document FROM document_line")
def _(t: Tables) -> DataFrame:
    return documents(t)


# The cross-attribute rules of the bound world, plus the declared ranges.
RULES = {
    "spend_without_orders": "total_spend > 0 AND order_count = 0",
    "spend_per_order_band": "total_spend / order_count > 300000 OR total_spend / order_count < 20000",
    "balance_above_spend": "acctbal > total_spend",
    "late_urgent": "priority = '1-URGENT' AND last_order < DATE '1999-01-01'",
    **B.range_rules(catalogue.ATTR_DEFS),
}


@query("constraint_violations", "SELECT world_id, rule, COUNT(*) AS n_violations FROM (" + " UNION ALL ".join(
    f"SELECT world_id, '{name}' AS rule FROM entity WHERE {pred}" for name, pred in RULES.items()
) + ") v GROUP BY world_id, rule")
def _(t: Tables) -> DataFrame:
    return B.constraint_violations(t.entity, RULES, ["world_id"])


# --- D ------------------------------------------------------------------------------------------


@query("sample_k_per_group", """
SELECT world_id, category, entity FROM (
  SELECT world_id, category, entity, ROW_NUMBER() OVER (PARTITION BY world_id, category ORDER BY md5('42' || entity), entity) AS rn
  FROM entity) s WHERE rn <= 5""")
def _(t: Tables) -> DataFrame:
    order = F.md5(F.concat(F.lit("42"), F.col("entity")))
    return B.sample_k_per_group(
        t.entity.select("world_id", "category", "entity"), ["world_id", "category"], 5, ["entity"], order=order
    )


SQL["extreme"] = """
SELECT world_id, entity, COUNT(*) FILTER (WHERE n >= 5 AND (5 * rk <= n OR 5 * rk >= 4 * n)) AS n_extreme FROM (
  SELECT a.world_id, a.entity, COUNT(*) OVER (PARTITION BY world_id, attr) AS n,
         COUNT(*) OVER (PARTITION BY world_id, attr ORDER BY num RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk
  FROM entity_attr a WHERE dtype IN ('int', 'float')) x GROUP BY world_id, entity
"""
SQL["importance"] = """
SELECT a.world_id, a.entity, COALESCE(d.degree, 0) AS degree, a.n_attrs, COALESCE(e.n_extreme, 0) AS n_extreme,
       1.0 + COALESCE(d.degree, 0) * 1.5 + a.n_attrs * 0.3 + COALESCE(e.n_extreme, 0) * 1.5 AS importance
FROM (SELECT world_id, entity, COUNT(*) AS n_attrs FROM entity_attr GROUP BY world_id, entity) a
LEFT JOIN (SELECT world_id, entity, COUNT(*) AS degree FROM (
    SELECT world_id, source AS entity FROM edge UNION ALL SELECT world_id, target FROM edge) u GROUP BY world_id, entity) d
  ON d.world_id = a.world_id AND d.entity = a.entity
LEFT JOIN extreme e ON e.world_id = a.world_id AND e.entity = a.entity
"""


def importance(t: Tables) -> DataFrame:
    return B.entity_importance(t.entity_attr, t.edge)


@query("entity_importance", "SELECT world_id, entity, degree, n_attrs, n_extreme, ROUND(importance, 6)::DOUBLE AS importance FROM importance")
def _(t: Tables) -> DataFrame:
    return importance(t).withColumn("importance", F.round("importance", 6))


@query("entity_priority", """
SELECT a.world_id, a.entity, s.category_size, a.n_attrs, COALESCE(e.n_extreme, 0) AS n_extreme,
       CAST(LEAST(s.category_size, 10) + a.n_attrs * 0.5 + COALESCE(e.n_extreme, 0) * 2.0 AS DOUBLE) AS priority_score
FROM (SELECT world_id, category, entity, COUNT(*) AS n_attrs FROM entity_attr GROUP BY ALL) a
JOIN (SELECT world_id, category, COUNT(DISTINCT entity) AS category_size FROM entity_attr GROUP BY ALL) s
  ON s.world_id = a.world_id AND s.category = a.category
LEFT JOIN extreme e ON e.world_id = a.world_id AND e.entity = a.entity""")
def _(t: Tables) -> DataFrame:
    return B.entity_priority(t.entity_attr)


SQL["corrected"] = "SELECT DISTINCT world_id, source AS entity FROM edge WHERE relation = 'audits'"
SQL["scored_entity"] = """
SELECT i.world_id, i.entity, c.c_custkey AS arrival, ROUND(i.importance, 6) AS importance, c.c_acctbal > 9000 AS forced
FROM importance i JOIN customer c ON c.c_name = i.entity
"""


def scored_entities(t: Tables) -> DataFrame:
    c = t.raw("customer").select(
        F.col("c_name").alias("entity"), F.col("c_custkey").alias("arrival"), (F.col("c_acctbal") > 9000).alias("forced")
    )
    return importance(t).join(c, "entity").select(
        "world_id", "entity", "arrival", F.round("importance", 6).alias("importance"), "forced"
    )


@query("select_budgeted", """
SELECT world_id, entity FROM (
  SELECT world_id, entity, forced, ROW_NUMBER() OVER (PARTITION BY world_id ORDER BY forced DESC, importance DESC, arrival) AS rn
  FROM scored_entity) s WHERE forced OR rn <= 30""")
def _(t: Tables) -> DataFrame:
    return B.select_budgeted(
        scored_entities(t), ["world_id"], "importance", "arrival", budget=30, forced="forced"
    ).select("world_id", "entity")


@query("select_by_ratio", """
SELECT world_id, entity FROM (
  SELECT world_id, entity, ROW_NUMBER() OVER (PARTITION BY world_id ORDER BY importance DESC, arrival) AS rn,
         COUNT(*) OVER (PARTITION BY world_id) AS n
  FROM scored_entity) s WHERE rn <= GREATEST(1, FLOOR(n * 0.7))""")
def _(t: Tables) -> DataFrame:
    return B.select_budgeted(scored_entities(t), ["world_id"], "importance", "arrival", ratio=0.7).select("world_id", "entity")


def choice_sql(pool: str) -> str:
    """Five draws a world, one for each region key, from the rows of ``pool``."""
    return f"""
SELECT world_id, draw_id, r, chosen FROM (
  SELECT s.world_id, d.draw_id, d.r, s.entity AS chosen, ROW_NUMBER() OVER (PARTITION BY s.world_id, d.draw_id ORDER BY s.arrival) AS rn
  FROM (SELECT *, CAST(ROUND(importance * 10) AS BIGINT) AS w,
          SUM(CAST(ROUND(importance * 10) AS BIGINT)) OVER (PARTITION BY world_id ORDER BY arrival) AS cum,
          SUM(CAST(ROUND(importance * 10) AS BIGINT)) OVER (PARTITION BY world_id) AS total FROM ({pool}) p) s
  JOIN (SELECT n.n_nationkey AS world_id, r.r_regionkey AS draw_id, (r.r_regionkey * 2 + 1) / 11.0::DOUBLE AS r
        FROM nation n CROSS JOIN region r) d ON d.world_id = s.world_id
  WHERE s.cum >= d.r * s.total) x WHERE rn = 1"""


def choice(t: Tables, **options) -> DataFrame:
    w = scored_entities(t).withColumn("w", F.round(F.col("importance") * 10).cast("bigint"))
    draws = t.raw("nation").select(
        F.col("n_nationkey").alias("world_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("draw_id")
    ).withColumn("r", (F.col("draw_id") * 2 + 1) / 11.0)
    return B.weighted_choice(w, draws, ["world_id"], "w", "arrival", "entity", **options)


@query("weighted_choice", choice_sql("SELECT * FROM scored_entity"))
def _(t: Tables) -> DataFrame:
    return choice(t)


@query("weighted_choice_fresh", choice_sql(
    "SELECT * FROM (SELECT *, BOOL_OR(forced) OVER (PARTITION BY world_id) AS any_fresh FROM scored_entity) q WHERE forced OR NOT any_fresh"))
def _(t: Tables) -> DataFrame:
    return choice(t, fresh="forced")


@query("curriculum_mix", """
SELECT n.n_name AS template, v.tier, CAST(v.n AS BIGINT) AS n_seeds, 0 AS min_seed, v.n - 1 AS max_seed
FROM nation n JOIN (VALUES ('lite', 60), ('standard', 30), ('hard', 10)) v(tier, n) ON TRUE""")
def _(t: Tables) -> DataFrame:
    d = B.curriculum_mix(t.raw("nation").select(F.col("n_name").alias("template")), 100, shuffle=False)
    return d.groupBy("template", "tier").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.min("seed").alias("min_seed"), F.max("seed").alias("max_seed")
    )


@query("expand_groups", """
SELECT o_orderkey AS seed, o_orderstatus AS template, s.sample_id FROM orders CROSS JOIN (VALUES (0), (1), (2), (3)) s(sample_id)""")
def _(t: Tables) -> DataFrame:
    c = t.raw("orders").select(F.col("o_orderkey").alias("seed"), F.col("o_orderstatus").alias("template"))
    return B.expand_groups(c, 4)


# --- E ------------------------------------------------------------------------------------------


def split_changes(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.change
    return c.where(F.col("old_val").isNull()), c.where(F.col("old_val").isNotNull())


SQL["current_value"] = """
SELECT world_id, entity, attr, arg_max(new_val, seq) AS value, COUNT(*) - 1 AS n_changes FROM change GROUP BY world_id, entity, attr
"""


def current(t: Tables) -> DataFrame:
    base, changes = split_changes(t)
    return E.current_state(base, changes)


@query("current_state", "SELECT world_id, entity, attr, value, n_changes FROM current_value")
def _(t: Tables) -> DataFrame:
    return current(t)


@query("original_state", "SELECT world_id, entity, attr, arg_min(new_val, seq) AS value FROM change GROUP BY world_id, entity, attr")
def _(t: Tables) -> DataFrame:
    return E.original_state(*split_changes(t))


_SHOWN = "CASE event_type WHEN 'view' THEN 'purchase' WHEN 'click' THEN 'signup' ELSE 'error' END"


@query("state_as_of", f"""
SELECT d.world_id, d.entity, d.attr, d.seq, c.new_val AS value
FROM (SELECT user_id % 10 AS world_id, user_id AS entity, {_SHOWN} AS attr, event_id AS seq FROM events) d
ASOF LEFT JOIN change c ON c.world_id = d.world_id AND c.entity = d.entity AND c.attr = d.attr AND d.seq >= c.seq""")
def _(t: Tables) -> DataFrame:
    docs = t.raw("events").select(
        (F.col("user_id") % 10).alias("world_id"), F.col("user_id").alias("entity"), F.expr(_SHOWN).alias("attr"),
        F.col("event_id").alias("seq"),
    )
    changes = t.raw("events").select(
        (F.col("user_id") % 10).alias("world_id"), F.col("user_id").alias("entity"), F.col("event_type").alias("attr"),
        F.col("event_id").alias("seq"), F.col("value").alias("new_val"),
    )
    return E.state_as_of(docs, changes)


@query("detect_contradictions", """
SELECT world_id, entity, attr, seq, old_val AS prev_val, new_val FROM change
WHERE kind = 'ingest' AND old_val IS NOT NULL AND new_val <> old_val""")
def _(t: Tables) -> DataFrame:
    return E.detect_contradictions(t.change).select("world_id", "entity", "attr", "seq", "prev_val", "new_val")


@query("eligible_targets", """
SELECT p.world_id, p.entity, p.n_attrs, a.attr, a.dtype FROM (
  SELECT world_id, entity, COUNT(*) AS n_attrs FROM entity_attr GROUP BY world_id, entity HAVING COUNT(*) >= 2) p
JOIN (SELECT world_id, entity, attr, dtype, ROW_NUMBER() OVER (PARTITION BY world_id, entity
        ORDER BY CASE WHEN dtype IN ('int', 'float', 'enum') THEN 0 ELSE 1 END, attr) AS rn FROM entity_attr) a
  ON a.world_id = p.world_id AND a.entity = p.entity AND a.rn = 1
WHERE NOT EXISTS (SELECT 1 FROM corrected c WHERE c.world_id = p.world_id AND c.entity = p.entity)""")
def _(t: Tables) -> DataFrame:
    taken = t.edge.where(F.col("relation") == "audits").select("world_id", F.col("source").alias("entity"))
    return E.eligible_targets(t.entity_attr, taken)


SALT = 1


def drawn(purpose: str, *cols: str) -> str:
    """The uniform number of ``unit_interval`` in SQL."""
    text = " || ':' || ".join([f"'{SALT}:{purpose}'", *[f"COALESCE(CAST({c} AS VARCHAR), '')" for c in cols]])
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / {1 << 52}::DOUBLE)"


def _literal(x: float | None) -> str:
    return "NULL::DOUBLE" if x is None else f"{x!r}::DOUBLE"


SQL["attr_range"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r[0]}', {_literal(r[2])}, {_literal(r[3])}, {r[7]!r}::VARCHAR[])" for r in catalogue.ATTR_DEFS
) + ") v(attr, lo, hi, choices)"

_ID = ("a.world_id", "a.entity", "a.attr")
SQL["attr_draw"] = f"""
SELECT a.*, r.lo, r.hi, r.choices, len(r.choices) AS n_choices, COALESCE(list_position(r.choices, a.str), 0) AS at_choice,
       CASE WHEN {drawn('sign', *_ID)} < 5e-1 THEN -1e0 ELSE 1e0 END AS sgn,
       {", ".join(f"{drawn(p, *_ID)} AS u_{p}" for p in ('size', 'step', 'year', 'month', 'day', 'share', 'pick', 'days'))}
FROM entity_attr a JOIN attr_range r ON r.attr = a.attr
"""
_LONG = "world_id, entity, arrival, category, attr, dtype, num, str, dt"


@query("salted_perturb", f"""
SELECT {_LONG},
       CASE dtype WHEN 'int' THEN CASE WHEN whole = num THEN num + CASE WHEN num < hi THEN 1 ELSE -1 END ELSE whole END
                  WHEN 'float' THEN ROUND(moved, 2) END AS new_num,
       CASE WHEN dtype = 'enum' AND n_choices >= 2
            THEN choices[CAST((GREATEST(at_choice - 1, 0) + 1 + FLOOR(u_step * (n_choices - 1))) % n_choices + 1 AS BIGINT)]
            ELSE str END AS new_str,
       CASE WHEN dtype = 'date' THEN make_date(CAST(lo + FLOOR(u_year * (hi - lo + 1)) AS BIGINT),
            CAST(1 + FLOOR(u_month * 12) AS BIGINT), CAST(1 + FLOOR(u_day * 28) AS BIGINT)) END AS new_dt
FROM (SELECT *, round_even(moved, 0) AS whole FROM (
  SELECT *, GREATEST(lo, LEAST(hi, num + sgn * (5e-2 + 1e-1 * u_size) * (hi - lo))) AS moved FROM attr_draw) m) w""")
def _(t: Tables) -> DataFrame:
    return E.salted_perturb(t.entity_attr, t.attr_def, salt=SALT)


@query("correction_perturb", f"""
SELECT {_LONG},
       CASE dtype WHEN 'int' THEN CASE WHEN as_int = num THEN num + CASE WHEN num < hi THEN 1 ELSE -1 END ELSE as_int END
                  WHEN 'float' THEN CASE WHEN as_float = num THEN ROUND(num + 1e-1, 2) ELSE as_float END END AS new_num,
       CASE WHEN dtype = 'enum' THEN COALESCE(choices[pick + CASE WHEN at_choice > 0 AND pick >= at_choice THEN 1 ELSE 0 END], str)
            ELSE str END AS new_str,
       CASE WHEN dtype = 'date' THEN CAST(day + to_months(CAST((GREATEST(lo, LEAST(hi, year(day))) - year(day)) * 12 AS INTEGER)) AS DATE)
       END AS new_dt
FROM (SELECT *, GREATEST(lo, LEAST(hi, num + sgn * GREATEST(1e0, FLOOR(ABS(num) * share)))) AS as_int,
        GREATEST(lo, LEAST(hi, ROUND(num + num * share * sgn, 2))) AS as_float
      FROM (SELECT *, 1e-1 + 4e-1 * u_share AS share, dt + CAST((30 + FLOOR(u_days * 336)) * sgn AS INTEGER) AS day,
              CAST(1 + FLOOR(u_pick * (n_choices - CASE WHEN at_choice > 0 THEN 1 ELSE 0 END)) AS BIGINT) AS pick
            FROM attr_draw) s) w""")
def _(t: Tables) -> DataFrame:
    return E.correction_perturb(t.entity_attr, t.attr_def, salt=SALT)


SERIES_LO, SERIES_HI = 0.0, 2000.0


def series_rows(t: Tables, perturb) -> DataFrame:
    """Each entity's series as an array, moved by ``perturb``, and back to a row for each point."""
    points = F.array_sort(F.collect_list(F.struct("period", "v")))
    d = t.series.groupBy("entity").agg(F.transform(points, lambda p: p["v"]).alias("series"))
    d = perturb(d, "series", SERIES_LO, SERIES_HI, SALT, ["entity"])
    return d.select("entity", F.posexplode(F.arrays_zip("series", "new_series")).alias("pos", "p")).select(
        "entity", "pos", F.col("p.series").alias("v"), F.col("p.new_series").alias("new_v")
    )


SQL["series_point"] = """
SELECT entity, CAST(ROW_NUMBER() OVER (PARTITION BY entity ORDER BY period) - 1 AS INT) AS pos, v,
       COUNT(*) OVER (PARTITION BY entity) AS n FROM series
"""


@query("salted_perturb_series", f"""
SELECT entity, pos, v, ROUND(GREATEST({SERIES_LO}::DOUBLE, LEAST({SERIES_HI}::DOUBLE, v
         + CASE WHEN {drawn('sign', 'pos', 'entity')} < 5e-1 THEN -1e0 ELSE 1e0 END
           * (5e-2 + 1e-1 * {drawn('size', 'pos', 'entity')}) * {SERIES_HI - SERIES_LO}::DOUBLE)), 2) AS new_v
FROM series_point""")
def _(t: Tables) -> DataFrame:
    return series_rows(t, E.perturb_series)


@query("correction_perturb_series", f"""
SELECT entity, pos, v, CASE WHEN pos < n - 1 THEN v ELSE GREATEST({SERIES_LO}::DOUBLE, LEAST({SERIES_HI}::DOUBLE,
         ROUND(v + v * (1e-1 + 4e-1 * {drawn('last', 'entity')})
           * CASE WHEN {drawn('sign', 'entity')} < 5e-1 THEN -1e0 ELSE 1e0 END, 2))) END AS new_v
FROM series_point""")
def _(t: Tables) -> DataFrame:
    return series_rows(t, E.perturb_last_point)


def correction_turns(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every user event read as one correction with the tool calls it triggered."""
    e = t.raw("events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    new, who = F.concat(F.lit("v"), F.col("k")), F.concat(F.lit("user"), F.col("run_id"), F.lit(" "))
    corrections = e.select("run_id", "seq", F.concat(F.lit("user"), F.col("run_id")).alias("entity"), new.alias("new_val"))
    kind, low = F.col("event_type"), F.col("k") < 50

    def call(name: str, *pairs):
        flat = [x for key, v in pairs for x in (F.lit(key), v)]
        return F.struct(F.lit(name).alias("name"), F.create_map(*flat).alias("arguments"))

    main = (
        F.when(kind.isin("signup", "error"), call("Write", ("content", F.concat(who, new))))
        .when(kind == "purchase", call("Edit", ("old_text", who), ("new_text", new)))
        .when(kind == "click", call("Edit", ("old_text", who), ("new_text", F.lit("other"))))
        .otherwise(call("memory", ("action", F.lit("replace")), ("old_text", who), ("content", new)))
    )
    result = (
        F.when(kind == "signup", F.lit("Written (lines 1-1). 3 writes left."))
        .when(kind == "error", F.lit("Budget exhausted (30/30)."))
        .when((kind == "purchase") & ~low, F.lit("Text not found in memory."))
        .when(kind.isin("purchase", "click"), F.lit("Edited. 3 writes left."))
        .when(low, F.lit('{"ok": true}'))
    )
    search = call("memory_search", ("query", who))
    searched = F.col("value") > 25
    turns = e.select(
        "run_id", "seq",
        F.when(searched, F.array(search, main)).otherwise(F.array(main)).alias("tool_calls"),
        F.when(searched, F.array(F.lit("[]"), result)).otherwise(F.array(result)).alias("tool_results"),
    )
    return corrections, E.explode_calls(turns, ["run_id", "seq"])


SQL["correction_flag"] = """
SELECT run_id, seq, event_type = 'signup' OR (event_type = 'purchase' AND k < 50) AS applied,
       event_type = 'view' AND k < 50 AS applied_strict, value > 25 AS did_search,
       event_type IN ('purchase', 'click') AS did_edit,
       (event_type = 'purchase' AND k < 50) OR event_type = 'click' AS edit_ok
FROM (SELECT user_id AS run_id, event_id AS seq, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""


@query("correction_applied", "SELECT * FROM correction_flag")
def _(t: Tables) -> DataFrame:
    return E.correction_applied(*correction_turns(t), ["run_id", "seq"])


@query("correction_diagnostics", """
SELECT run_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE applied) AS applied, COUNT(*) FILTER (WHERE did_search) AS with_search,
       COUNT(*) FILTER (WHERE did_edit) AS with_edit, COUNT(*) FILTER (WHERE did_edit AND edit_ok) AS edit_success,
       COUNT(*) FILTER (WHERE did_edit AND NOT edit_ok) AS edit_fail FROM correction_flag GROUP BY run_id""")
def _(t: Tables) -> DataFrame:
    return E.correction_diagnostics(E.correction_applied(*correction_turns(t), ["run_id", "seq"]), ["run_id"])
