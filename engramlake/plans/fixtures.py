"""The driver's tables bound to the engine's data model.

Each fixture exists twice: as a DataFrame plan (``Tables``) and as SQL for the oracle (``SQL``).
Worlds are nations, entities are customers, change events are user events, memory entries are
documents, graded answers are order lines, episodes are orders.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions.scale import lagged
from engramlake.session import materialise, spread

EDGE_FANOUT = 8

SQL: dict[str, str] = {}

SQL["entity"] = """
SELECT c.c_nationkey AS world_id, c.c_name AS entity, c.c_custkey AS arrival, c.c_mktsegment AS category,
       CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal END AS acctbal,
       CAST(o.order_count AS DOUBLE) AS order_count,
       CASE WHEN o.order_count > 6 THEN o.total_spend END AS total_spend,
       o.last_order, o.priority
FROM customer c LEFT JOIN (
  SELECT o_custkey, COUNT(*) AS order_count,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend,
         CAST(MAX(o_orderdate) AS DATE) AS last_order,
         MAX(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS priority
  FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

SQL["entity_attr"] = """
SELECT world_id, entity, arrival, category, 'acctbal' AS attr, 'float' AS dtype, acctbal AS num,
       CAST(NULL AS VARCHAR) AS str, CAST(NULL AS DATE) AS dt FROM entity WHERE acctbal IS NOT NULL
UNION ALL SELECT world_id, entity, arrival, category, 'order_count', 'int', order_count, NULL, NULL
  FROM entity WHERE order_count IS NOT NULL
UNION ALL SELECT world_id, entity, arrival, category, 'total_spend', 'float', total_spend, NULL, NULL
  FROM entity WHERE total_spend IS NOT NULL
UNION ALL SELECT world_id, entity, arrival, category, 'priority', 'enum', NULL, priority, NULL
  FROM entity WHERE priority IS NOT NULL
UNION ALL SELECT world_id, entity, arrival, category, 'last_order', 'date', NULL, NULL, last_order
  FROM entity WHERE last_order IS NOT NULL
"""

SQL["edge"] = f"""
SELECT DISTINCT a.c_nationkey AS world_id, a.c_name AS source,
       CASE WHEN o1.o_orderpriority < '3' THEN 'supplies' ELSE 'audits' END AS relation, b.c_name AS target
FROM orders o1 JOIN orders o2 ON o2.o_orderkey > o1.o_orderkey AND o2.o_orderkey <= o1.o_orderkey + {EDGE_FANOUT}
JOIN customer a ON a.c_custkey = o1.o_custkey JOIN customer b ON b.c_custkey = o2.o_custkey
WHERE a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey
"""

SQL["change"] = """
SELECT world_id, entity, attr, seq, ts, old_val, new_val,
       CASE WHEN old_val IS NULL OR k < 33 THEN 'ingest' ELSE 'correction' END AS kind
FROM (
  SELECT user_id % 10 AS world_id, user_id AS entity, event_type AS attr, event_id AS seq, ts,
         LAG(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS old_val, value AS new_val,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events) e
"""

SQL["series"] = """
SELECT user_id AS entity, CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 6) AS INT) + 1 AS period,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v
FROM events GROUP BY 1, 2
"""

SQL["memory_entry"] = """
SELECT source AS agent_id, doc_id AS entry_id, doc_id AS seq, lang AS topic, text AS content FROM documents
"""

SQL["answer"] = """
SELECT l.l_suppkey AS run_id, l.l_returnflag AS model, l.l_linestatus AS template, l.l_orderkey AS question_id,
       CASE l.l_linenumber WHEN 1 THEN 'retrieval' WHEN 2 THEN 'update' WHEN 3 THEN 'synthesis'
            WHEN 4 THEN 'aggregation' WHEN 5 THEN 'abstention' WHEN 6 THEN 'multi_constraint'
            ELSE 'enum_filter' END AS competency,
       CASE WHEN l.l_linenumber = 3 THEN CONCAT(p.p_name, ' (', CAST(p.p_size AS VARCHAR), ')')
            WHEN l.l_linenumber = 5 THEN 'ABSTAIN' WHEN l.l_linenumber = 7 THEN p.p_name
            ELSE CAST(p.p_size AS VARCHAR) END AS truth,
       CASE CAST(l.l_quantity AS INT) % 4
            WHEN 0 THEN CONCAT(CAST(p.p_size AS VARCHAR), CASE l.l_linenumber % 3 WHEN 1 THEN chr(10) WHEN 2 THEN CONCAT(chr(9), ' ') ELSE '' END)
            WHEN 1 THEN CONCAT('The ', p.p_name, ' has ', CAST(p.p_size AS VARCHAR))
            WHEN 2 THEN 'I don''t know' ELSE CONCAT('$', CAST(p.p_size + 1 AS VARCHAR), 'K') END AS answer
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
"""

SQL["tool_call"] = """
SELECT user_id AS agent_id, event_id AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'Write' WHEN 'error' THEN 'Write' WHEN 'purchase' THEN 'Edit'
            WHEN 'click' THEN 'memory_search' ELSE 'Read' END AS tool,
       event_type <> 'error' AS ok, value, props AS payload,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
FROM events
"""

SQL["message"] = "SELECT conv_id, turn, role, text FROM conversations"

SQL["episode"] = """
SELECT o_custkey % 50 AS step, o_custkey AS group_id, o_orderkey AS sample_id, o_totalprice / 500000.0 AS reward
FROM orders
"""


def number_in(props: Column) -> Column:
    return F.regexp_extract(props, "([0-9]+)", 1).cast("int")


class Tables:
    """The driver's parquet files of one scale factor, raw and bound to the data model."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def keep(self, name: str) -> None:
        """Write the fixture ``name`` once, for a query that reads it in several branches."""
        self.__dict__[name] = materialise(getattr(self, name), name.replace("_", "-"))

    @cached_property
    def entity(self) -> DataFrame:
        money = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
        o = self.raw("orders").groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("n"),
            money.alias("spend"),
            F.max("o_orderdate").cast("date").alias("last_order"),
            F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("priority"),
        )
        c = self.raw("customer")
        return c.join(o, c.c_custkey == o.o_custkey, "left").select(
            F.col("c_nationkey").alias("world_id"),
            F.col("c_name").alias("entity"),
            F.col("c_custkey").alias("arrival"),
            F.col("c_mktsegment").alias("category"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acctbal"),
            F.col("n").cast("double").alias("order_count"),
            F.when(F.col("n") > 6, F.col("spend")).alias("total_spend"),
            "last_order",
            "priority",
        )

    @cached_property
    def entity_attr(self) -> DataFrame:
        from engramlake.operators.entity import entity_long

        return entity_long(self.entity, self.attr_def, ["world_id", "entity", "arrival", "category"])

    @cached_property
    def attr_def(self) -> DataFrame:
        """Attribute catalogue: a handful of configuration rows."""
        from engramlake.plans.catalogue import ATTR_DEFS, ATTR_SCHEMA

        return self.spark.createDataFrame(ATTR_DEFS, ATTR_SCHEMA)

    @cached_property
    def edge(self) -> DataFrame:
        o = self.raw("orders")
        c = self.raw("customer").select("c_custkey", "c_nationkey", "c_name")
        src = o.select(
            F.col("o_custkey").alias("src"),
            F.when(F.col("o_orderpriority") < "3", "supplies").otherwise("audits").alias("relation"),
            F.explode(F.sequence(F.col("o_orderkey") + 1, F.col("o_orderkey") + EDGE_FANOUT)).alias("next_key"),
        )
        dst = o.select(F.col("o_orderkey").alias("next_key"), F.col("o_custkey").alias("dst"))
        a = c.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("world_id"), F.col("c_name").alias("source"))
        b = c.select(F.col("c_custkey").alias("dst"), F.col("c_nationkey").alias("world_id"), F.col("c_name").alias("target"))
        return (
            src.join(dst, "next_key")
            .where(F.col("src") != F.col("dst"))
            .join(a, "src")
            .join(b, ["dst", "world_id"])
            .select("world_id", "source", "relation", "target")
            .distinct()
        )

    @cached_property
    def change(self) -> DataFrame:
        e = self.raw("events").select(
            (F.col("user_id") % 10).alias("world_id"),
            F.col("user_id").alias("entity"),
            F.col("event_type").alias("attr"),
            F.col("event_id").alias("seq"),
            "ts",
            F.col("value").alias("new_val"),
            number_in(F.col("props")).alias("k"),
        )
        e = lagged(e, ["world_id", "entity", "attr"], "seq", {"old_val": "new_val"})
        kind = F.when(F.col("old_val").isNull() | (F.col("k") < 33), "ingest").otherwise("correction")
        return e.select("world_id", "entity", "attr", "seq", "ts", "old_val", "new_val", kind.alias("kind"))

    @cached_property
    def series(self) -> DataFrame:
        return self.raw("events").groupBy(
            F.col("user_id").alias("entity"),
            (F.floor((F.dayofmonth("ts") - 1) / 6) + 1).cast("int").alias("period"),
        ).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))

    @cached_property
    def memory_entry(self) -> DataFrame:
        return spread(self.raw("documents").select(
            F.col("source").alias("agent_id"), F.col("doc_id").alias("entry_id"), F.col("doc_id").alias("seq"),
            F.col("lang").alias("topic"), F.col("text").alias("content"),
        ))

    @cached_property
    def answer(self) -> DataFrame:
        li = spread(self.raw("lineitem").select(
            "l_suppkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
        ))
        p = self.raw("part").select("p_partkey", "p_name", "p_size")
        n, size, name = F.col("l_linenumber"), F.col("p_size").cast("string"), F.col("p_name")
        shape = F.col("l_quantity").cast("int") % 4
        return li.join(p, li.l_partkey == p.p_partkey).select(
            F.col("l_suppkey").alias("run_id"),
            F.col("l_returnflag").alias("model"),
            F.col("l_linestatus").alias("template"),
            F.col("l_orderkey").alias("question_id"),
            F.when(n == 1, "retrieval").when(n == 2, "update").when(n == 3, "synthesis").when(n == 4, "aggregation")
            .when(n == 5, "abstention").when(n == 6, "multi_constraint").otherwise("enum_filter").alias("competency"),
            F.when(n == 3, F.concat(name, F.lit(" ("), size, F.lit(")")))
            .when(n == 5, "ABSTAIN").when(n == 7, name).otherwise(size).alias("truth"),
            F.when(shape == 0, F.concat(size, F.when(n % 3 == 1, "\n").when(n % 3 == 2, "\t ").otherwise("")))
            .when(shape == 1, F.concat(F.lit("The "), name, F.lit(" has "), size))
            .when(shape == 2, "I don't know")
            .otherwise(F.concat(F.lit("$"), (F.col("p_size") + 1).cast("string"), F.lit("K"))).alias("answer"),
        )

    @cached_property
    def tool_call(self) -> DataFrame:
        t = F.col("event_type")
        return self.raw("events").select(
            F.col("user_id").alias("agent_id"),
            F.col("event_id").alias("seq"),
            "ts",
            F.when(t.isin("signup", "error"), "Write").when(t == "purchase", "Edit")
            .when(t == "click", "memory_search").otherwise("Read").alias("tool"),
            (t != "error").alias("ok"),
            "value",
            F.col("props").alias("payload"),
            number_in(F.col("props")).alias("k"),
        )

    @cached_property
    def message(self) -> DataFrame:
        return self.raw("conversations").select("conv_id", "turn", "role", "text")

    @cached_property
    def episode(self) -> DataFrame:
        return self.raw("orders").select(
            (F.col("o_custkey") % 50).alias("step"), F.col("o_custkey").alias("group_id"),
            F.col("o_orderkey").alias("sample_id"), (F.col("o_totalprice") / 500000.0).alias("reward"),
        )
