"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of columns (domain, language, source). A node's budget is shared among its
children by weight, none above what its subtree holds over ``max_epochs`` epochs; what one cannot
use goes to its siblings first, and only what a whole subtree cannot use goes to the siblings of
its ancestor. Each leaf takes whole epochs and then the prefix, in a seeded order, that fits.

Only sums per leaf and per slice of the seeded order move. The plan has one row per leaf, with the
last key of the prefix, so rows of documents decide for themselves and texts are not shuffled while
the plan is small enough for Spark to broadcast it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.store import written

WORDS = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 4
SLICE_ROWS = 100_000
SEED = 42


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _weight(level: int, tree: Sequence[str], weights: Mapping[tuple[str, ...], float]) -> Column:
    """The configured weight of a node (its path from the root), 1 where none is configured."""
    out = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == level + 1:
            same = F.lit(True)
            for name, value in zip(tree, path, strict=False):
                same = same & F.col(name).eqNullSafe(F.lit(value))
            out = F.when(same, F.lit(float(w))).otherwise(out)
    return out


def _shared(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Children (cap, weight, budget of the parent) with their share: equal fill by weight up to cap."""
    family = Window.partitionBy(*parents)
    fills = F.when(F.col("weight") > 0, F.try_divide("cap", "weight")).otherwise(float("inf"))
    order = family.orderBy(fills, F.col(name).asc_nulls_first())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = (F.col("budget") - F.col("before")) * F.col("weight") >= F.col("cap") * F.col("left")
    nodes = nodes.withColumns({"before": before, "left": left}).withColumn("full", full & (F.col("weight") > 0))
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(family)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(family)
    share = F.try_divide((F.col("budget") - spent) * F.col("weight"), open_weight)
    share = F.when(F.col("full"), F.col("cap")).when(open_weight > 0, share).otherwise(0.0)
    return nodes.withColumn("share", share).drop("before", "left", "full")


def leaf_budgets(
    leaves: DataFrame, tree: Sequence[str], weights: Mapping[tuple[str, ...], float], *, budget: int | None = None, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``leaves`` (the tree's columns, tokens) with budget: whole tokens. ``budget`` None means all tokens there are."""
    base = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    total = F.lit(budget) if budget is not None else F.lit(leaves.agg(F.sum("tokens")).first()[0] or 0)
    have = base.withColumn("budget", total.cast("double"))
    for level, name in enumerate(tree):
        path = list(tree[: level + 1])
        nodes = have.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first("budget").alias("budget"))
        nodes = nodes.withColumn("weight", _weight(level, tree, weights))
        nodes = _shared(nodes, path[:-1], name).drop("budget").withColumnRenamed("share", "budget")
        have = _by_leaf(have.drop("budget"), nodes, path, ["budget"])
    return have.select(*tree, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def order_key(rows: DataFrame, id_col: str, text_col: str, seed: int, epoch: Column) -> Column:
    """The place of a row in the seeded order of an epoch; rows without an id go by their text."""
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    return F.concat(F.md5(F.concat_ws(":", F.lit(seed), epoch, own)), F.lit(":"), own)


def mixing_plan(
    docs: DataFrame, tree: Sequence[str], weights: Mapping[tuple[str, ...], float], *, id_col: str = "doc_id", text_col: str = "text",
    budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per leaf: the tree's columns, tokens, budget, epochs (whole ones), last (key that ends the next epoch's prefix, or null)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *tree)
    rows = rows.withColumn("n", token_count(F.col("text")))
    leaves = written(rows.groupBy(*tree).agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")), "leaves")
    plan = leaf_budgets(leaves, tree, weights, budget=budget, max_epochs=max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(0).cast("int")
    plan = plan.withColumn("epochs", epochs)
    rest = F.when(F.col("epochs") < max_epochs, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0)
    digits = F.greatest(F.lit(1), F.ceil(F.log(F.col("rows") / slice_rows) / F.log(F.lit(16.0))).cast("int"))
    plan = _by_leaf(plan.withColumn("rest", rest), leaves.drop("tokens"), tree, ["rows"]).withColumn("digits", digits)
    plan = written(plan, "leaf-budgets")
    keyed = _by_leaf(rows, plan.where("rest > 0"), tree, ["epochs", "rest", "digits"])
    keyed = keyed.withColumn("key", order_key(keyed, "id", "text", seed, F.col("epochs")))
    keyed = keyed.select(*tree, "rest", "n", "key", F.expr("substring(key, 1, digits)").alias("slice"))
    keyed = written(keyed, "mixing-keys")
    slices = keyed.groupBy(*tree, "slice").agg(F.sum("n").alias("sum"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*tree).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
    cut = slices.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest")))
    whole = slices.where(F.col("before") + F.col("sum") <= F.col("rest")).groupBy(*tree).agg(F.max("slice").alias("slice"))
    # the end of the last whole slice, and the prefix of the slice after it
    ends = _by_leaf(keyed, whole, [*tree, "slice"], []).groupBy(*tree).agg(F.max("key").alias("last"))
    inside = _by_leaf(keyed.drop("rest"), cut, [*tree, "slice"], ["before", "rest"])
    # rows of one key come together or not at all
    run = Window.partitionBy(*tree, "slice").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(run)).where("upto <= rest")
    ends = ends.union(inside.groupBy(*tree).agg(F.max("key").alias("last"))).groupBy(*tree).agg(F.max("last").alias("last"))
    plan = _by_leaf(plan, ends, tree, ["last"], "left")
    return written(plan.select(*tree, "tokens", "budget", "epochs", "last"), "mixing-plan")


def _by_leaf(rows: DataFrame, other: DataFrame, on: Sequence[str], take: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns in which null equals null."""
    other = other.select(*[F.col(c).alias(f"__{c}") for c in on], *take)
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(other, same, how).drop(*[f"__{c}" for c in on])


def mixed(
    docs: DataFrame, tree: Sequence[str], weights: Mapping[tuple[str, ...], float], *, id_col: str = "doc_id", text_col: str = "text",
    budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``docs`` with ``__epoch``: each row once for each epoch it is part of.

    Tokens are words `[^\\x20\\x09-\\x0D]+`; null and empty texts have none, and come with whole epochs
    and with a prefix that reaches them. A null in a column of the tree is a node of its own. Rows
    that repeat an id (or, without one, a text) have one place in the order and come together, so a
    leaf's rows sum to its budget or to less by under one document with its repetitions. Nodes of weight 0 get nothing. An empty table gives an empty result.
    """
    plan = mixing_plan(docs, tree, weights, id_col=id_col, text_col=text_col, budget=budget, max_epochs=max_epochs, seed=seed, slice_rows=slice_rows)
    rows = _by_leaf(docs, plan.withColumnsRenamed({"epochs": "__epochs", "last": "__last"}), tree, ["__epochs", "__last"])
    key = order_key(rows, id_col, text_col, seed, F.col("__epochs"))
    times = F.col("__epochs") + F.coalesce((key <= F.col("__last")).cast("int"), F.lit(0))
    rows = rows.withColumn("__times", times).where("__times > 0")
    return rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1))).drop("__times", "__epochs", "__last")
