"""Competency rates, axis scores, composites, leaderboards and invariant checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions.scale import islands

# Axis weights, and the competencies pooled into the reasoning axis.
WEIGHTS = {"breadth": 0.30, "maintenance": 0.25, "reasoning": 0.25, "efficiency": 0.20}
REASONING = [
    "synthesis", "aggregation", "cross_category", "conditional", "ratio", "comparison", "multi_hop", "outlier",
    "delta", "counterfactual", "multi_constraint", "relationship_lookup", "relationship_hop",
    "relationship_chain", "relationship_count", "relationship_filter", "temporal_trend", "temporal_extreme",
    "text_match", "enum_filter",
]
COVERAGE_GATE = 0.5
# Tier sizes, tokens that sort an error message into a class.
TIERS = {
    "lite": {"entities": 30, "questions": 10, "corrections": 3, "write_budget": 15, "n_sessions": 1},
    "standard": {"entities": 60, "questions": 20, "corrections": 5, "write_budget": 30, "n_sessions": 1},
    "hard": {"entities": 120, "questions": 40, "corrections": 10, "write_budget": 30, "n_sessions": 1},
    "multi": {"entities": 60, "questions": 20, "corrections": 5, "write_budget": 30, "n_sessions": 3},
}
RETRYABLE_TOKENS = [
    "unexpected eof", "stream ended without finish", "stream read:", "context deadline exceeded",
    "remoteprotocolerror", "server disconnected without sending a response", "connection reset by peer",
    "broken pipe", "rate limit", "too many requests", "503", "502", "504", "upstream", "timeout",
    "llm_request failed", "llm_stream failed",
]
FINAL_TOKENS = ["max_turns", "context overflow", "turn timed out", "wallclock_exhausted"]
WALLCLOCK_TOKENS = ["wallclock", "turn timed out", "no wallclock remaining"]
PROVIDER_DOWN_STREAK = 8


def _rate(hit: Column, total: Column) -> Column:
    """hit / total, 0 for an empty group."""
    return F.coalesce(F.try_divide(hit.cast("double"), total.cast("double")), F.lit(0.0))


def group_accuracy(graded: DataFrame, by: Sequence[str]) -> DataFrame:
    """correct, total, rate per group: by run and competency, by run and purpose, ..."""
    return graded.groupBy(*by).agg(
        F.count_if(F.col("correct")).alias("n_correct"), F.count(F.lit(1)).alias("n_total")
    ).withColumn("rate", _rate(F.col("n_correct"), F.col("n_total")))


def axis_scores(graded: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Four axes and the abstention diagnostic per run.

    ``runs`` carries the keys with n_entities, stored_count and write_budget.
    """
    return axes_from_counts(group_accuracy(graded, [*keys, "competency"]), runs, keys)


def axes_from_counts(counts: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Axes from (keys, competency, n_correct, n_total): grading is shared with every other use of the counts."""
    comp = F.col("competency")

    def rate(cond: Column) -> Column:
        part = lambda c: F.sum(F.when(cond, F.col(c)))
        return _rate(part("n_correct"), part("n_total"))

    sums = counts.groupBy(*keys).agg(
        rate(comp == "retrieval").alias("breadth"),
        rate(comp == "update").alias("maintenance_ungated"),
        rate(comp.isin(REASONING)).alias("reasoning"),
        rate(comp == "abstention").alias("abstention_diagnostic"),
        F.coalesce(F.sum(F.when(comp != "abstention", F.col("n_correct"))), F.lit(0)).alias("__correct"),
    )
    d = sums.join(runs.select(*keys, "n_entities", "stored_count", "write_budget"), list(keys))
    coverage = _rate(F.col("stored_count"), F.col("n_entities"))
    return d.select(
        *keys,
        "breadth",
        (F.col("maintenance_ungated") * F.least(coverage / COVERAGE_GATE, F.lit(1.0))).alias("maintenance"),
        "reasoning",
        F.when(F.col("write_budget") > 0, F.least(F.col("__correct") / F.col("write_budget"), F.lit(1.0)))
        .otherwise(0.0).alias("efficiency"),
        "abstention_diagnostic",
        "maintenance_ungated",
    )


def composite(axes: DataFrame) -> DataFrame:
    """Weighted sum of the axes; ``composite_ungated`` leaves out the coverage gate."""

    def weighted(maintenance: str) -> Column:
        return (
            WEIGHTS["breadth"] * F.col("breadth")
            + WEIGHTS["maintenance"] * F.col(maintenance)
            + WEIGHTS["reasoning"] * F.col("reasoning")
            + WEIGHTS["efficiency"] * F.col("efficiency")
        )

    return axes.select(
        "*", weighted("maintenance").alias("composite"), weighted("maintenance_ungated").alias("composite_ungated")
    )


def mean_stderr(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean and sample standard error per column, error 0 for a single row."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        n = F.count(c)
        aggs.append(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"))
        aggs.append(F.when(n > 1, F.stddev_samp(c) / F.sqrt(n)).otherwise(0.0).alias(f"{c}_stderr"))
    return df.groupBy(*by).agg(*aggs)


def infer_tier(n_entities: Column) -> Column:
    n = F.coalesce(n_entities, F.lit(0))
    return F.when(n <= 30, "lite").when(n <= 60, "standard").otherwise("hard")


def leaderboard(runs: DataFrame, run_competency: DataFrame | None = None) -> DataFrame:
    """One ranked row per model: mean score and composite, runs, templates, mean-of-run rates.

    ``runs``: model, template, run_id, score, composite. ``run_competency``: model, competency, rate.
    """
    board = runs.groupBy("model").agg(
        F.avg("score").alias("avg_score"),
        F.avg(F.coalesce("composite", "score")).alias("avg_composite"),
        F.count(F.lit(1)).alias("n_evals"),
        F.array_join(F.sort_array(F.collect_set("template")), ",").alias("templates"),
    )
    if run_competency is not None:
        c = F.col("competency")
        pick = lambda name: F.coalesce(F.avg(F.when(c == name, F.col("rate"))), F.lit(0.0)).alias(name)
        rates = run_competency.groupBy("model").agg(
            pick("retrieval"), pick("update"), pick("abstention"),
            F.avg(F.when(~c.isin("retrieval", "update", "abstention"), F.col("rate"))).alias("reasoning_mean"),
        )
        board = board.join(rates, "model", "left")
    # one row per model reaches this window, never the runs themselves
    w = Window.orderBy(F.col("avg_composite").desc(), F.col("model"))
    return board.withColumn("position", F.row_number().over(w).cast("bigint"))


def leaderboard_details(runs: DataFrame) -> DataFrame:
    """Run rows in board order: composite down, then model; tier derived from the entity count."""
    return runs.withColumn("tier", infer_tier(F.col("n_entities"))).orderBy(
        F.col("composite").desc(), F.col("model")
    )


def score_rollup(runs: DataFrame, score: str = "composite") -> DataFrame:
    """Overall, per-template and per-(template, seed) levels in one report."""
    return runs.rollup("template", "seed").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean"),
        F.when(F.count(score) > 1, F.stddev_samp(score) / F.sqrt(F.count(score))).otherwise(0.0).alias("stderr"),
    )


def pooled_competency(run_competency: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of correct over sum of total across runs (not a mean of run rates)."""
    return run_competency.groupBy(*by).agg(
        F.sum("n_correct").alias("n_correct"), F.sum("n_total").alias("n_total")
    ).withColumn("rate", _rate(F.col("n_correct"), F.col("n_total")))


def score_wide(graded: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """One rate column per listed value, null where the run has none."""
    return graded.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(column) == v, F.col("correct").cast("double"))).alias(f"{prefix}_{v}") for v in values]
    )


def answerability(questions: DataFrame, required: DataFrame, stored: DataFrame, updated: DataFrame,
                  coverage: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Could the store answer each question?

    ``required``: scope, question_id, entity (long form). ``stored``/``updated``: scope, entity.
    ``coverage``: scope, coverage. Update, delta and counterfactual questions also need the update
    applied; abstention needs half of the entities stored.
    """
    scope = list(scope)
    have = (
        required.join(stored.select(*scope, "entity").distinct().withColumn("__s", F.lit(True)), [*scope, "entity"], "left")
        .join(updated.select(*scope, "entity").distinct().withColumn("__u", F.lit(True)), [*scope, "entity"], "left")
        .groupBy(*scope, "question_id")
        .agg(
            F.bool_and(F.coalesce("__s", F.lit(False))).alias("all_stored"),
            F.bool_and(F.coalesce("__u", F.lit(False))).alias("all_updated"),
        )
    )
    comp = F.col("competency")
    d = questions.join(have, [*scope, "question_id"], "left").join(coverage, scope, "left")
    return d.withColumn(
        "answerable",
        F.when(comp == "abstention", F.coalesce(F.col("coverage") >= COVERAGE_GATE, F.lit(False)))
        .when(
            comp.isin("update", "delta", "counterfactual"),
            F.coalesce(F.col("all_stored") & F.col("all_updated"), F.lit(False)),
        )
        .otherwise(F.coalesce("all_stored", F.lit(True))),
    ).drop("all_stored", "all_updated", "coverage")


def strategy_means(results: DataFrame) -> DataFrame:
    return results.groupBy("strategy", "template").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.count(F.lit(1)).alias("n")
    )


def strategy_compare(results: DataFrame, a: str, b: str) -> DataFrame:
    """Per template: how often strategy ``a`` beats or ties ``b`` on the same seed."""
    pair = results.groupBy("template", "seed").agg(
        F.max(F.when(F.col("strategy") == a, F.col("accuracy"))).alias("__a"),
        F.max(F.when(F.col("strategy") == b, F.col("accuracy"))).alias("__b"),
    ).where(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    return pair.groupBy("template").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("__a") > F.col("__b")).alias("wins"),
        F.count_if(F.col("__a") == F.col("__b")).alias("ties"),
        F.count_if(F.col("__a") < F.col("__b")).alias("losses"),
        F.avg(F.col("__a") - F.col("__b")).alias("mean_gap"),
    )


def check_invariants(stats: DataFrame, rules: Mapping[str, str], keys: Sequence[str], *, optional: Sequence[str] = ()) -> DataFrame:
    """Evaluate named SQL predicates on each row of an aggregate: (keys, check_name, passed).

    A predicate that comes out null fails; one listed in ``optional`` then gives no row, as what it tests was not run.
    """
    checks = F.array(*[
        F.struct(
            F.lit(name).alias("check_name"),
            (F.expr(pred) if name in optional else F.coalesce(F.expr(pred), F.lit(False))).alias("passed"),
        )
        for name, pred in rules.items()
    ])
    return stats.select(*keys, F.inline(checks)).where(F.col("passed").isNotNull())


# The bounds. Columns are a strategy's mean accuracy, its mean composite, or its right answers to tricks.
STRATEGY_RULES = {
    "whole_store_answers_all": "perfect >= 0.999",
    "guessing_scores_nothing": "guesser < 0.01",
    "chosen_store_beats_first_come": "strategic > naive",
    "chosen_store_leads_by_a_tenth": "strategic > naive + 0.10",
    "first_come_beats_guessing": "naive > guesser",
    "guessing_under_a_twentieth": "guesser < 0.05",
    "abstaining_under_a_fifth": "abstainer < 0.20",
    "midpoints_within_a_twentieth": "smart_guesser <= 0.05",
    "guessing_falls_for_tricks": "guesser_tricks_right = 0",
    "chosen_store_leads_in_composite": "strategic_composite > naive_composite",
}
OPTIONAL_RULES = ("guessing_falls_for_tricks",)
OVERALL_RULES = {
    "whole_store_composite_high": "perfect_composite > 0.90",
    "guessing_composite_nothing": "guesser_composite < 0.01",
    "abstaining_composite_low": "abstainer_composite < 0.15",
}


def _any_token(text: Column, tokens: Sequence[str]) -> Column:
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.contains(text, F.lit(t))
    return hit


def classify_errors(
    df: DataFrame, error: str = "error", *, final: Sequence[str] = FINAL_TOKENS, wallclock: Sequence[str] = WALLCLOCK_TOKENS
) -> DataFrame:
    """Flags per message: infrastructure, wallclock, retryable, and the class they add up to.

    The tokens are arguments, because an agent's time-out message may name the agent.
    """
    low = F.lower(error)
    present = F.coalesce(F.col(error) != "", F.lit(False))
    infra = present & ~F.contains(low, F.lit("max_turns"))
    wall = present & _any_token(low, wallclock)
    retry = present & ~_any_token(low, final) & _any_token(low, RETRYABLE_TOKENS)
    return df.select(
        "*",
        infra.alias("is_infra"), wall.alias("is_wallclock"), retry.alias("is_retryable"),
        F.when(~present, "none").when(wall, "wallclock").when(~infra, "capability")
        .when(retry, "infra_retryable").otherwise("infra").alias("error_class"),
    )


def failure_streaks(df: DataFrame, keys: Sequence[str], seq: str, failed: str,
                    threshold: int = PROVIDER_DOWN_STREAK, chunk_rows: int = 1_000_000) -> DataFrame:
    """Longest run of consecutive failures per key and whether it means the provider is down."""
    d = islands(df.select(*keys, seq, failed), keys, seq, failed, "__island", chunk_rows=chunk_rows)
    runs = d.where(F.col(failed)).groupBy(*keys, "__island").agg(F.count(F.lit(1)).alias("__len"))
    return runs.groupBy(*keys).agg(
        F.max("__len").alias("longest_streak"),
        F.count(F.lit(1)).alias("n_streaks"),
        (F.max("__len") >= threshold).alias("provider_down"),
    )


def fill_unanswered(questions: DataFrame, answers: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Every scheduled question once; those without an answer are incorrect with a reason."""
    return questions.join(answers.select(*keys, "answer", "correct", "reason"), list(keys), "left").select(
        *questions.columns,
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("correct", F.lit(False)).alias("correct"),
        F.coalesce("reason", F.lit(f"wallclock:unanswered_after_timeout({reason})")).alias("reason"),
    )


def timing_summary(df: DataFrame, by: Sequence[str], elapsed: str = "elapsed") -> DataFrame:
    """Average and maximum of the positive timings, with retries and API calls."""
    t = F.when(F.col(elapsed) > 0, F.col(elapsed))
    return df.groupBy(*by).agg(
        F.avg(t).alias("avg_elapsed"), F.max(t).alias("max_elapsed"), F.sum(elapsed).alias("total_elapsed"),
        F.sum("retries").alias("retries"), F.sum("api_calls").alias("api_calls"),
    )

