"""Reward analytics over logged episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numeric guards, reward bucket, shaped reward amounts.
EPS = 1e-6
MIN_ADVANTAGE = 1e-6
NONZERO = 1e-8
BUCKET = 0.05
R_DUPLICATE, R_NEW, R_ASKED, R_EXTRA, R_INVALID = -0.1, 0.3, 0.5, 0.1, -0.05
R_EDIT, R_EDIT_SEARCHED, R_EDIT_WRONG, R_SEARCH = 0.5, 0.6, 0.1, 0.1


def group_advantage(episodes: DataFrame, keys: Sequence[str], reward: str = "reward", *, drop_small: bool = True) -> DataFrame:
    """(reward - mean) / (population std + 1e-6) within the group; tiny advantages are dropped.

    Group statistics are partial aggregates joined back, so a dominating group is not one window.
    """
    keys = list(keys)
    stats = episodes.groupBy(*keys).agg(F.avg(reward).alias("__m"), F.stddev_pop(reward).alias("__s"))
    d = episodes.join(stats, keys).withColumn("advantage", (F.col(reward) - F.col("__m")) / (F.col("__s") + EPS))
    if drop_small:
        d = d.where(F.abs("advantage") >= MIN_ADVANTAGE)
    return d.drop("__m", "__s")


def ips_weights(episodes: DataFrame, keys: Sequence[str], reward: str = "reward") -> DataFrame:
    """Inverse share of the episode's reward bucket, scaled to mean 1 in the group.

    The raw weights n / c of a group average to its number of buckets, so the scaled weight is
    n / (c x buckets).
    """
    keys = list(keys)
    d = episodes.withColumn("bucket", F.rint(F.col(reward) / BUCKET).cast("bigint"))
    sizes = d.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("__c"))
    groups = sizes.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__b"))
    per = sizes.join(groups, keys)
    weight = F.when(F.col("__n") > 1, F.col("__n") / (F.col("__c") * F.col("__b"))).otherwise(1.0)
    return d.join(per.select(*keys, "bucket", weight.alias("weight")), [*keys, "bucket"])


def turn_advantage(turns: DataFrame, advantages: DataFrame, keys: Sequence[str], reward: str = "reward") -> DataFrame:
    """advantage x (1 + (turn reward - mean) / (std + eps)) for episodes with a non-zero turn reward."""
    keys = list(keys)
    stats = turns.groupBy(*keys).agg(
        F.avg(reward).alias("__m"), F.stddev_pop(reward).alias("__s"), F.bool_or(F.abs(reward) > NONZERO).alias("__any")
    ).where("__any")
    per = stats.join(advantages.select(*keys, "advantage"), keys)
    return turns.join(per, keys).withColumn(
        "turn_advantage", F.col("advantage") * (1.0 + (F.col(reward) - F.col("__m")) / (F.col("__s") + EPS))
    ).drop("__m", "__s", "__any")


def shaped_write_reward(writes: DataFrame, mentions: DataFrame, questioned: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Reward per write from the entities it names.

    ``writes``: keys, seq, valid. ``mentions``: keys, seq, entity. ``questioned``: keys, entity. An entity is
    new at the first valid write naming it: -0.1 if nothing is new, 0.3 if something is, 0.5 if a new one is asked
    later, +0.1 per further new one; an invalid write costs 0.05; no entity at all gives 0.
    """
    keys = list(keys)
    valid = mentions.select(*keys, seq, "entity").distinct().join(
        writes.where("valid").select(*keys, seq), [*keys, seq], "left_semi"
    )
    first = valid.groupBy(*keys, "entity").agg(F.min(seq).alias(seq)).withColumn("__new", F.lit(True))
    asked = questioned.select(*keys, "entity").distinct().withColumn("__asked", F.lit(True))
    first = first.join(asked, [*keys, "entity"], "left")
    news = first.groupBy(*keys, seq).agg(
        F.count(F.lit(1)).alias("n_new"), F.coalesce(F.bool_or("__asked"), F.lit(False)).alias("new_asked")
    )
    matched = valid.groupBy(*keys, seq).agg(F.count(F.lit(1)).alias("n_matched"))
    d = writes.join(matched, [*keys, seq], "left").join(news, [*keys, seq], "left")
    n_new = F.coalesce("n_new", F.lit(0))
    base = F.when(F.coalesce("new_asked", F.lit(False)), R_ASKED).otherwise(R_NEW)
    return d.select(
        *writes.columns, F.coalesce("n_matched", F.lit(0)).alias("n_matched"), n_new.alias("n_new"),
        F.when(~F.col("valid"), R_INVALID)
        .when(F.coalesce("n_matched", F.lit(0)) == 0, 0.0)
        .when(n_new == 0, R_DUPLICATE)
        .otherwise(base + R_EXTRA * (n_new - 1)).alias("reward"),
    )


def correction_reward(steps: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Reward per step of a correction event.

    The first search earns 0.1; an edit with the new value 0.5, or 0.6 after a search; another edit 0.1.
    ``steps``: keys (run and event), seq, action ('search', 'edit', ...), has_new.
    """
    keys = list(keys)
    found = steps.where(F.col("action") == "search").groupBy(*keys).agg(F.min(seq).alias("__first"))
    d = steps.join(found, keys, "left")
    first = F.col("__first")
    searched = F.coalesce(first < F.col(seq), F.lit(False))
    return d.withColumn(
        "reward",
        F.when(F.col("action") == "search", F.when(F.col(seq) == first, R_SEARCH).otherwise(0.0))
        .when((F.col("action") == "edit") & F.col("has_new"), F.when(searched, R_EDIT_SEARCHED).otherwise(R_EDIT))
        .when(F.col("action") == "edit", R_EDIT_WRONG)
        .otherwise(0.0),
    ).drop("__first")


def episode_stats(steps: DataFrame, keys: Sequence[str], budget: int) -> DataFrame:
    """Writes used, budget left, answered, correct and correction counts per episode.

    ``steps``: keys, tool, accepted, answered, correct, correction, searched, edited, edit_ok.
    """
    d = steps.groupBy(*keys).agg(
        F.count_if(F.col("accepted")).alias("writes_used"),
        F.count_if("answered").alias("questions_answered"),
        F.count_if(F.col("answered") & F.col("correct")).alias("correct_count"),
        F.count_if("correction").alias("corrections"),
        F.count_if(F.col("correction") & F.col("searched")).alias("with_search"),
        F.count_if(F.col("correction") & F.col("edited")).alias("with_edit"),
        F.count_if(F.col("correction") & F.col("edited") & F.col("edit_ok")).alias("edit_success"),
    )
    return d.withColumn("budget_remaining", F.greatest(F.lit(budget) - F.col("writes_used"), F.lit(0)))


def training_curve(episodes: DataFrame, step: str = "step", reward: str = "reward", correct: str = "correct",
                   episode: str = "sample_id") -> DataFrame:
    """Per step mean and best reward, mean correct, best and worst episode (lowest id on ties)."""
    return episodes.groupBy(step).agg(
        F.count(F.lit(1)).alias("n"), F.avg(reward).alias("mean_reward"), F.max(reward).alias("max_reward"),
        F.avg(correct).alias("mean_correct"),
        F.min(F.struct((-F.col(reward)).alias("r"), F.col(episode).alias("e")))["e"].alias("best_episode"),
        F.min(F.struct(F.col(reward).alias("r"), F.col(episode).alias("e")))["e"].alias("worst_episode"),
    )


def training_summary(curve: DataFrame, step: str = "step") -> DataFrame:
    """First, last and best values of a curve in one row."""
    return curve.agg(
        F.count(F.lit(1)).alias("steps"),
        F.min_by("mean_reward", step).alias("first_reward"), F.max_by("mean_reward", step).alias("last_reward"),
        F.max("max_reward").alias("best_reward"),
        F.min_by("mean_correct", step).alias("first_correct"), F.max_by("mean_correct", step).alias("last_correct"),
    )
