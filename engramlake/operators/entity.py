"""Entity tables: long and wide form, profiles, documents, quality rules, sampling and selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions.scale import distributed_rank, order_statistics, ranges, running_sum, top_k
from engramlake.session import materialise

NUMERIC = ("int", "float")


def entity_long(wide: DataFrame, attr_def: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per present attribute: keys, attr, dtype, and num / str / dt by type.

    Column types decide the slot; ``attr_def`` gives the declared dtype. One pass, no shuffle.
    """
    types = dict(wide.dtypes)
    cols = [c for c in wide.columns if c not in keys]
    number, text, date = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("date")
    slots = []
    for c in cols:
        t = types[c]
        is_num = t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")
        slots.append(
            F.struct(
                F.lit(c).alias("attr"),
                (F.col(c).cast("double") if is_num else number).alias("num"),
                (F.col(c) if t == "string" else text).alias("str"),
                (F.col(c) if t == "date" else date).alias("dt"),
            )
        )
    long = wide.select(*keys, F.inline(F.array(*slots)))
    long = long.where(F.col("num").isNotNull() | F.col("str").isNotNull() | F.col("dt").isNotNull())
    # the catalogue is a handful of rows, but of unknown size to Spark, which would send the entities instead
    return long.join(F.broadcast(attr_def.select("attr", "dtype")), "attr").select(*keys, "attr", "dtype", "num", "str", "dt")


def entity_wide(long: DataFrame, keys: Sequence[str], attrs: Mapping[str, str]) -> DataFrame:
    """Pivot back: ``attrs`` maps each attribute to its slot (num, str or dt)."""
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("attr") == a, F.col(slot))).alias(a) for a, slot in attrs.items()
    ])


def attr_profile(long: DataFrame, by: Sequence[str] = ("world_id",)) -> DataFrame:
    """Which attributes a world carries: type, carriers, range, mean text length, question gates."""
    d = long.groupBy(*by, "attr", "dtype").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.min("num").alias("min_num"), F.max("num").alias("max_num"),
        F.avg(F.length("str")).alias("avg_length"),
    )
    n, numeric = F.col("n_entities"), F.col("dtype").isin(*NUMERIC)
    return d.select(
        "*",
        (numeric & (n >= 2)).alias("ok_for_aggregation"),
        (numeric & (n >= 4)).alias("ok_for_condition"),
        (numeric & (n >= 5)).alias("ok_for_set"),
    )


def format_value(num: Column, text: Column, date: Column, dtype: Column, unit: Column) -> Column:
    """Display form: thousands separators, two decimals for floats, unit in front or behind."""
    body = (
        F.when(dtype == "int", F.format_number(num, 0))
        .when(dtype == "float", F.format_number(num, 2))
        .when(dtype == "date", date.cast("string"))
        .otherwise(text)
    )
    unit = F.coalesce(unit, F.lit(""))
    return F.when(unit == "$", F.concat(unit, body)).otherwise(F.concat(body, unit))


def compact_document(long: DataFrame, attr_def: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``label: value | label: value`` per entity in catalogue order; missing attributes are skipped.

    The list collected per entity is bounded by the attribute catalogue.
    """
    d = long.drop("dtype").join(attr_def.select("attr", "dtype", "label", "unit", "position"), "attr")
    part = F.concat(
        F.col("label"), F.lit(": "),
        format_value(F.col("num"), F.col("str"), F.col("dt"), F.col("dtype"), F.col("unit")),
    )
    parts = F.array_sort(F.collect_list(F.struct("position", part.alias("part"))))
    return d.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["part"]), " | ").alias("document"))


def range_rules(attr_def_rows: Sequence[tuple]) -> dict[str, str]:
    """Rules that every numeric attribute lies within its declared range."""
    return {
        f"{r[0]}_in_range": f"{r[0]} < {r[2]!r} OR {r[0]} > {r[3]!r}"
        for r in attr_def_rows if r[1] in NUMERIC
    }


def constraint_violations(wide: DataFrame, rules: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """Count rows breaking each named SQL predicate in one pass; null predicates do not count."""
    hits = F.array_compact(F.array(*[
        F.when(F.expr(pred), F.lit(name)).otherwise(F.lit(None).cast("string")) for name, pred in rules.items()
    ]))
    return wide.select(*by, F.explode(hits).alias("rule")).groupBy(*by, "rule").agg(
        F.count(F.lit(1)).alias("n_violations")
    )


# --- deterministic sampling, ranking, selection -------------------------------------------------


def hash_order(seed: int, *cols: str) -> Column:
    """Repeatable pseudo-random sort key: the same under any partitioning."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def sample_k_per_group(df: DataFrame, keys: Sequence[str], k: int, key_cols: Sequence[str], *,
                       seed: int = 42, order: Column | None = None) -> DataFrame:
    """``k`` rows per group without replacement, in hash order (or a given order)."""
    first = order if order is not None else hash_order(seed, *key_cols)
    return top_k(df, keys, [first, *[F.col(c) for c in key_cols]], k, "__rn").drop("__rn")


def extreme_count(long: DataFrame, keys: Sequence[str], min_values: int = 5) -> DataFrame:
    """Per entity, how many numeric attributes sit in the lowest or highest fifth of the world.

    rank/n <= 0.2 means smaller than the (floor(n/5)+1)-th value, rank/n >= 0.8 means at least the
    ceil(4n/5)-th, so two exact order statistics per (world, attr) replace a rank over the world.
    """
    num = long.where(F.col("dtype").isin(*NUMERIC))
    n = F.col("n")
    cut = order_statistics(
        num, [*keys, "attr"], "num",
        {"low": F.floor(n / 5) + 1, "high": F.ceil(n * 4 / 5)},
    ).where(n >= min_values)
    low = F.coalesce(F.col("num") < F.col("low"), F.lit(False))
    return (
        num.join(cut, [*keys, "attr"], "left")
        .groupBy(*keys, "entity")
        .agg(F.count_if(F.coalesce(low | (F.col("num") >= F.col("high")), F.lit(False))).alias("n_extreme"))
    )


def entity_importance(long: DataFrame, edges: DataFrame, keys: Sequence[str] = ("world_id",)) -> DataFrame:
    """1 + 1.5 x degree + 0.3 x attributes + 1.5 x extreme attributes."""
    keys = list(keys)
    attrs = long.groupBy(*keys, "entity").agg(F.count(F.lit(1)).alias("n_attrs"))
    ends = edges.select(*keys, F.explode(F.array("source", "target")).alias("entity"))
    degree = ends.groupBy(*keys, "entity").agg(F.count(F.lit(1)).alias("degree"))
    d = attrs.join(degree, [*keys, "entity"], "left").join(extreme_count(long, keys), [*keys, "entity"], "left")
    d = d.select(
        *keys, "entity", F.coalesce("degree", F.lit(0)).alias("degree"), "n_attrs",
        F.coalesce("n_extreme", F.lit(0)).alias("n_extreme"),
    )
    return d.withColumn(
        "importance", 1.0 + F.col("degree") * 1.5 + F.col("n_attrs") * 0.3 + F.col("n_extreme") * 1.5
    )


def entity_priority(long: DataFrame, keys: Sequence[str] = ("world_id",)) -> DataFrame:
    """min(category size, 10) + 0.5 x attributes + 2 x extreme attributes."""
    keys = list(keys)
    attrs = long.groupBy(*keys, "category", "entity").agg(F.count(F.lit(1)).alias("n_attrs"))
    sizes = attrs.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("category_size"))
    d = attrs.join(sizes, [*keys, "category"]).join(extreme_count(long, keys), [*keys, "entity"], "left")
    return d.select(
        *keys, "entity", "category_size", "n_attrs", F.coalesce("n_extreme", F.lit(0)).alias("n_extreme"),
        (F.least(F.col("category_size"), F.lit(10)) + F.col("n_attrs") * 0.5
         + F.coalesce("n_extreme", F.lit(0)) * 2.0).alias("priority_score"),
    )


def select_budgeted(scored: DataFrame, keys: Sequence[str], score: str, tie: str, *,
                    budget: int | None = None, ratio: float | None = None, forced: str | None = None) -> DataFrame:
    """Keep the best-scored entities per world: ``budget`` of them, or max(1, int(n * ratio)).

    Forced rows come first and are always kept; they push out the lowest-scored ones.
    ``tie`` is an integer id. A fixed budget prunes before the shuffle; a ratio ranks each world
    in score ranges.
    """
    keys = list(keys)
    must = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    if budget is not None:
        kept = top_k(scored.where(~must), keys, [F.col(score).desc(), F.col(tie)], budget, "__rn")
        if not forced:
            return kept.drop("__rn")
        n_forced = scored.where(must).groupBy(*keys).agg(F.count(F.lit(1)).alias("__nf"))
        kept = kept.join(n_forced, keys, "left").where(
            F.col("__rn") + F.coalesce("__nf", F.lit(0)) <= budget
        ).drop("__rn", "__nf")
        return kept.unionByName(scored.where(must))
    sizes = scored.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * ratio)).alias("__k"), F.count_if(must).alias("__nf")
    )
    ranked = distributed_rank(scored.where(~must), keys, score, tie, "__rn")
    kept = ranked.join(sizes, keys).where(F.col("__rn") + F.col("__nf") <= F.col("__k")).drop("__rn", "__k", "__nf")
    return kept.unionByName(scored.where(must)) if forced else kept


def weighted_choice(weighted: DataFrame, draws: DataFrame, keys: Sequence[str], weight: str, seq: str, item: str, *,
                    fresh: str | None = None, chunk_rows: int = 1_000_000, buckets: int | None = None) -> DataFrame:
    """For each draw ``r`` in [0, 1] of a group pick the first item whose cumulative weight >= r x total.

    ``weighted`` lists items in integer ``seq`` order; ``draws`` has the keys, draw_id and r. A group that has rows
    with a true ``fresh`` column is drawn from those only. If all weights of a group are zero or null, each counts
    one. Groups without items and draws whose r is null give no row.

    Items at their cumulative weight and draws at r x total lie on one axis, which is cut into ranges; a draw takes
    the item that follows it, in its range or the next that has one. No draw meets more than that one item.
    """
    keys = list(keys)
    new = F.coalesce(F.col(fresh), F.lit(False)) if fresh else F.lit(True)
    w = weighted.select(
        *keys, F.col(seq).alias("__seq"), F.col(item).alias("chosen"), F.coalesce(F.col(weight), F.lit(0)).alias("__w"), new.alias("__new")
    )
    w = materialise(w, "items")
    size = w.groupBy(*keys).agg(
        F.bool_or("__new").alias("__any"), F.sum("__w").alias("__all"), F.sum(F.when(F.col("__new"), F.col("__w"))).alias("__some")
    ).select(*keys, "__any", F.when(F.col("__any"), F.col("__some")).otherwise(F.col("__all")).alias("__sum"))
    w = w.join(size, keys).where(F.col("__new") | ~F.col("__any"))
    step = F.when(F.col("__sum") > 0, F.col("__w")).otherwise(F.lit(1))
    w = running_sum(w.select(*keys, "__seq", "chosen", step.alias("__w")), keys, "__seq", {"__cum": F.col("__w")}, chunk_rows=chunk_rows)
    w = materialise(w, "weights")
    total = w.groupBy(*keys).agg(F.max("__cum").alias("__total"))
    aims = draws.where(F.col("r").isNotNull()).join(total, keys).select(
        *keys, "draw_id", "r", (F.col("r") * F.col("__total")).cast("double").alias("__at"), F.lit(1).alias("__kind")
    )
    marks = w.select(*keys, "__seq", "chosen", F.col("__cum").cast("double").alias("__at"), F.lit(0).alias("__kind"))
    # from the far end: an item before the draws it serves, of equal places the first item last
    order = [F.col("__at").desc(), F.col("__kind").asc(), F.col("__seq").desc()]
    d = ranges(marks.unionByName(aims, allowMissingColumns=True), [*keys, *order], buckets, "draws")
    mark = F.col("__kind") == 0
    upto = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(mark, F.struct("chosen")), ignorenulls=True).over(upto)
    ends = d.where(mark).groupBy(*keys, "__range").agg(
        F.min_by(F.struct("chosen"), F.struct("__at", "__seq")).alias("__end")
    )
    held = d.select(*keys, "__range").distinct().join(ends, [*keys, "__range"], "left")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*keys, "__range", F.last("__end", ignorenulls=True).over(before).alias("__end"))
    return d.withColumn("__near", near).where(~mark).join(held, [*keys, "__range"]).select(
        *keys, "draw_id", "r", F.coalesce("__near", "__end")["chosen"].alias("chosen")
    )


CURRICULUM = {"lite": 0.6, "standard": 0.3, "hard": 0.1}


def curriculum_mix(templates: DataFrame, seeds: int, mix: Mapping[str, float] = CURRICULUM, *, shuffle_seed: int = 42,
                   shuffle: bool = True) -> DataFrame:
    """(template, tier, seed, salt) rows: max(1, int(seeds * share)) seeds per tier, hash-shuffled."""
    parts = F.array(*[
        F.struct(F.lit(tier).alias("tier"), F.lit(max(1, int(seeds * share))).alias("n")) for tier, share in mix.items()
    ])
    d = templates.select("template", F.inline(parts)).select(
        "template", "tier", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seed")
    )
    d = d.withColumn("salt", (F.col("seed") * 6971 + F.crc32(F.encode("template", "utf-8"))) % 65536)
    return d.orderBy(hash_order(shuffle_seed, "template", "tier", "seed")) if shuffle else d


def expand_groups(configs: DataFrame, group_size: int) -> DataFrame:
    """Repeat each configuration with sample_id 0 .. group_size-1."""
    return configs.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(group_size - 1))))

