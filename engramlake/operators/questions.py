"""Ground truths of the analytic question types, one answer row per world and parameter set.

Entity frames are long (world_id, entity, category, attr, dtype, num, str, dt) or wide. Ties go to
the smaller name, except ``q_conditional`` where the larger name wins. Rows that a question needs
are listed in ``required`` (names joined by ``|``) where their number is bounded; for questions over
whole groups they stay a relation, see ``group_members``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from engramlake.functions.scale import hashed_rank, order_statistics, top_k
from engramlake.functions.text import exploded
from engramlake.operators.entity import NUMERIC
from engramlake.session import materialise

WORLD = "world_id"


def numeric(long: DataFrame) -> DataFrame:
    return long.where(F.col("dtype").isin(*NUMERIC))


def _best(value: Column, name: Column) -> Column:
    """Name of the largest value, smaller name on ties."""
    return F.min(F.struct((-value).alias("v"), name.alias("n")))["n"]


def _least(value: Column, name: Column) -> Column:
    return F.min(F.struct(value.alias("v"), name.alias("n")))["n"]


def _joined(names: Column) -> Column:
    return F.array_join(F.array_sort(names), "|")


def pair_table(wide: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """One row per entity and attribute pair with both values present. No shuffle."""
    both = F.array(*[
        F.struct(
            F.lit(a).alias("attr1"), F.col(a).cast("double").alias("v1"),
            F.lit(b).alias("attr2"), F.col(b).cast("double").alias("v2"),
        )
        for a, b in pairs
    ])
    return wide.select(*keys, F.inline(both)).where(F.col("v1").isNotNull() & F.col("v2").isNotNull())


def q_retrieval(questions: DataFrame, long: DataFrame) -> DataFrame:
    """Value of a present attribute of an entity."""
    return questions.join(long, [WORLD, "entity", "attr"]).select(
        *questions.columns, "num", "str", "dt", F.col("entity").alias("required")
    )


def q_update(corrections: DataFrame, current: DataFrame) -> DataFrame:
    """Current value of every corrected attribute."""
    asked = corrections.select(WORLD, "entity", "attr").distinct()
    return asked.join(current.where(F.col("value").isNotNull()), [WORLD, "entity", "attr"]).select(
        WORLD, "entity", "attr", F.col("value").alias("answer_value")
    )


def candidate_sets(long: DataFrame, order: Column, k: int = 5) -> DataFrame:
    """``k`` carriers of each numeric attribute per world, in the given pseudo-random order."""
    return top_k(numeric(long), [WORLD, "attr"], [order, F.col("entity")], k, "slot")


def q_synthesis(sets: DataFrame, k: int = 5) -> DataFrame:
    """Highest and lowest of a full set of ``k``."""
    v, n = F.col("num"), F.col("entity")
    return sets.groupBy(WORLD, "attr").agg(
        F.count(F.lit(1)).alias("n"), _best(v, n).alias("highest"), F.max(v).alias("highest_value"),
        _least(v, n).alias("lowest"), F.min(v).alias("lowest_value"), _joined(F.collect_list(n)).alias("required"),
    ).where(F.col("n") >= k).drop("n")


def q_aggregation(long: DataFrame, attr_def: DataFrame, order: Column, max_members: int = 4) -> DataFrame:
    """Total and average over up to four members of a category, where the attribute allows the op."""
    picked = top_k(numeric(long), [WORLD, "attr", "category"], [order, F.col("entity")], max_members)
    d = picked.groupBy(WORLD, "attr", "category").agg(
        F.count(F.lit(1)).alias("n_members"), F.sum("num").alias("total"), F.avg("num").alias("average"),
        _joined(F.collect_list("entity")).alias("required"),
    ).where(F.col("n_members") >= 2)
    ops = attr_def.select("attr", F.explode("agg_ops").alias("op"))
    return d.join(ops, "attr").select(
        WORLD, "attr", "category", "op", "n_members",
        F.when(F.col("op") == "total", F.col("total")).otherwise(F.col("average")).alias("answer_value"), "required",
    )


def q_cross_category(pairs: DataFrame, ks: Sequence[int] = (3, 4, 5), min_candidates: int = 5) -> DataFrame:
    """Total and average of attr2 over the top / bottom k by attr1, if they span two categories."""
    key = [WORLD, "attr1", "attr2", "direction"]
    both = pairs.withColumn(
        "__d", F.explode(F.array(F.struct(F.lit("highest").alias("direction"), (-F.col("v1")).alias("o")),
                                 F.struct(F.lit("lowest").alias("direction"), F.col("v1").alias("o"))))
    ).select("*", "__d.direction", F.col("__d.o").alias("__o"))
    top = top_k(both, key, [F.col("__o"), F.col("entity")], max(max(ks), min_candidates), "__rn")
    aggs = [F.count(F.lit(1)).alias("__n")]
    for k in ks:
        inside = F.col("__rn") <= k
        aggs += [
            F.sum(F.when(inside, F.col("v2"))).alias(f"__s{k}"),
            F.size(F.collect_set(F.when(inside, F.col("category")))).alias(f"__c{k}"),
            _joined(F.collect_list(F.when(inside, F.col("entity")))).alias(f"__r{k}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"__s{k}").alias("total"), (F.col(f"__s{k}") / k).alias("average"),
                 F.col(f"__c{k}").cast("bigint").alias("n_categories"), F.col(f"__r{k}").alias("required"))
        for k in ks
    ])
    return (
        top.groupBy(*key).agg(*aggs).where(F.col("__n") >= min_candidates)
        .select(*key, F.inline(rows)).where(F.col("n_categories") >= 2)
    )


def q_conditional(pairs: DataFrame, min_candidates: int = 4) -> DataFrame:
    """Among entities above the middle element of attr1: the one with the highest attr2."""
    key = [WORLD, "attr1", "attr2"]
    cut = order_statistics(pairs, key, "v1", {"threshold": F.floor(F.col("n") / 2) + 1})
    d = pairs.join(cut.where(F.col("n") >= min_candidates), key).where(F.col("v1") > F.col("threshold"))
    best = F.max(F.struct("v2", "entity"))
    return d.groupBy(*key, "threshold").agg(F.count(F.lit(1)).alias("n_above"), best.alias("b")).where(
        F.col("n_above") >= 2
    ).select(*key, "threshold", "n_above", F.col("b.entity").alias("answer"), F.col("b.v2").alias("answer_value"))


def q_ratio(long: DataFrame, ratio_pair: DataFrame) -> DataFrame:
    """attr1 / attr2 for declared pairs, denominator not zero."""
    num = numeric(long).select(WORLD, "entity", "attr", "num")
    a = num.select(WORLD, "entity", F.col("attr").alias("attr1"), F.col("num").alias("v1")).join(ratio_pair, "attr1")
    b = num.select(WORLD, "entity", F.col("attr").alias("attr2"), F.col("num").alias("v2"))
    return a.join(b, [WORLD, "entity", "attr2"]).where(F.col("v2") != 0).select(
        WORLD, "entity", "attr1", "attr2", "label", (F.col("v1") / F.col("v2")).alias("answer_value")
    )


def q_comparison(entity_pairs: DataFrame, long: DataFrame) -> DataFrame:
    """Which of two entities has the higher value, and the difference; equal values favour the first.

    ``entity_pairs``: world_id, first, second.
    """
    num = numeric(long).select(WORLD, "entity", "attr", "num")
    a = num.select(WORLD, F.col("entity").alias("first"), "attr", F.col("num").alias("__a"))
    b = num.select(WORLD, F.col("entity").alias("second"), "attr", F.col("num").alias("__b"))
    d = entity_pairs.join(a, [WORLD, "first"]).join(b, [WORLD, "second", "attr"])
    return d.select(
        WORLD, "first", "second", "attr",
        F.when(F.col("__a") >= F.col("__b"), F.col("first")).otherwise(F.col("second")).alias("answer"),
        F.abs(F.col("__a") - F.col("__b")).alias("answer_value"),
    )


def q_delta(changes: DataFrame) -> DataFrame:
    """Size of every numeric correction."""
    return changes.where(
        (F.col("kind") == "correction") & F.col("old_val").isNotNull() & F.col("new_val").isNotNull()
    ).select(WORLD, "entity", "attr", "seq", F.abs(F.col("new_val") - F.col("old_val")).alias("answer_value"))


def q_counterfactual(changes: DataFrame) -> DataFrame:
    """Value before every numeric correction."""
    return changes.where((F.col("kind") == "correction") & F.col("old_val").isNotNull()).select(
        WORLD, "entity", "attr", "seq", F.col("old_val").alias("answer_value")
    )


def q_multi_hop(pairs: DataFrame) -> DataFrame:
    """Category with the extreme mean of attr1, then the extreme of attr2 inside it (four variants).

    Both steps come out of one aggregation per category, so nothing is joined back.
    """
    key = [WORLD, "attr1", "attr2"]
    v2, name = F.col("v2"), F.col("entity")
    cats = pairs.groupBy(*key, "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v1").alias("mean1"),
        _best(v2, name).alias("top_entity"), F.max(v2).alias("top_value"),
        _least(v2, name).alias("low_entity"), F.min(v2).alias("low_value"),
    ).where(F.col("n") >= 2)
    rest = ["category", "n", "top_entity", "top_value", "low_entity", "low_value"]
    best = cats.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.min(F.struct((-F.col("mean1")).alias("o"), *rest)).alias("hi"),
        F.min(F.struct(F.col("mean1").alias("o"), *rest)).alias("lo"),
    ).where(F.col("n_categories") >= 2)
    variants = F.array(*[
        F.struct(
            F.lit(cat_dir).alias("category_direction"), F.lit(ent_dir).alias("entity_direction"),
            F.col(f"{c}.category").alias("category"), F.col(f"{c}.n").alias("n_members"),
            F.col(f"{c}.{e}_entity").alias("answer"), F.col(f"{c}.{e}_value").alias("answer_value"),
        )
        for cat_dir, c in (("highest", "hi"), ("lowest", "lo"))
        for ent_dir, e in (("highest", "top"), ("lowest", "low"))
    ])
    return best.select(*key, F.inline(variants))


def q_outlier(sets: DataFrame, k: int = 5) -> DataFrame:
    """Member of a set of ``k`` furthest from the set's mean. A set is at most ``k`` rows."""
    d = sets.groupBy(WORLD, "attr").agg(
        F.count(F.lit(1)).alias("n"), F.avg("num").alias("mean"),
        F.collect_list(F.struct("entity", "num")).alias("m"),
    ).where(F.col("n") >= k)
    far = F.array_min(F.transform("m", lambda x: F.struct((-F.abs(x["num"] - F.col("mean"))).alias("d"), x["entity"].alias("e"))))
    return d.select(
        WORLD, "attr", far["e"].alias("answer"), (-far["d"]).alias("answer_value"),
        _joined(F.transform("m", lambda x: x["entity"])).alias("required"),
    )


def fold_series(points: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Long series to ARRAY<DOUBLE> ordered by period. A series has a handful of points."""
    pts = F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).cast("double").alias("v"))))
    return points.groupBy(*keys).agg(F.transform(pts, lambda x: x["v"]).alias("series"))


def trend_slope(series: Column) -> Column:
    """Least-squares slope over the index divided by the absolute mean; 0 for a zero mean."""
    n = F.size(series).cast("double")
    xm = (n - 1) / 2
    total = F.aggregate(series, F.lit(0.0), lambda a, v: a + v)
    mean = total / n
    dev = F.transform(series, lambda v, i: (i - xm) * (v - mean))
    num = F.aggregate(dev, F.lit(0.0), lambda a, v: a + v)
    den = n * (n * n - 1) / 12
    return F.when(mean == 0, 0.0).otherwise(F.try_divide(num, den) / F.abs(mean))


def trend_label(slope: Column) -> Column:
    return (
        F.when(slope > 0.15, "strongly rising").when(slope > 0.03, "slightly rising")
        .when(slope < -0.15, "strongly falling").when(slope < -0.03, "slightly falling").otherwise("flat")
    )


def q_temporal_trend(series: DataFrame, keys: Sequence[str], min_length: int = 3) -> DataFrame:
    d = series.where(F.size("series") >= min_length)
    return d.select(*keys, trend_slope(F.col("series")).alias("slope")).withColumn(
        "answer", trend_label(F.col("slope"))
    )


def q_temporal_extreme(series: DataFrame, keys: Sequence[str], min_length: int = 3) -> DataFrame:
    """First period (from 1) of the highest and of the lowest value."""
    s = F.col("series")
    return series.where(F.size(s) >= min_length).select(
        *keys, F.array_position(s, F.array_max(s)).alias("highest_period"),
        F.array_position(s, F.array_min(s)).alias("lowest_period"),
    )


PUNCTUATION = ".,;:!?()\"'"
PREFIX, SHORT = 5, 3  # a phrase of one word has more than four letters, each of two words more than two


def _neighbours(texts: DataFrame, scope: list[str], entity: str, text: str) -> DataFrame:
    """Distinct words with the next one (null behind the last): scope, a, b, direct, lo, hi.

    Words are the tokens between white space, lower-cased and trimmed of punctuation; ``direct`` says that nothing but one
    blank parts them. ``lo`` and ``hi`` are the smallest and the largest entity: all that tells whether one only has them.
    """
    white, signs = F.lit(" \t\n\x0b\f\r"), F.lit(PUNCTUATION)
    spaced = F.regexp_extract_all(F.lower(text), F.lit(r"\S+\s*"), F.lit(0))
    d = texts.where(F.length(text) > 20).select(*scope, F.col(entity).alias("__e"), spaced.alias("one"))
    d = d.where(" and ".join(f"`{c}` is not null" for c in [*scope, "__e"]))
    d = d.withColumn("two", F.slice("one", F.lit(2), F.greatest(F.size("one") - 1, F.lit(0))))
    rows = exploded(d, [*scope, "__e"], F.arrays_zip("one", "two"), "p")
    one, two = F.col("p.one"), F.rtrim(F.col("p.two"), white)
    a, b = F.trim(F.rtrim(one, white), signs), F.trim(two, signs)
    direct = F.endswith(one, F.concat(a, F.lit(" "))) & F.startswith(two, b)
    return rows.select(*scope, "__e", a.alias("a"), b.alias("b"), direct.alias("direct")).groupBy(*scope, "a", "b", "direct").agg(
        F.min("__e").alias("lo"), F.max("__e").alias("hi")
    )


def _merge(into: dict, key: object, lo: object, hi: object) -> None:
    old = into.get(key)
    if old is None:
        into[key] = (lo, hi)
    elif lo < old[0] or hi > old[1]:
        into[key] = (min(lo, old[0]), max(hi, old[1]))


def _held_in_words(gram: str, single: dict, tokens: dict) -> dict:
    """Holders of the words ``single``, which all begin with ``gram``, as parts of the words ``tokens``."""
    lengths, found = sorted({len(w) for w, _ in single}), {}
    for (token, _), (lo, hi) in tokens.items():
        at = token.find(gram)
        while at >= 0:
            for n in lengths:
                if at + n > len(token):
                    break
                if (key := (token[at : at + n], None)) in single:
                    _merge(found, key, lo, hi)
            at = token.find(gram, at + 1)
    return found


def _held_across(gram: str, single: dict, pairs: dict) -> dict:
    """Holders of the word pairs ``single`` as the end of a word and the beginning of the next one."""
    heads: dict[str, set[int]] = {}
    for a, b in single:
        heads.setdefault(a, set()).add(len(b))
    lengths, found = sorted({len(a) for a in heads}), {}
    for (one, two), (lo, hi) in pairs.items():
        for n in lengths:
            if n > len(one):
                break
            for m in heads.get(one[-n:], ()):
                if (key := (one[-n:], two[:m])) in single:
                    _merge(found, key, lo, hi)
    return found


def _values(column: pa.Array) -> list:
    """As ``to_pylist``, which makes an object of Arrow for each value first; numbers and strings go by numpy."""
    t = column.type
    if pa.types.is_string(t) or pa.types.is_large_string(t) or (pa.types.is_integer(t) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _unique(rows: DataFrame, scope: list[str], held: Callable[[str, dict, dict], dict]) -> DataFrame:
    """(scope, x, y, answer) of the phrases that one entity only has, in its own words and in what holds it.

    ``rows``: scope, gram, kind (1 a phrase, 2 words that may hold one, 3 both), x, y, lo, hi. A phrase and all
    that can hold it share a gram, and one task has all rows of a gram.
    """
    n = len(scope)
    cols = [*scope, "gram", "kind", "x", "y", "lo", "hi"]
    fields = {f.name: f for f in rows.schema}
    schema = StructType([*[fields[c] for c in scope], StructField("x", StringType()), StructField("y", StringType()), StructField("answer", fields["lo"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, phrases, tokens, out, form = None, {}, {}, [], None

        def done() -> None:
            single = {key: lo for key, (lo, hi) in phrases.items() if lo == hi}
            if single:
                out.extend((*now[:n], *key, lo) for key, (lo, hi) in held(now[n], single, tokens).items() if lo == hi == single[key])
            phrases.clear()
            tokens.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * (n + 3)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, form, strict=True)], schema=form)

        for b in batches:
            if form is None:
                form = pa.schema([*[b.schema.field(i) for i in range(n)], b.schema.field(n + 2).with_name("x"), b.schema.field(n + 3).with_name("y"), b.schema.field(n + 4).with_name("answer")])
            parts = [_values(b.column(i)) for i in range(n + 6)]
            for key, kind, x, y, lo, hi in zip(zip(*parts[: n + 1], strict=True), *parts[n + 1 :], strict=True):
                if key != now:
                    done()
                    now = key
                if kind & 1:
                    _merge(phrases, (x, y), lo, hi)
                if kind & 2:
                    _merge(tokens, (x, y), lo, hi)
            yield batch()
        if now is not None:
            done()
            yield batch()

    return rows.select(*cols).repartition(*scope, "gram").sortWithinPartitions(*scope, "gram").mapInArrow(run, schema)


def q_text_match(texts: DataFrame, scope: Sequence[str], entity: str, text: str) -> DataFrame:
    """All phrases that occur, as a substring and ignoring case, in exactly one entity's text.

    Phrases, trimmed of punctuation, are words over 4 letters and neighbouring pairs of words over 2 letters. As a phrase
    begins and ends with another character, one of a word lies within one word; one of two is the end of a word and
    the beginning of the next, with nothing but a blank between them. So no text moves, and texts are read once: distinct
    words with their next ones carry their first and last holder. A phrase of a word meets the words that have its first
    ``PREFIX`` characters somewhere, one of two meets the pairs with its ``SHORT`` characters on either side of the blank.
    """
    scope = list(scope)
    seen = materialise(_neighbours(texts, scope, entity, text), "word-pairs")  # read by both searches
    words = seen.where(F.length("a") >= PREFIX).groupBy(*scope, "a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    places = F.transform(F.sequence(F.lit(1), F.length("a") - PREFIX + 1), lambda i: F.substr(F.col("a"), i, F.lit(PREFIX)))
    kind = F.when(F.startswith("a", F.col("gram")), 3).otherwise(2).alias("kind")
    rows = exploded(words, [*scope, "a", "lo", "hi"], F.array_distinct(places), "gram").select(
        *scope, "gram", kind, F.col("a").alias("x"), F.lit(None).cast("string").alias("y"), "lo", "hi"
    )
    # written by itself, so that its shuffle files go before the next search begins
    found = materialise(_unique(rows, scope, _held_in_words), "words-of-one")
    gram = F.concat(F.right("a", F.lit(SHORT)), F.substr("b", F.lit(1), F.lit(SHORT)))
    rows = seen.where((F.length("a") >= SHORT) & (F.length("b") >= SHORT)).select(
        *scope, gram.alias("gram"), F.when(F.col("direct"), 3).otherwise(1).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), "lo", "hi"
    )
    found = found.unionByName(_unique(rows, scope, _held_across))
    return found.select(*scope, F.concat_ws(" ", "x", "y").alias("phrase"), F.col("answer"))


def q_enum_filter(wide: DataFrame, enum_attr: str, numeric_attrs: Sequence[str]) -> DataFrame:
    """Within each enum value with at least two members: entity with the highest / lowest number."""
    vals = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("double").alias("v")) for a in numeric_attrs])
    d = wide.where(F.col(enum_attr).isNotNull()).select(
        WORLD, "entity", F.col(enum_attr).alias("enum_value"), F.inline(vals)
    ).where(F.col("v").isNotNull())
    v, n = F.col("v"), F.col("entity")
    return d.groupBy(WORLD, "enum_value", "attr").agg(
        F.count(F.lit(1)).alias("n_members"), _best(v, n).alias("highest"), _least(v, n).alias("lowest")
    ).where(F.col("n_members") >= 2)


def group_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The entities a group question requires, as a relation."""
    return df.select(*keys, "entity").distinct()


# --- relationships ------------------------------------------------------------------------------


def known_edges(edges: DataFrame, available: DataFrame) -> DataFrame:
    """Edges with both ends available. Relations are read source to target only."""
    names = available.select(WORLD, "entity").distinct()
    return edges.join(names.withColumnRenamed("entity", "source"), [WORLD, "source"], "left_semi").join(
        names.withColumnRenamed("entity", "target"), [WORLD, "target"], "left_semi"
    ).select(WORLD, "source", "relation", "target")


def q_relationship_lookup(edges: DataFrame) -> DataFrame:
    return edges.select(WORLD, "source", "relation", F.col("target").alias("answer"))


def q_relationship_hop(edges: DataFrame, long: DataFrame) -> DataFrame:
    """Every numeric attribute of the target."""
    num = numeric(long).select(WORLD, F.col("entity").alias("target"), "attr", F.col("num").alias("answer_value"))
    return edges.join(num, [WORLD, "target"]).select(WORLD, "source", "relation", "target", "attr", "answer_value")


def q_relationship_chain(edges: DataFrame, long: DataFrame) -> DataFrame:
    """Paths A -> B -> C with C != A, and C's numeric attributes."""
    first = edges.select(WORLD, F.col("source").alias("a"), F.col("relation").alias("r1"), F.col("target").alias("b"))
    second = edges.select(WORLD, F.col("source").alias("b"), F.col("relation").alias("r2"), F.col("target").alias("c"))
    num = numeric(long).select(WORLD, F.col("entity").alias("c"), "attr", F.col("num").alias("answer_value"))
    return first.join(second, [WORLD, "b"]).where(F.col("c") != F.col("a")).join(num, [WORLD, "c"]).select(
        WORLD, "a", "r1", "b", "r2", "c", "attr", "answer_value"
    )


def q_relationship_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy(WORLD, "source", "relation").agg(F.count(F.lit(1)).alias("answer_value")).where(
        F.col("answer_value") >= 2
    )


def q_relationship_filter(edges: DataFrame, long: DataFrame) -> DataFrame:
    """Among at least two related entities carrying the attribute: highest and lowest."""
    num = numeric(long).select(WORLD, F.col("entity").alias("target"), "attr", "num")
    v, n = F.col("num"), F.col("target")
    return edges.join(num, [WORLD, "target"]).groupBy(WORLD, "source", "relation", "attr").agg(
        F.count(F.lit(1)).alias("n_targets"), _best(v, n).alias("highest"), _least(v, n).alias("lowest")
    ).where(F.col("n_targets") >= 2)


# --- constraints, abstention, assembly ----------------------------------------------------------


def q_multi_constraint(wide: DataFrame, attr1: str, attr2: str, enum_attr: str) -> DataFrame:
    """Entities above the lower-third element of attr1 and below the upper-third element of attr2.

    Counted without and with an enum equality (one row per enum value); a missing value fails.
    """
    third = F.floor(F.col("n") / 3)
    low = order_statistics(wide.withColumn("__x", F.col(attr1).cast("double")), [WORLD], "__x", {"low": third + 1})
    high = order_statistics(
        wide.withColumn("__x", F.col(attr2).cast("double")), [WORLD], "__x", {"high": F.col("n") - third}
    )
    d = wide.join(low.select(WORLD, "low"), WORLD).join(high.select(WORLD, "high"), WORLD)
    match = F.coalesce((F.col(attr1) > F.col("low")) & (F.col(attr2) < F.col("high")), F.lit(False))
    per_value = d.groupBy(WORLD, enum_attr, "low", "high").agg(F.count_if(match).alias("c"), F.count(F.lit(1)).alias("t"))
    overall = per_value.groupBy(WORLD, "low", "high").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    rows = overall.select(WORLD, "low", "high", F.lit(None).cast("string").alias("enum_value"), "c", "t").unionByName(
        per_value.where(F.col(enum_attr).isNotNull()).select(WORLD, "low", "high", F.col(enum_attr).alias("enum_value"), "c", "t")
    )
    enough = overall.where(F.col("t") >= 5).select(WORLD)
    return rows.join(enough, WORLD, "left_semi").select(
        WORLD, F.col("low").alias("above"), F.col("high").alias("below"), "enum_value", F.col("c").alias("answer_value")
    )


def q_abstention(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """Asked names that do not exist in the world."""
    return asked.join(entities.select(WORLD, "entity"), [WORLD, "entity"], "left_anti").withColumn(
        "answer", F.lit("ABSTAIN")
    )


QUESTION_WEIGHTS = {"retrieval": 0.40, "comprehension": 0.25, "update": 0.20, "abstention": 0.15}


def question_quota(episodes: DataFrame) -> DataFrame:
    """Split n_questions by kind.

    ``episodes``: n_questions, n_corrections, n_contradictions, w_retrieval, w_update, w_abstention. Without
    corrections half of the update weight goes to retrieval and abstention shrinks to 0.67.
    """
    n = F.col("n_questions")
    tenth = F.greatest(F.lit(1), F.floor(n / 10)).cast("bigint")
    d = episodes.withColumn("n_trick", F.least(F.lit(2), tenth).cast("bigint")).withColumn(
        "n_contradiction", F.when(F.col("n_contradictions") > 0, F.least("n_contradictions", tenth)).otherwise(0).cast("bigint")
    )
    has = F.col("n_corrections") > 0

    def rnd(x: Column) -> Column:
        return F.rint(n * x).cast("bigint")

    update = F.greatest(
        F.lit(0), F.least(F.greatest(F.lit(1), rnd(F.col("w_update"))) - F.col("n_contradiction"), F.col("n_corrections"))
    )
    d = d.withColumn("n_update", F.when(has, update).otherwise(0).cast("bigint"))
    d = d.withColumn(
        "n_delta",
        F.when(has & (F.col("n_update") > 0), F.greatest(F.lit(1), F.floor(F.col("n_update") / 3))).otherwise(0).cast("bigint"),
    )
    weight = F.when(has, F.col("w_retrieval")).otherwise(F.col("w_retrieval") + F.col("w_update") * 0.5)
    d = d.withColumn("n_retrieval", rnd(weight) - F.col("n_trick"))
    share = F.when(has, F.col("w_abstention")).otherwise(F.col("w_abstention") * 0.67)
    d = d.withColumn("n_abstention", F.greatest(F.lit(1), rnd(share)).cast("bigint"))
    used = F.col("n_retrieval") + F.col("n_update") + F.col("n_abstention") + F.col("n_trick") + F.col("n_delta") + F.col("n_contradiction")
    return d.withColumn("n_comprehension", n - used)


QUOTA_KINDS = ["retrieval", "update", "delta", "contradiction", "comprehension", "abstention", "trick"]


def question_slots(quota: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per question slot of each kind, numbered from 0."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n")) for k in QUOTA_KINDS])
    return quota.select(*keys, F.inline(kinds)).where(F.col("n") > 0).select(
        *keys, "kind", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("slot")
    )


# Comprehension types; the first two take the first slots.
COMPREHENSION_TYPES = [
    "multi_constraint", "counterfactual", "synthesis", "aggregation", "cross_category", "conditional", "ratio",
    "comparison", "multi_hop", "outlier", "temporal_trend", "temporal_extreme", "text_match", "enum_filter",
    "relationship_lookup", "relationship_hop", "relationship_chain", "relationship_count", "relationship_filter",
]


def _preferred(competency: Column, primary: Column, types: Sequence[str]) -> Column:
    order = F.array_position(F.array(*[F.lit(x) for x in types]), competency)
    return F.when(competency == primary, F.lit(0)).otherwise(order)


def _fill(slots: DataFrame, pool: DataFrame, keys: Sequence[str], slot_id: str, primary: Column,
          types: Sequence[str]) -> DataFrame:
    """Give each slot its primary type, else the first type in order with a candidate in the pool.

    Slots meet the list of available types (at most one row per type and world), never the candidates
    themselves; the chosen type's n-th slot then takes its n-th candidate, starting over when they run out.
    """
    keys = list(keys)
    have = pool.groupBy(*keys, "competency").agg(F.count(F.lit(1)).alias("__n"))
    rank = _preferred(F.col("competency"), F.col("__primary"), types)
    asked = slots.withColumn("__primary", F.coalesce(primary, F.lit("")))
    best = asked.select(*keys, "__primary").distinct().join(have, keys).groupBy(*keys, "__primary").agg(
        F.min_by(F.struct(rank.alias("__pref"), "competency", "__n"), rank).alias("c")
    )
    chosen = (
        asked.join(best, [*keys, "__primary"])
        .groupBy(*keys, slot_id)
        .agg(F.min_by("c", F.col("c.__pref")).alias("c"))
        .select(*keys, slot_id, F.col("c.competency").alias("competency"), F.col("c.__n").alias("__n"))
    )
    chosen = hashed_rank(chosen, [*keys, "competency"], slot_id, "__nth")
    chosen = chosen.withColumn("__at", F.pmod(F.col("__nth") - 1, F.col("__n")) + 1).drop("__nth")
    ranked = hashed_rank(pool, [*keys, "competency"], "candidate_id", "__at")
    return chosen.join(ranked, [*keys, "competency", "__at"]).drop("__at", "__n")


def assign_questions(slots: DataFrame, pool: DataFrame, keys: Sequence[str], types: Sequence[str] = COMPREHENSION_TYPES) -> DataFrame:
    """Fill comprehension slots: slot i prefers type i modulo the number of types; empty pools drop the slot.

    ``pool``: keys, competency, candidate_id.
    """
    names = F.array(*[F.lit(x) for x in types])
    primary = F.element_at(names, (F.pmod(F.col("slot"), F.lit(len(types))) + 1).cast("int"))
    return _fill(slots, pool, keys, "slot", primary, types)


EXEMPT = ("retrieval", "update", "abstention", "delta")


def replace_unanswerable(questions: DataFrame, pool: DataFrame, stored_counts: DataFrame, keys: Sequence[str],
                         types: Sequence[str] = COMPREHENSION_TYPES) -> DataFrame:
    """Swap comprehension questions that need unstored entities for ones built from stored entities.

    ``questions``: keys, question_id, competency, answerable. ``pool``: stored-only candidates.
    ``stored_counts``: keys, n_stored; fewer than two stored entities leave the question as it is.
    """
    keys = list(keys)
    questions = materialise(questions, "questions")  # read by three branches
    pool = materialise(pool, "pool")
    open_rows = questions.where(~F.col("answerable") & ~F.col("competency").isin(*EXEMPT)).join(
        stored_counts.where(F.col("n_stored") >= 2).select(*keys), keys, "left_semi"
    )
    new = _fill(
        open_rows.select(*keys, "question_id", F.col("competency").alias("__asked")),
        pool, keys, "question_id", F.col("__asked"), types,
    ).select(*keys, "question_id", F.col("competency").alias("new_competency"), "candidate_id")
    return questions.join(new, [*keys, "question_id"], "left").select(
        *keys, "question_id", F.col("competency").alias("asked_competency"),
        F.coalesce("new_competency", "competency").alias("competency"), "candidate_id",
        F.col("candidate_id").isNotNull().alias("replaced"),
    )
