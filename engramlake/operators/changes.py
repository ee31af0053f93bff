"""Change data: current, original and as-of state, contradictions, perturbation, correction checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.scale import last_known, lagged
from engramlake.operators.entity import NUMERIC, hash_order, top_k

KEY = ["world_id", "entity", "attr"]


def current_state(base: DataFrame, changes: DataFrame, keys: Sequence[str] = KEY, value: str = "new_val") -> DataFrame:
    """Apply changes in order, last one wins; untouched attributes keep their base value.

    ``base``: keys and ``value``. ``changes``: keys, seq and ``value``.
    """
    keys = list(keys)
    rows = base.select(*keys, F.lit(-1).cast("bigint").alias("seq"), value).unionByName(
        changes.select(*keys, F.col("seq").cast("bigint").alias("seq"), value)
    )
    return rows.groupBy(*keys).agg(
        F.max_by(value, "seq").alias("value"), (F.count(F.lit(1)) - F.count_if(F.col("seq") < 0)).alias("n_changes")
    )


def original_state(base: DataFrame, changes: DataFrame, keys: Sequence[str] = KEY, value: str = "new_val",
                   old: str = "old_val") -> DataFrame:
    """Value before the first change of every touched attribute; untouched ones keep the base value."""
    keys = list(keys)
    first = changes.groupBy(*keys).agg(F.min_by(F.struct(F.col(old).alias("v")), "seq").alias("__f"))
    return base.select(*keys, F.col(value).alias("__b")).join(first, keys, "full_outer").select(
        *keys, F.when(F.col("__f").isNotNull(), F.col("__f.v")).otherwise(F.col("__b")).alias("value")
    )


def state_as_of(documents: DataFrame, changes: DataFrame, keys: Sequence[str] = KEY, value: str = "new_val",
                chunk_rows: int = 1_000_000) -> DataFrame:
    """The value a document at position ``seq`` shows: the latest change at or before it.

    ``documents``: keys and seq. A change at the document's own position counts as already made.
    Positions are doubled so changes sort before documents at the same place.
    """
    keys = list(keys)
    marks = changes.select(*keys, (F.col("seq") * 2).alias("__pos"), F.col(value).alias("__v"), F.lit(False).alias("__doc"))
    docs = documents.select(
        *keys, (F.col("seq") * 2 + 1).alias("__pos"), F.lit(None).cast(dict(changes.dtypes)[value]).alias("__v"),
        F.lit(True).alias("__doc"),
    )
    d = last_known(marks.unionByName(docs), keys, "__pos", {"value": F.col("__v")}, chunk_rows=chunk_rows)
    return d.where("__doc").select(*keys, ((F.col("__pos") - 1) / 2).cast("bigint").alias("seq"), "value")


def detect_contradictions(changes: DataFrame, keys: Sequence[str] = KEY, chunk_rows: int = 1_000_000) -> DataFrame:
    """Attributes that reappear in an ordinary document with another value and no notice."""
    d = lagged(changes, keys, "seq", {"prev_val": "new_val"}, chunk_rows=chunk_rows)
    return d.where((F.col("kind") == "ingest") & (F.col("new_val") != F.col("prev_val")))


def eligible_targets(long: DataFrame, taken: DataFrame, keys: Sequence[str] = ("world_id", "entity")) -> DataFrame:
    """One attribute to change per entity with >= 2 attributes that is not taken yet.

    int, float and enum attributes are preferred; any other attribute is the fallback.
    """
    keys = list(keys)
    simple = F.col("dtype").isin(*NUMERIC, "enum")
    per = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_attrs"),
        F.min(F.struct((~simple).alias("last"), F.col("attr"), F.col("dtype"))).alias("pick"),
    )
    return per.where(F.col("n_attrs") >= 2).join(taken.select(*keys).distinct(), keys, "left_anti").select(
        *keys, "n_attrs", F.col("pick.attr").alias("attr"), F.col("pick.dtype").alias("dtype")
    )


def pick_targets(eligible: DataFrame, by: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` of the eligible entities per world in hash order."""
    return top_k(eligible, by, [hash_order(seed, "entity"), F.col("entity")], n, "__rn").drop("__rn")


def _unit(salt: int, purpose: str, *parts: Column) -> Column:
    text = F.concat_ws(":", F.lit(f"{salt}:{purpose}"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def unit_interval(salt: int, purpose: str, *cols: str) -> Column:
    """Repeatable uniform number in [0, 1) per row and purpose.

    The first 52 bits of the md5 of ``salt:purpose:value:...`` (null as empty), so that any engine can draw it again.
    """
    return _unit(salt, purpose, *[F.col(c) for c in cols])


def _sign(salt: int, *parts: Column) -> Column:
    return F.when(_unit(salt, "sign", *parts) < 0.5, -1.0).otherwise(1.0)


def salted_perturb(long: DataFrame, attr_def: DataFrame, salt: int, keys: Sequence[str] = ("world_id", "entity")) -> DataFrame:
    """Shift every value so that memorised answers stop working, the same way on every run.

    Numbers move 5-15 % of the declared range and stay inside it; an int that rounds back to itself
    moves by one. Enums rotate to another choice. Dates are drawn anew within the declared years.
    """
    keys = list(keys)
    id_cols = [*keys, "attr"]
    sign = _sign(salt, *[F.col(k) for k in id_cols])
    d = long.drop("dtype").join(
        attr_def.select("attr", "dtype", "min_val", "max_val", "choices"), "attr"
    )
    lo, hi, v, c = F.col("min_val"), F.col("max_val"), F.col("num"), F.col("choices")
    u = unit_interval(salt, "size", *id_cols)
    moved = F.greatest(lo, F.least(hi, v + sign * (0.05 + 0.10 * u) * (hi - lo)))
    whole = F.rint(moved)
    number = F.when(
        F.col("dtype") == "int", F.when(whole == v, v + F.when(v < hi, 1.0).otherwise(-1.0)).otherwise(whole)
    ).otherwise(F.round(moved, 2))
    n = F.size(c)
    at = F.greatest(F.array_position(c, F.col("str")) - 1, F.lit(0))
    step = 1 + F.floor(unit_interval(salt, "step", *id_cols) * (n - 1))
    enum = F.when(n >= 2, F.try_element_at(c, (F.pmod(at + step, n) + 1).cast("int"))).otherwise(F.col("str"))
    year = (lo + F.floor(unit_interval(salt, "year", *id_cols) * (hi - lo + 1))).cast("int")
    month = (1 + F.floor(unit_interval(salt, "month", *id_cols) * 12)).cast("int")
    day = (1 + F.floor(unit_interval(salt, "day", *id_cols) * 28)).cast("int")
    dtype = F.col("dtype")
    return d.select(
        *long.columns,
        F.when(dtype.isin(*NUMERIC) & v.isNotNull(), number).alias("new_num"),
        F.when(dtype == "enum", enum).otherwise(F.col("str")).alias("new_str"),
        F.when(dtype == "date", F.make_date(year, month, day)).alias("new_dt"),
    )


def perturb_series(df: DataFrame, series: str, lo: float, hi: float, salt: int, keys: Sequence[str]) -> DataFrame:
    """Element-wise shift of an ARRAY<DOUBLE> by 5-15 % of the range, clipped and rounded to cents.

    Each point is drawn by its position and the keys. A null point stays null.
    """

    def move(x: Column, i: Column) -> Column:
        at = [i, *[F.col(k) for k in keys]]
        step = _sign(salt, *at) * (0.05 + 0.10 * _unit(salt, "size", *at)) * (hi - lo)
        return F.when(x.isNotNull(), F.round(F.greatest(F.lit(lo), F.least(F.lit(hi), x + step)), 2))

    return df.withColumn(f"new_{series}", F.transform(series, move))


def correction_perturb(long: DataFrame, attr_def: DataFrame, salt: int, keys: Sequence[str] = ("world_id", "entity")) -> DataFrame:
    """New values for corrections: numbers move 10-50 % of themselves, enums switch, dates move 30-365 days."""
    keys = list(keys)
    id_cols = [*keys, "attr"]
    sign = _sign(salt, *[F.col(k) for k in id_cols])
    d = long.drop("dtype").join(attr_def.select("attr", "dtype", "min_val", "max_val", "choices"), "attr")
    lo, hi, v, c = F.col("min_val"), F.col("max_val"), F.col("num"), F.col("choices")
    share = 0.1 + 0.4 * unit_interval(salt, "share", *id_cols)
    as_int = F.greatest(lo, F.least(hi, v + sign * F.greatest(F.lit(1.0), F.floor(F.abs(v) * share))))
    as_float = F.greatest(lo, F.least(hi, F.round(v + v * share * sign, 2)))
    number = F.when(
        F.col("dtype") == "int", F.when(as_int == v, v + F.when(v < hi, 1.0).otherwise(-1.0)).otherwise(as_int)
    ).otherwise(F.when(as_float == v, F.round(v + 0.1, 2)).otherwise(as_float))
    others = F.filter(c, lambda x: x != F.col("str"))
    pick = F.try_element_at(others, (1 + F.floor(unit_interval(salt, "pick", *id_cols) * F.size(others))).cast("int"))
    days = (30 + F.floor(unit_interval(salt, "days", *id_cols) * 336)).cast("int") * sign.cast("int")
    moved = F.date_add("dt", days)
    year = F.greatest(lo, F.least(hi, F.year(moved))).cast("int")
    clamped = F.add_months(moved, (year - F.year(moved)) * 12)
    dtype = F.col("dtype")
    return d.select(
        *long.columns,
        F.when(dtype.isin(*NUMERIC) & v.isNotNull(), number).alias("new_num"),
        F.when(dtype == "enum", F.coalesce(pick, F.col("str"))).otherwise(F.col("str")).alias("new_str"),
        F.when(dtype == "date", clamped).alias("new_dt"),
    )


def perturb_last_point(df: DataFrame, series: str, lo: float, hi: float, salt: int, keys: Sequence[str]) -> DataFrame:
    """Correct only the last point of a series by 10-50 % of itself; a last point that is null stays null."""
    u = unit_interval(salt, "last", *keys)
    sign = _sign(salt, *[F.col(k) for k in keys])
    last = F.try_element_at(F.col(series), F.lit(-1))
    moved = F.round(last + last * (0.1 + 0.4 * u) * sign, 2)
    new = F.when(last.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), moved)))
    n = F.size(series)
    return df.withColumn(
        f"new_{series}", F.transform(series, lambda x, i: F.when(i == n - 1, new).otherwise(x))
    )


def explode_calls(turns: DataFrame, keys: Sequence[str], calls: str = "tool_calls", results: str = "tool_results") -> DataFrame:
    """One row per logged call with its result; a missing result is null.

    ``tool_calls`` is array<struct<name, arguments: map<string,string>>>, ``tool_results`` array<string>.
    """
    zipped = F.arrays_zip(
        F.coalesce(F.col(calls), F.array()).alias("call"), F.coalesce(F.col(results), F.array()).alias("result")
    )
    return turns.select(*keys, F.posexplode(zipped).alias("call_idx", "z")).select(
        *keys, "call_idx", F.col("z.call.name").alias("tool"), F.col("z.call.arguments").alias("arguments"),
        F.col("z.result").alias("result"),
    )


def correction_applied(corrections: DataFrame, calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Did a successful write or edit carry the new value?

    ``corrections``: keys, entity, new_val (text). ``calls``: keys, tool, arguments, result. The strict rule
    also wants a memory replace whose old text names the entity and whose result says ok.
    """
    keys = list(keys)
    args, tool = F.col("arguments"), F.col("tool")
    arg = lambda n: F.coalesce(F.try_element_at(args, F.lit(n)), F.lit(""))
    result = F.coalesce(F.col("result"), F.lit(""))
    j = corrections.join(calls, keys, "left")
    stored = tool.isin("Write", "memory_store") & ~F.contains(result, F.lit("Budget exhausted"))
    edited = (tool == "Edit") & F.contains(result, F.lit("Edited."))
    new = F.col("new_val")
    hit = (stored & F.contains(arg("content"), new)) | (edited & F.contains(arg("new_text"), new))
    ok = result.rlike(r'"ok"\s*:\s*true')
    strict = (
        (tool == "memory") & (arg("action") == "replace") & F.contains(arg("old_text"), F.col("entity"))
        & F.contains(arg("content"), new) & ok
    )
    flag = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    return j.groupBy(*keys).agg(
        flag(hit).alias("applied"), flag(strict).alias("applied_strict"),
        flag(tool == "memory_search").alias("did_search"), flag(tool == "Edit").alias("did_edit"),
        flag(edited).alias("edit_ok"),
    )


def correction_diagnostics(flags: DataFrame, by: Sequence[str]) -> DataFrame:
    """total / applied / with_search / with_edit / edit_success / edit_fail per run."""
    return flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("applied").alias("applied"),
        F.count_if("did_search").alias("with_search"),
        F.count_if("did_edit").alias("with_edit"),
        F.count_if(F.col("did_edit") & F.col("edit_ok")).alias("edit_success"),
        F.count_if(F.col("did_edit") & ~F.col("edit_ok")).alias("edit_fail"),
    )
