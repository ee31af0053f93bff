import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from engramlake.operators import changes as E
from engramlake.operators import entity as B

ATTRS = "attr string, dtype string, min_val double, max_val double, unit string, label string, agg_ops array<string>, choices array<string>, position int"


@pytest.fixture(scope="module")
def attr_def(spark):
    return spark.createDataFrame(
        [
            ("n", "int", 0.0, 100.0, "", "count", ["total"], [], 1), ("x", "float", -50.0, 50.0, "%", "share", ["average"], [], 2),
            ("c", "enum", None, None, "", "kind", [], ["p", "q", "r"], 3), ("d", "date", 2000.0, 2010.0, "", "since", [], [], 4),
        ],
        ATTRS,
    )


@pytest.fixture(scope="module")
def long(spark):
    rows = []
    for i in range(200):
        e = f"e{i}"
        rows += [
            (1, e, "n", "int", float(i % 101), None, None), (1, e, "x", "float", round(i / 7 - 14, 2), None, None),
            (1, e, "c", "enum", None, "pqr"[i % 3], None), (1, e, "d", "date", None, None, dt.date(2000 + i % 11, 1 + i % 12, 1 + i % 28)),
        ]
    return spark.createDataFrame(rows, "world_id int, entity string, attr string, dtype string, num double, str string, dt date")


@pytest.mark.parametrize("fn", [E.salted_perturb, E.correction_perturb])
def test_perturbation_stays_in_range_changes_and_repeats(long, attr_def, fn):
    first = {(r.entity, r.attr): r for r in fn(long, attr_def, 3).collect()}
    again = {(r.entity, r.attr): r for r in fn(long.repartition(7), attr_def, 3).collect()}
    other = {(r.entity, r.attr): r for r in fn(long, attr_def, 4).collect()}
    assert first == again
    assert first != other
    for r in first.values():
        if r.attr == "n":
            assert 0 <= r.new_num <= 100 and r.new_num == int(r.new_num) and r.new_num != r.num
        elif r.attr == "x":
            assert -50 <= r.new_num <= 50
        elif r.attr == "c":
            assert r.new_str in "pqr" and r.new_str != r.str
        else:
            assert 2000 <= r.new_dt.year <= 2010


def test_salted_numbers_move_five_to_fifteen_percent(long, attr_def):
    for r in E.salted_perturb(long, attr_def, 1).where("attr = 'x'").collect():
        step = abs(r.new_num - r.num)
        assert step <= 15.01 and (step >= 4.99 or abs(r.new_num) == 50)


def test_series_perturbation(spark):
    d = spark.createDataFrame([(i, [1.0 * i, 50.0, 100.0]) for i in range(50)], "id int, series array<double>")
    for r in E.perturb_series(d, "series", 0.0, 100.0, 1, ["id"]).collect():
        assert len(r.new_series) == 3 and all(0 <= v <= 100 for v in r.new_series) and 4.99 <= abs(r.new_series[1] - 50) <= 15.01
    for r in E.perturb_last_point(d, "series", 0.0, 1000.0, 1, ["id"]).collect():
        assert r.new_series[:2] == r.series[:2] and 9.99 <= abs(r.new_series[2] - 100) <= 50.01


def test_states(spark):
    base = spark.createDataFrame([(1, "a", "x", 1.0), (1, "b", "x", 2.0)], "world_id int, entity string, attr string, new_val double")
    ch = spark.createDataFrame(
        [(1, "a", "x", 5, 1.0, 3.0), (1, "a", "x", 9, 3.0, 4.0)], "world_id int, entity string, attr string, seq int, old_val double, new_val double"
    )
    cur = {r.entity: (r.value, r.n_changes) for r in E.current_state(base, ch).collect()}
    assert cur == {"a": (4.0, 2), "b": (2.0, 0)}
    assert {r.entity: r.value for r in E.original_state(base, ch).collect()} == {"a": 1.0, "b": 2.0}
    docs = spark.createDataFrame([(1, "a", "x", s) for s in (4, 5, 8, 9, 10)], "world_id int, entity string, attr string, seq int")
    for chunk in (1, 3, 1000):
        got = {r.seq: r.value for r in E.state_as_of(docs, ch, chunk_rows=chunk).collect()}
        assert got == {4: None, 5: 3.0, 8: 3.0, 9: 4.0, 10: 4.0}


def test_contradictions_have_no_notice(spark):
    ch = spark.createDataFrame(
        [(1, "a", "x", 1, "ingest", 1.0), (1, "a", "x", 2, "correction", 2.0), (1, "a", "x", 3, "ingest", 2.0), (1, "a", "x", 4, "ingest", 5.0)],
        "world_id int, entity string, attr string, seq int, kind string, new_val double",
    )
    assert [r.seq for r in E.detect_contradictions(ch, chunk_rows=2).collect()] == [4]


def test_correction_rules(spark):
    calls = [
        (1, 0, "Write", {"content": "A | 7"}, "Budget exhausted (3/3)."), (2, 0, "Write", {"content": "A | 7"}, "Written."),
        (3, 0, "Edit", {"new_text": "7"}, "Text not found in memory."), (4, 0, "Edit", {"new_text": "7"}, "Edited. 2 left."),
        (5, 0, "memory", {"action": "replace", "old_text": "A", "content": "7"}, '{"ok": true}'),
        (6, 0, "memory", {"action": "replace", "old_text": "A", "content": "7"}, None),
    ]
    c = spark.createDataFrame(calls, "run int, call_idx int, tool string, arguments map<string,string>, result string")
    fix = spark.createDataFrame([(i, "A", "7") for i in range(1, 8)], "run int, entity string, new_val string")
    got = {r.run: (r.applied, r.applied_strict) for r in E.correction_applied(fix, c, ["run"]).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, False), 4: (True, False), 5: (False, True), 6: (False, False), 7: (False, False)}
    diag = E.correction_diagnostics(E.correction_applied(fix, c, ["run"]), []).first()
    assert (diag.total, diag.applied, diag.with_edit, diag.edit_success, diag.edit_fail) == (7, 2, 2, 1, 1)


def test_short_results_leave_null(spark):
    t = spark.sql("SELECT 1 AS run, array(named_struct('name', 'a', 'arguments', map('k', 'v')), named_struct('name', 'b', 'arguments', map('k', 'w'))) AS tool_calls, array('r') AS tool_results")
    assert [(r.tool, r.result) for r in E.explode_calls(t, ["run"]).orderBy("call_idx").collect()] == [("a", "r"), ("b", None)]


def test_extremes_use_count_at_or_below(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 9.0]
    rows = [(1, f"e{i}", "c", "x", "float", v, None, None) for i, v in enumerate(vals)]
    long = spark.createDataFrame(rows, "world_id int, entity string, category string, attr string, dtype string, num double, str string, dt date")
    got = {r.entity: r.n_extreme for r in B.extreme_count(long, ["world_id"]).collect()}
    pct = [sum(w <= v for w in vals) / 5 for v in vals]
    assert got == {f"e{i}": int(p <= 0.2 or p >= 0.8) for i, p in enumerate(pct)}


def test_forced_rows_push_out_the_lowest(spark):
    d = spark.createDataFrame([(1, i, float(i), i in (0, 1)) for i in range(10)], "w int, id int, score double, forced boolean")
    kept = B.select_budgeted(d, ["w"], "score", "id", budget=4, forced="forced")
    assert sorted(r.id for r in kept.collect()) == [0, 1, 8, 9]
    over = B.select_budgeted(d.withColumn("forced", F.col("id") < 6), ["w"], "score", "id", budget=4, forced="forced")
    assert sorted(r.id for r in over.collect()) == [0, 1, 2, 3, 4, 5]


def test_weighted_choice_across_chunks(spark):
    w = spark.createDataFrame([(1, i, f"e{i}", i + 1) for i in range(20)], "k int, seq int, item string, w int")
    draws = spark.createDataFrame([(1, j, j / 10) for j in range(11)], "k int, draw_id int, r double")
    cum, total = [], 0
    for i in range(20):
        total += i + 1
        cum.append(total)
    want = {j: next(f"e{i}" for i, c in enumerate(cum) if c >= j / 10 * total) for j in range(11)}
    for chunk in (1, 6, 1000):
        got = B.weighted_choice(w, draws, ["k"], "w", "seq", "item", chunk_rows=chunk).collect()
        assert {r.draw_id: r.chosen for r in got} == want


@pytest.mark.parametrize("buckets", [None, 1, 3, 50])
def test_weighted_choice_beside_plain_loop(spark, buckets):
    rng = random.Random(3)
    items = [(k, i, f"{k}{i}", rng.choice([0, 0, 1, 2, 9]), rng.random() < 0.3) for k, n in (("hot", 120), ("a", 5), ("b", 1)) for i in range(n)]
    items += [("zero", i, f"zero{i}", 0, False) for i in range(4)] + [("none", 0, None, None, None)]
    draws = [(k, j, r) for k in ("hot", "a", "b", "zero", "none", "absent") for j, r in enumerate([0.0, 0.1, 0.1, 0.25, 0.5, 0.77, 1.0, None])]
    w = spark.createDataFrame(items, "k string, seq int, item string, w int, fresh boolean")
    d = spark.createDataFrame(draws, "k string, draw_id int, r double")
    for fresh in (None, "fresh"):
        want = {}
        for k, j, r in draws:
            pool = [x for x in items if x[0] == k]
            pool = ([x for x in pool if x[4]] if fresh else []) or pool
            if r is None or not pool:
                continue
            weights = [x[3] or 0 for x in pool] if any(x[3] for x in pool) else [1] * len(pool)
            reach = list(itertools.accumulate(weights))
            want[(k, j)] = next(x[2] for x, c in zip(pool, reach) if c >= r * reach[-1])
        got = B.weighted_choice(w, d, ["k"], "w", "seq", "item", fresh=fresh, chunk_rows=7, buckets=buckets).collect()
        assert len(got) == len(want) and {(x.k, x.draw_id): x.chosen for x in got} == want


def test_sampling_is_repeatable(spark):
    d = spark.range(1000).withColumn("g", F.col("id") % 3)
    one = {tuple(r) for r in B.sample_k_per_group(d, ["g"], 7, ["id"]).collect()}
    two = {tuple(r) for r in B.sample_k_per_group(d.repartition(9), ["g"], 7, ["id"]).collect()}
    assert one == two and len(one) == 21
