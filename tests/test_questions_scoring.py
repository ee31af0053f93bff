import math
import random

import pytest
from pyspark.sql import functions as F

from engramlake.operators import events as K
from engramlake.operators import questions as C
from engramlake.operators import rewards as J
from engramlake.operators import scoring as H


@pytest.mark.parametrize(
    "series,label",
    [([1.0, 2.0, 3.0], "strongly rising"), ([100.0, 105.0, 110.0], "slightly rising"), ([5.0, 5.0, 5.0], "flat"), ([110.0, 105.0, 100.0], "slightly falling"),
     ([9.0, 5.0, 1.0], "strongly falling"), ([-1.0, 0.0, 1.0], "flat"), ([-3.0, -2.0, -1.0], "strongly rising")],
)
def test_trend(spark, series, label):
    d = spark.createDataFrame([(1, series)], "id int, series array<double>")
    assert C.q_temporal_trend(d, ["id"]).first().answer == label


def test_short_series_and_first_extreme(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0, 3.0, 1.0])], "id int, series array<double>")
    assert [(r.id, r.highest_period, r.lowest_period) for r in C.q_temporal_extreme(d, ["id"]).collect()] == [(2, 1, 2)]


def test_conditional_takes_the_larger_name_on_ties(spark):
    rows = [(1, n, "c", "a", v1, "b", v2) for n, v1, v2 in [("p", 1.0, 9.0), ("q", 2.0, 9.0), ("r", 3.0, 5.0), ("s", 4.0, 7.0), ("t", 5.0, 7.0)]]
    d = spark.createDataFrame(rows, "world_id int, entity string, category string, attr1 string, v1 double, attr2 string, v2 double")
    r = C.q_conditional(d).first()
    assert (r.threshold, r.n_above, r.answer, r.answer_value) == (3.0, 2, "t", 7.0)


def test_text_match_is_unique_as_a_substring(spark):
    docs = [
        (1, "a", "The quick marmalade jumped over everything."), (1, "b", "Marmalades are everywhere, quickly jumped over"),
        (1, "c", "nothing shared in this sentence, truly unusual"),
    ]
    d = spark.createDataFrame(docs, "world_id int, entity string, text string")
    got = {(r.phrase, r.answer) for r in C.q_text_match(d, ["world_id"], "entity", "text").collect()}
    low = {e: t.lower() for _, e, t in docs}
    for phrase, answer in got:
        assert [e for e, t in low.items() if phrase in t] == [answer]
    assert "marmalade" not in {p for p, _ in got} and "quick marmalade" in {p for p, _ in got}


@pytest.mark.parametrize("n,corr,contra,want", [
    (20, 5, 0, dict(n_trick=2, n_update=4, n_delta=1, n_retrieval=6, n_abstention=3, n_contradiction=0, n_comprehension=4)),
    (10, 3, 1, dict(n_trick=1, n_update=1, n_delta=1, n_retrieval=3, n_abstention=2, n_contradiction=1, n_comprehension=1)),
    (20, 0, 0, dict(n_trick=2, n_update=0, n_delta=0, n_retrieval=8, n_abstention=2, n_contradiction=0, n_comprehension=8)),
])
def test_quota(spark, n, corr, contra, want):
    d = spark.createDataFrame([(n, corr, contra, 0.4, 0.2, 0.15)], "n_questions bigint, n_corrections bigint, n_contradictions bigint, w_retrieval double, w_update double, w_abstention double")
    r = C.question_quota(d).first().asDict()
    assert {k: r[k] for k in want} == want


def test_slots_fall_back_in_order(spark):
    pool = spark.createDataFrame([(1, "ratio", "x"), (1, "ratio", "y"), (1, "multi_hop", "z")], "w int, competency string, candidate_id string")
    slots = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 0)], "w int, slot bigint")
    rows = C.assign_questions(slots, pool, ["w"]).collect()
    assert len(rows) == 4 and {r.competency for r in rows} == {"ratio"}
    assert sorted(r.candidate_id for r in rows) == ["x", "x", "y", "y"]


def test_axis_scores_and_composite(spark):
    rows = [("retrieval", True), ("retrieval", False), ("update", True), ("synthesis", True), ("ratio", False), ("abstention", True)]
    g = spark.createDataFrame([(1, c, ok) for c, ok in rows], "run int, competency string, correct boolean")
    runs = spark.createDataFrame([(1, 60, 15, 30)], "run int, n_entities int, stored_count int, write_budget int")
    r = H.composite(H.axis_scores(g, runs, ["run"])).first()
    assert (r.breadth, r.maintenance, r.reasoning, r.abstention_diagnostic) == (0.5, 0.5, 0.5, 1.0)
    assert r.efficiency == pytest.approx(0.1)
    assert r.composite == pytest.approx(0.3 * 0.5 + 0.25 * 0.5 + 0.25 * 0.5 + 0.2 * 0.1)
    empty = H.axis_scores(g.where("competency = 'abstention'"), runs.withColumn("write_budget", F.lit(0)), ["run"]).first()
    assert (empty.breadth, empty.maintenance, empty.reasoning, empty.efficiency) == (0.0, 0.0, 0.0, 0.0)


def test_weights_sum_to_one():
    assert math.isclose(sum(H.WEIGHTS.values()), 1.0)


def test_mean_stderr_single_row_is_zero(spark):
    d = spark.createDataFrame([(1, 0.2), (2, 0.2), (2, 0.6)], "g int, x double")
    got = {r.g: (r.x_mean, r.x_stderr) for r in H.mean_stderr(d, ["g"], ["x"]).collect()}
    assert got[1] == (0.2, 0.0) and got[2] == (pytest.approx(0.4), pytest.approx(0.2))


def test_tier_bounds(spark):
    d = spark.createDataFrame([(30,), (31,), (60,), (61,), (None,)], "n int").select(H.infer_tier(F.col("n")).alias("t"))
    assert [r.t for r in d.collect()] == ["lite", "standard", "standard", "hard", "lite"]


def test_error_classes(spark):
    rows = [("", "none"), (None, "none"), ("max_turns", "capability"), ("HTTP 503 from upstream", "infra_retryable"), ("disk full", "infra"), ("no wallclock remaining", "wallclock")]
    d = spark.createDataFrame(rows, "error string, want string")
    assert all(r.error_class == r.want for r in H.classify_errors(d).collect())


def test_failure_streaks(spark):
    seq = [True] * 8 + [False] + [True] * 3
    d = spark.createDataFrame([(1, i, f) for i, f in enumerate(seq)], "run int, seq int, failed boolean")
    for chunk in (1, 5, 1000):
        r = H.failure_streaks(d, ["run"], "seq", "failed", chunk_rows=chunk).first()
        assert (r.longest_streak, r.n_streaks, r.provider_down) == (8, 2, True)


def test_rewards(spark):
    e = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (2, 3, 0.5), (2, 4, 0.5)], "g int, id int, reward double")
    adv = {r.id: r.advantage for r in J.group_advantage(e, ["g"]).collect()}
    assert adv == {1: pytest.approx(-1, abs=1e-5), 2: pytest.approx(1, abs=1e-5)}
    w = spark.createDataFrame([(1, i, r) for i, r in enumerate([0.1, 0.1, 0.1, 0.9])], "g int, id int, reward double")
    weights = [r.weight for r in J.ips_weights(w, ["g"]).orderBy("id").collect()]
    raw = [4 / 3] * 3 + [4.0]
    assert weights == pytest.approx([x / (sum(raw) / 4) for x in raw])


def test_shaped_write_reward(spark):
    writes = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, True), (1, 4, False), (1, 5, True)], "run int, seq int, valid boolean")
    mentions = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 3, "c"), (1, 4, "d")], "run int, seq int, entity string")
    asked = spark.createDataFrame([(1, "c")], "run int, entity string")
    got = [r.reward for r in J.shaped_write_reward(writes, mentions, asked, ["run"]).orderBy("seq").collect()]
    assert got == pytest.approx([0.3, -0.1, 0.6, -0.05, 0.0])


def test_text_match_has_no_limit(spark):
    words = [f"{c}{'x' * 6}{d}" for c in "abcdefgh" for d in "pqrs"]
    d = spark.createDataFrame([(1, "a", " ".join(words)), (1, "b", " ".join(words[:16]) + " something else entirely")], "world_id int, entity string, text string")
    got = {r.phrase for r in C.q_text_match(d, ["world_id"], "entity", "text").where("answer = 'a'").collect()}
    assert set(words[16:]) <= got and not set(words[:16]) & got


def test_batches_keep_or_drop_the_tail(spark):
    d = spark.createDataFrame([(1, i) for i in range(25)] + [(2, i) for i in range(4)], "w int, seq int")
    for chunk in (3, 1000):
        rows = K.assign_batches(d, ["w"], "seq", 10, keep_tail=False, chunk_rows=chunk).collect()
        assert sorted((r.w, r.seq, r.batch) for r in rows) == [(1, i, i // 10) for i in range(20)] + [(2, i, 0) for i in range(4)]
        rows = K.assign_batches(d, ["w"], "seq", 10, chunk_rows=chunk).collect()
        assert sorted((r.w, r.seq, r.batch, r.n_batches) for r in rows) == [(1, i, i // 10, 3) for i in range(25)] + [(2, i, 0, 1) for i in range(4)]


def test_sessions(spark):
    d = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 0)], "run int, event_idx int")
    rows = K.split_sessions(d, ["run"], 3).collect()
    assert sorted((r.run, r.event_idx, r.session) for r in rows) == [(1, i, (i >= 3) + (i >= 6)) for i in range(10)] + [(2, 0, 0)]


def test_break_moves_so_that_a_correction_crosses_it(spark):
    rng = random.Random(11)
    streams, want = [], {}
    for run in range(60):
        n = rng.randint(1, 30)
        kinds = [(rng.choice(["ingest", "noise", "noise", "correction"]), rng.choice("abcdefgh")) for _ in range(n)]
        if run % 3 == 0:  # a first session that holds ingest and correction, nothing after it
            kinds = [("ingest", "z"), ("correction", "z")] + [("noise", "z")] * n
        streams += [(run, i, kind, who) for i, (kind, who) in enumerate(kinds)]
        n = len(kinds)
        breaks = [] if n < 4 else list(dict.fromkeys(max(1, int(b * (n / 4))) for b in (1, 2, 3)))
        start = {}
        for i, (kind, who) in enumerate(kinds):
            if kind == "ingest":
                start.setdefault(who, i)
        pairs = [(i, start[who]) for i, (kind, who) in enumerate(kinds) if kind == "correction" and who in start]
        if breaks and not any(min(p) < b <= max(p) for p in pairs for b in breaks):
            later = [(to, at) for to, at in pairs if at < to]
            if later:
                to, at = min(later)
                breaks = sorted({(to + at) // 2 + 1, *breaks[1:]})
        want.update({(run, i): sum(b <= i for b in breaks) for i in range(n)})
    d = spark.createDataFrame(streams, "run int, event_idx int, type string, who string").repartition(3)
    got = {(r.run, r.event_idx): r.session for r in K.split_sessions(d, ["run"], 4, entity="who").collect()}
    even = {(r.run, r.event_idx): r.session for r in K.split_sessions(d, ["run"], 4).collect()}
    assert got == want and even != want


def test_rules_on_what_was_not_run(spark):
    d = spark.createDataFrame([("t", 0.99, None), ("u", None, 0)], "template string, perfect double, tricks int")
    rules = {"high": "perfect > 0.9", "tricked": "tricks = 0"}
    got = {(r.template, r.check_name): r.passed for r in H.check_invariants(d, rules, ["template"], optional=["tricked"]).collect()}
    assert got == {("t", "high"): True, ("u", "high"): False, ("u", "tricked"): True}


def test_replaced_questions_are_computed_once(spark):
    pool = spark.createDataFrame([(1, "ratio", "a"), (1, "ratio", "b"), (1, "enum_filter", "c")], "world_id int, competency string, candidate_id string")
    asked = spark.createDataFrame([(1, i, c, False) for i, c in enumerate(["ratio", "outlier", "enum_filter", None])], "world_id int, question_id int, competency string, answerable boolean")
    counts = spark.createDataFrame([(1, 2)], "world_id int, n_stored int")
    out = C.replace_unanswerable(asked, pool, counts, ["world_id"])
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()  # the questions are read as written
    assert {r.question_id: r.competency for r in out.collect()} == {0: "ratio", 1: "ratio", 2: "enum_filter", 3: None}
