"""Matching rules on the cases the grading rules are defined by."""

import pytest
from pyspark.sql import functions as F

from engramlake.functions import answers as A
from engramlake.operators import grading as G

NUMERIC = [
    ("150,000", "150000", True), ("150001", "150000", False), ("25500", "25000.5", True), ("26000", "25000.5", False),
    ("43", "42.5", True), ("$498,985.9M", "498985.9", True), ("1.5K", "1500", True), ("1500", "1500", True), ("2M", "2000000", True),
    ("no idea", "5", False), ("0.0", "0.0", True), ("0.1", "0.0", False), ("-3", "-3", True), ("about 34,620 million", "$34,620.4M", True),
    ("1999", "2000", False), (".5", "0.5", True), ("7", "1e1", False), ("10", "1e1", True),
]
ENTITY = [
    ("Dr. Jane Smith", "Jane Smith", True), ("jane smith (PhD)", "Prof. Jane Smith", True), ("Jane", "Jane Marie Smith", False),
    ("Acme Corp", "Acme Corp", True), ("Acme", "Acme Global Holdings", False), ("big Acme Global firm", "Acme Global Holdings", False),
    ("Acme Global Holdings Inc", "Acme Global Holdings", True), ("x", "!!!", False), ("!!!", "!!!", True),
]
NAME_VALUE = [
    ("Acme Corp (120)", "Acme Corp (120)", True), ("Acme Corp with 120", "Acme Corp (120)", True), ("Acme Corp with 121", "Acme Corp (120)", False),
    ("Zeta (120)", "Acme Corp (120)", False), ("Acme Corp", "Acme Corp", True),
]
ABSTAIN = [
    ("I don't know", True), ("Unknown, but I guess 50", False), ("42", False), ("There is no record of it", True), ("N/A", True), ("sure thing", False),
]


def check(spark, rows, schema, rule):
    got = spark.createDataFrame(rows, schema + ", want boolean").withColumn("got", rule).collect()
    assert [r for r in got if r.got != r.want] == []


def test_numeric(spark):
    check(spark, NUMERIC, "a string, t string", A.numeric_match(F.trim("a"), F.col("t")))


def test_entity(spark):
    check(spark, ENTITY, "a string, t string", A.entity_match(F.col("a"), F.col("t")))


def test_name_value(spark):
    check(spark, NAME_VALUE, "a string, t string", A.name_value_match(F.col("a"), F.col("t")))


def test_abstention(spark):
    check(spark, ABSTAIN, "a string", A.abstention_match(F.col("a")))


@pytest.mark.parametrize(
    "answer,truth,competency,correct,reason",
    [
        ("12", "12", "retrieval", True, "rule:pass"),
        ("ABSTAIN", "ABSTAIN", "abstention", True, "rule:abstention"),
        ("", "ABSTAIN", "abstention", False, "rule:abstention"),
        ("  ", "12", "retrieval", False, "rule:empty_answer"),
        (None, "12", "retrieval", False, "rule:empty_answer"),
        ("it is strongly rising", "strongly rising", "temporal_trend", True, "rule:pass"),
        ("flat", "strongly rising", "temporal_trend", False, "rule:fail"),
        ("12 widgets", "12", "unheard_of", False, "rule:fail"),
        ("HIGH", "high", "unheard_of", True, "rule:pass"),
    ],
)
def test_dispatch(spark, answer, truth, competency, correct, reason):
    df = spark.createDataFrame([(answer, truth, competency)], "answer string, truth string, competency string")
    r = G.grade_answers(df).first()
    assert (r.correct, r.reason) == (correct, reason)


def test_last_verdict_wins_and_silence_fails(spark):
    rows = [
        (1, "rule:fail", False, "VERDICT_CORRECT ... VERDICT_INCORRECT no"), (2, "rule:fail", False, "verdict_correct"),
        (3, "rule:fail", False, "cannot say"), (4, "rule:fail", False, None), (5, "rule:abstention", False, "VERDICT_CORRECT"),
        (6, "rule:pass", True, "VERDICT_INCORRECT"),
    ]
    d = spark.createDataFrame(rows, "id int, reason string, correct boolean, reply string")
    out = G.apply_judge_verdicts(d.drop("reply"), d.select("id", "reply"), ["id"])
    assert {r.id: (r.correct, r.reason) for r in out.collect()} == {
        1: (False, "judge:incorrect"), 2: (True, "judge:correct"), 3: (False, "judge:no_verdict"), 4: (False, "judge:no_reply"),
        5: (False, "rule:abstention"), 6: (True, "rule:pass"),
    }


def test_single_turn_score(spark):
    rows = [(0.4, "x", "y", 0.4), (None, " Yes", "yes", 1.0), (None, "101", "100", 1.0), (None, "50%", "0.5", 0.0), (None, "", "1", 0.0), (None, "0", "0.0", 1.0)]
    d = spark.createDataFrame(rows, "reward double, answer string, truth string, want double")
    assert all(r.score == r.want for r in G.single_turn_score(d).collect())


def test_judge_does_not_repeat_the_grading(spark):
    rows = [("Ann (3)", "Bob (3)", "synthesis"), ("3", "3", "retrieval"), ("4K", "5", "retrieval"), (None, "5", "update")]
    graded = G.grade_answers(spark.createDataFrame(rows, "answer string, truth string, competency string").withColumn("question", F.lit("q")))
    judged = G.judge_pending(graded, lambda *c: F.struct(F.lit(True).alias("correct"), F.lit("yes").alias("reason")))
    conditions = [x for x in judged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert conditions and not any("regexp" in x for x in conditions)
    assert sorted(r.reason for r in judged.collect()) == ["judge:yes", "judge:yes", "rule:empty_answer", "rule:pass"]
