"""Both sides of limits that must not change results."""

from pyspark.sql import functions as F

from engramlake.functions.answers import strip
from engramlake.operators import convo, grading, memory


def test_white_space_is_stripped_everywhere(spark):
    rows = [("Technology\n", "Technology", "retrieval"), ("\t\u2003Technology \r\n", "technology", "update"), ("\n", "x", "retrieval"), ("not found \u0663", "ABSTAIN", "abstention")]
    got = grading.grade_answers(spark.createDataFrame(rows, "answer string, truth string, competency string")).collect()
    assert [(r.correct, r.reason) for r in got] == [(True, "rule:pass"), (True, "rule:pass"), (False, "rule:empty_answer"), (False, "rule:abstention")]
    texts = spark.createDataFrame([("\nhi\n",), ("<think>x</think>\n\thi\u3000",)], "text string")
    assert {r.text for r in convo.clean_messages(texts).collect()} == {"hi"}
    assert spark.range(1).select(strip(F.lit("\x1f a\u00a0b \x85")).alias("s")).first().s == "a\u00a0b"


def test_one_length_rule_for_vectors(spark):
    d = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0, 2.0], [3.0, 4.0, 5.0]), ([1.0, None], [3.0, 4.0])], "a array<double>, b array<double>")
    got = {n: [r.v for r in d.select(memory.dot("a", "b", n).alias("v")).collect()] for n in (2, 3, 129)}
    assert got == {2: [11.0, None, None], 3: [None] * 3, 129: [None] * 3}


def test_entries_without_a_vector_are_found_by_words(spark):
    q = spark.createDataFrame([(1, 7, "alpha", [1.0, 0.0])], "agent_id int, query_id int, text string, qvec array<double>")
    e = spark.createDataFrame([(1, 1, 1, "beta", [1.0, 0.0]), (1, 2, 2, "alpha alpha", None)], "agent_id int, entry_id int, seq int, content string, embedding array<double>")
    got = {r.entry_id: (r.rank_vec, r.rank_bm25) for r in memory.fused_ranks(q, e, 2).collect()}
    assert got == {1: (1, 2), 2: (None, 1)}


def test_many_turns_in_an_event(spark):
    turn = lambda i: {"role": "assistant", "content": f"t{i}", "tool_calls": [{"name": "Write", "arguments": "{}"}], "tool_results": ["ok"]}
    rows = [("c", e, "ingest", None, [turn(i) for i in range(n)]) for e, n in ((0, 4100), (1, 2))]
    out = convo.trajectory_to_messages(spark.createDataFrame(rows, convo.TRAJECTORY_SCHEMA))
    calls = {(r.event_idx, r.turn_idx): r.tool_call_id for r in out.where("role = 'assistant'").collect()}
    assert calls == {(e, i): f"call_{e * 4100 + i}" for e, n in ((0, 4100), (1, 2)) for i in range(n)}
