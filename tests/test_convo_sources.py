import json

import pytest

from engramlake.operators import convo as I
from engramlake.operators.domains import DOMAIN_RULES, Attribute, Domain, domain, domain_rules, register_domain
from engramlake.operators.entity import constraint_violations
from engramlake.sources import readers as A

TRAJECTORY = [
    {"conv_id": "c", "event_idx": 0, "type": "system", "content": "be good", "turns": []},
    {"conv_id": "c", "event_idx": 1, "type": "ingest", "content": "docs", "turns": [
        {"role": "assistant", "content": "ok", "tool_calls": [{"name": "Write", "arguments": "{}"}, {"name": "Read", "arguments": "{}"}], "tool_results": ["[tool] done", "file", "extra"]},
        {"role": "assistant", "content": "", "tool_calls": [], "tool_results": []},
    ]},
    {"conv_id": "c", "event_idx": 2, "type": "question", "content": "", "turns": [{"role": "assistant", "content": "", "tool_calls": [{"name": "submit_answer", "arguments": "{}"}], "tool_results": []}]},
]


def test_trajectory_files_to_messages(spark, tmp_path):
    (tmp_path / "run_trajectory.json").write_text(json.dumps(TRAJECTORY, indent=1))
    (tmp_path / "broken_trajectory.json").write_text("[{")
    events = A.read_trajectories(spark, str(tmp_path))
    for chunk in (1, 1_000_000):
        m = I.trajectory_to_messages(events, chunk_rows=chunk).orderBy("event_idx", "turn_idx", "part", "item").collect()
        assert [(r.role, r.content, r.tool_call_id, r.name) for r in m] == [
            ("system", "be good", None, None), ("user", "docs", None, None), ("assistant", "ok", "call_0,call_1", "Write,Read"),
            ("tool", "done", "call_0", "Write"), ("tool", "file", "call_1", "Read"), ("tool", "extra", None, None), ("assistant", "", "call_2", "submit_answer"),
        ]


@pytest.mark.parametrize("text,calls", [
    ('<tool_call>{"name": "Write", "arguments": {"a": 1}}</tool_call>', [("Write", '{"a":1}')]),
    ('<tool_call>{"name": "Write", "arguments": {"a": 1}</tool_call>', [("Write", '{"a":1}')]),
    ('<tool_call>{"name": "Write", "arguments": {"a": 1</tool_call>', [("Write", '{"a":1}')]),
    ('<tool_call>{"name": "Nope", "arguments": {}}</tool_call> ```json\n{"name": "Edit", "arguments": {}}\n```', [("Edit", "{}")]),
    ('text {"name": "Read", "arguments": {}} more {"name": "Edit", "arguments": {"x": "y"}}', [("Read", "{}"), ("Edit", '{"x":"y"}')]),
    ("no call", []),
])
def test_tool_calls(spark, text, calls):
    d = spark.createDataFrame([(1, text)], "id int, text string")
    assert [(r.tool, r.arguments) for r in I.extract_tool_calls(d, ["id"]).orderBy("call_idx").collect()] == calls


def test_clean(spark):
    d = spark.createDataFrame([("<|im_start|><think>a\nb</think>\n hi <think>c</think>there<|im_end|>",)], "text string")
    assert I.clean_messages(d).first().text == "hi there"


def test_merge_same_role(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    d = spark.createDataFrame(rows, "conv int, turn int, role string, text string")
    for chunk in (1, 2, 100):
        got = I.merge_same_role(d, "conv", "turn", chunk_rows=chunk).orderBy("message_idx").collect()
        assert [(r.role, r.text) for r in got] == [("user", "a\n\n---\n\nb"), ("assistant", "c"), ("user", "d")]


def test_spans_cut_the_rendered_text(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes sir"), (1, 2, "assistant", "no")]
    text = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in rows)
    d = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = I.assistant_spans(d, chunk_rows=2).orderBy("turn").collect()
    assert [text[r.start:r.end] for r in got] == ["yes sir<|im_end|>", "no<|im_end|>"]


def test_results_skip_what_is_not_a_result(spark, tmp_path):
    good = {"task_name": "t:x", "score": 0.5, "extra": {"model": "m", "template": "x", "seed": 3, "n_entities": 60, "per_axis": {"composite": 0.7}, "by_competency": {"update": 1.0}}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "a_trajectory.json").write_text(json.dumps([{"type": "ingest"}]))
    (tmp_path / "old.json").write_text(json.dumps({"score": 1}))
    (tmp_path / "failed.json").write_text(json.dumps({**good, "error": "x"}))
    (tmp_path / "broken.json").write_text('{"task_name": ')
    (tmp_path / "plain.json").write_text(json.dumps({**good, "extra": {"model": "m", "n_entities": 120}}))
    rows = {r.file_key: r for r in A.read_eval_results(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "plain"}
    assert (rows["a"].composite, rows["a"].tier, rows["a"].by_competency) == (0.7, "standard", {"update": 1.0})
    assert (rows["plain"].composite, rows["plain"].tier) == (0.5, "hard")
    linked = A.link_result_trajectory(A.read_eval_results(spark, str(tmp_path)), A.read_trajectories(spark, str(tmp_path), glob="*_trajectory.json"))
    assert {r.file_key: r.has_trajectory for r in linked.collect()} == {"a": True, "plain": False}


def test_trace(spark, tmp_path):
    lines = [
        '{"type": "tool.request", "data": {"tool": "memory", "args": {"action": "add"}}}', "", "not json",
        '{"type": "tool.result", "data": "{\\"result_summary\\": \\"short\\"}"}', '{"type": "message.done", "data": {"text": "<think>x</think> first"}}',
        '{"type": "message.done", "data": {"text": " last "}}', '{"type": "turn.end", "data": {"reason": "timeout"}}',
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    trace = A.read_agent_trace(spark, str(tmp_path))
    r = A.rollup_trace(trace, ["file_path"]).first()
    assert (r.n_tool_calls, r.n_writes, r.n_results, r.api_calls, r.final_text, r.error, r.stop_reason) == (1, 1, 1, 1, "last", "turn ended: timeout", "timeout")
    assert [x.result for x in A.trace_results(trace, ["file_path"]).collect()] == ["short"]


def test_memory_files(spark, tmp_path):
    (tmp_path / "My Topic.md").write_text("[2024-01-02T03:04:05Z]\nfirst\n§\nsecond\n§\n \n")
    (tmp_path / "core.md").write_text("one\n\ntwo\n  \nthree")
    rows = A.read_memory_snapshot(spark, str(tmp_path)).collect()
    assert sorted((r.topic, r.position, r.content) for r in rows) == [("core", 0, "one\n\ntwo\n  \nthree"), ("mytopic", 0, "first"), ("mytopic", 1, "second")]
    paras = A.read_memory_snapshot(spark, str(tmp_path), delimited=False, glob="core.md").collect()
    assert [r.content for r in sorted(paras, key=lambda r: r.position)] == ["one", "two", "three"]


def test_log_lines(spark):
    lines = [
        "{'loss': '0.5', 'grad_norm': '1.2', 'learning_rate': '1e-05', 'epoch': '0.3'}", "[1/10] G0S2 movie(s=14592): r=0.120 (x) correct=1/10 writes=10 msgs=25",
        "  Step 1: loss=-0.2815 mean_r=0.388", "Loading",
    ]
    rows = {r.kind: r for r in A.parse_training_logs(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert len(rows) == 3
    assert (rows["metric"].loss, rows["metric"].learning_rate) == (0.5, 1e-05)
    assert (rows["episode"].template, rows["episode"].seed, rows["episode"].reward, rows["episode"].messages) == ("movie", 14592, 0.12, 25)
    assert (rows["step"].step, rows["step"].loss, rows["step"].mean_reward) == (1, -0.2815, 0.388)


def test_chat_dataset_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "c")], "conv_id int, turn int, role string, text string")
    rec = A.chat_records(m, ["conv_id"]).selectExpr("*", "'x' AS template")
    A.write_chat_dataset(rec, str(tmp_path / "out"))
    back = A.read_chat_dataset(spark, str(tmp_path / "out"))
    assert sorted([(x.role, x.content) for x in r.messages] for r in back.collect()) == [[("user", "a"), ("assistant", "b")], [("user", "c")]]
    s = A.dataset_stats(back).first()
    assert (s.template, s.trajectories, s.total_messages) == ("x", 2, 3)


def test_domains(spark):
    d = register_domain(Domain("zoo", [Attribute("cages", "int", 1, 9), Attribute("visitors", "float", 0, 1)], [("visitors", "cages", "crowding")]))
    assert domain("zoo") is d
    assert [r.label for r in d.attr_def(spark).collect()] == ["cages", "visitors"]
    with pytest.raises(ValueError):
        register_domain(d)
    with pytest.raises(ValueError):
        Domain("bad", [Attribute("a", "int")], [("a", "b", "x")])
    with pytest.raises(ValueError):
        Attribute("a", "decimal")


def test_domain_rules(spark):
    for name, rules in DOMAIN_RULES.items():
        attrs = sorted({a for _, needed, _ in rules for a in needed})
        empty = spark.createDataFrame([], ", ".join(f"{a} {'string' if a == 'status' else 'double'}" for a in attrs))
        assert constraint_violations(empty, domain_rules(name, attrs), []).count() == 0
    h = spark.createDataFrame([(10.0, 20.0, 4.0), (30.0, 20.0, 100.0), (None, 20.0, 10.0)], "icu_beds double, beds double, staff_count double")
    got = constraint_violations(h, domain_rules("hospital", h.columns), [])
    assert {r.rule: r.n_violations for r in got.collect()} == {"icu_within_beds": 1, "staff_per_bed": 1}
    assert domain_rules("hospital", ["beds"]) == {}


def test_many_traces_in_one_file(spark, tmp_path):
    lines = ['7\t{"type": "usage"}', '8\t{"type": "message.done", "data": {"text": "a"}}', '\t{"type": "usage"}', '8\t{"type": "message.done", "data": {"text": "b\\tc"}}', "9\tnot json"]
    (tmp_path / "all.txt").write_text("\n".join(lines))
    trace = A.read_agent_trace(spark, str(tmp_path), ["trace"], sep="\t")
    got = {r.trace: (r.api_calls, r.final_text) for r in A.rollup_trace(trace, ["trace"]).collect()}
    assert got == {"7": (1, ""), "8": (1, "b\tc"), None: (1, "")}


def test_trace_files_do_not_grow_with_users(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from engramlake.plans import sources_domains
    from engramlake.plans.catalog import QUERIES

    monkeypatch.setattr(sources_domains, "shared_dir", lambda *_: str(tmp_path / "out"))
    rows = [(i, datetime(2024, 1, 1), i % 40, "click", 1.0, '{"k": %d}' % (i % 100)) for i in range(200)]
    d = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    d.write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["read_agent_trace"](spark, str(tmp_path))
    assert got.count() == 40 and dict(got.dtypes)["trace"] == "bigint"
    assert len(list((tmp_path / "out").rglob("part-*"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
