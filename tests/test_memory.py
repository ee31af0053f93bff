import random

import numpy as np
import pytest

from engramlake.operators import hybrid
from engramlake.operators import memory as M


def fold(ops, budget, free_replace=False):
    """The sequential definition: one agent at a time, one operation at a time."""
    out = {}
    for agent in sorted({o[0] for o in ops}):
        entries, used = [], 0
        for _, _, action, topic, content, old, ok in sorted(o for o in ops if o[0] == agent):
            if not ok or action not in ("add", "replace", "remove"):
                continue
            costs = not (free_replace and action != "add")
            if costs and used >= budget:
                continue
            hits = [i for i, (t, c) in enumerate(entries) if t == topic and old in c]
            target = hits[0] if hits and len({entries[i][1] for i in hits}) == 1 else None
            if action == "add":
                if not content or (topic, content) in entries:
                    continue
                entries.append((topic, content))
            elif target is None or (action == "replace" and not content):
                continue
            elif action == "replace":
                entries[target] = (topic, content)
            else:
                del entries[target]
            used += costs
        out[agent] = (entries, used)
    return out


def make_ops(n=400, seed=5):
    rng = random.Random(seed)
    acts = ["add", "add", "replace", "remove", "search"]
    return [
        (rng.choice([1, 1, 1, 2, 3]), i, rng.choice(acts), rng.choice(["t1", "t2"]), rng.choice(["", "a", "ab", "abc", "b", "c"]),
         rng.choice(["a", "b", "c", "ab"]), rng.random() > 0.1)
        for i in range(n)
    ]


SCHEMA = "agent_id bigint, seq bigint, action string, topic string, content string, old_text string, ok boolean"


@pytest.mark.parametrize("budget,free", [(10, False), (60, False), (5, True)])
def test_replay_equals_the_fold(spark, budget, free):
    ops = make_ops()
    got = {}
    for r in M.replay_memory(spark.createDataFrame(ops, SCHEMA).repartition(4), budget, free_replace=free).orderBy("agent_id", "position").collect():
        got.setdefault(r.agent_id, ([], r.writes_used))[0].append((r.topic, r.content))
    want = {a: v for a, v in fold(ops, budget, free).items() if v[0]}
    assert got == want


def test_replay_over_many_small_batches(spark):
    ops = make_ops(1500, seed=9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows = M.replay_memory(spark.createDataFrame(ops, SCHEMA), 40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = fold(ops, 40)
    for agent, (entries, used) in want.items():
        mine = sorted((r.position, r.topic, r.content) for r in rows if r.agent_id == agent)
        assert [(t, c) for _, t, c in mine] == entries


def test_replay_goes_on_from_held_entries(spark):
    held = [(1, 2, "t1", "b"), (1, 1, "t1", "a"), (7, 1, "t2", "only held")]
    ops = [
        (1, 1, "add", "t1", "a", "", True, None), (1, 2, "replace", "t1", "c", "b", True, "memory"),
        (1, 3, "add", "t1", "not mine", "", True, "user"), (1, 4, "add", "t1", None, "", True, None),
        (1, 5, "add", "t1", "d", "", True, "memory"), (1, 6, "add", "t1", "over budget", "", True, None),
        (2, 1, "remove", "t1", "", "a", True, None),
    ]
    d = spark.createDataFrame(ops, SCHEMA + ", target string")
    initial = spark.createDataFrame(held, "agent_id bigint, seq bigint, topic string, content string")
    rows = M.replay_memory(d, 2, initial=initial).orderBy("agent_id", "position").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "t1", "a", 2), (1, 1, "t1", "c", 2), (1, 2, "t1", "d", 2), (7, 0, "t2", "only held", 0)]
    assert M.replay_memory(d.limit(0), 2).count() == 0


def test_topics_are_normalised(spark):
    ops = [(1, 1, "add", " My Topic! ", "x", "", True), (1, 2, "add", "mytopic", "x", "", True), (1, 3, "add", "", "y", "", True)]
    rows = M.replay_memory(spark.createDataFrame(ops, SCHEMA), 10).collect()
    assert sorted((r.topic, r.content) for r in rows) == [("general", "y"), ("mytopic", "x")]


def test_write_budget_verdicts(spark):
    ops = [
        (1, 1, "Write", 10, True, False), (1, 2, "Edit", 10, False, False), (1, 3, "Write", 3000, True, False), (1, 4, "Edit", 10, True, False),
        (1, 5, "Write", 10, True, False), (1, 6, "Edit", 10, True, True), (1, 7, "Read", 0, True, False),
    ]
    d = spark.createDataFrame(ops, "a int, s bigint, tool string, n_chars int, ok boolean, free boolean")
    for chunk in (1, 3, 1000):
        rows = M.enforce_write_budget(d, ["a"], "s", 2, chunk_rows=chunk).orderBy("s").collect()
        assert [r.verdict for r in rows] == ["accepted", "refunded", "too_long", "accepted", "rejected", "accepted", "free"]
        assert [r.remaining for r in rows] == [1, 1, 1, 0, 0, 0, 0]


def test_stored_needs_name_and_value_in_the_same_entry(spark):
    long = spark.createDataFrame(
        [(1, "Ann Lee", "rev", "float", 1234.5, None, None), (1, "Bo", "rev", "float", 77.0, None, None), (1, "Cy", "kind", "enum", None, "Retail", None)],
        "world_id int, entity string, attr string, dtype string, num double, str string, dt date",
    )
    attr_def = spark.createDataFrame([("rev", "float", "$", "revenue"), ("kind", "enum", "", "kind")], "attr string, dtype string, unit string, label string")
    entries = spark.createDataFrame(
        [(1, 1, "ann lee | revenue: $1,234.50"), (1, 2, "Bo was mentioned"), (1, 3, "someone has 77.0"), (1, 4, "CY works in retail")],
        "world_id int, entry_id int, content string",
    )
    v = M.value_variants(long, attr_def)
    out = {r.entity: r.stored for r in M.detect_stored_entities(long, v, entries).collect()}
    assert out == {"Ann Lee": True, "Bo": False, "Cy": True}
    assert [r.entry_id for r in M.noise_documents(long, v, entries).collect()] == [2]


def test_hybrid_search_against_numpy(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    n, dims = 40, 8
    vec = rng.normal(size=(n, dims))
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 9))) for _ in range(n)]
    q, qv = "alpha gamma gamma", rng.normal(size=dims)
    entries = spark.createDataFrame(
        [("a", i, i, texts[i], vec[i].tolist()) for i in range(n)], "agent_id string, entry_id bigint, seq bigint, content string, embedding array<double>"
    )
    queries = spark.createDataFrame([("a", 1, q, qv.tolist())], "agent_id string, query_id int, text string, qvec array<double>")
    toks = [t.split() for t in texts]
    avg = sum(map(len, toks)) / n
    bm = np.zeros(n)
    for w in q.split():
        df = sum(w in t for t in toks)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        bm += [idf * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for t in toks]
    cos = vec @ qv / np.linalg.norm(vec, axis=1) / np.linalg.norm(qv)
    rank = lambda s: {i: r + 1 for r, i in enumerate(sorted(range(n), key=lambda i: (-round(s[i], 9), i)))}
    rv, rb = rank(cos), rank(bm)
    score = {i: (0.7 / (60 + rv[i]) + 0.3 / (60 + rb[i])) * 0.99 ** (n - 1 - i) for i in range(n)}
    want = sorted(score, key=lambda i: (-score[i], i))[:5]
    got = hybrid.hybrid_search(queries, entries, 5, dims, digits=9).orderBy("position").collect()
    assert [r.entry_id for r in got] == want
    assert [r.score for r in got] == pytest.approx([score[i] for i in want])


@pytest.mark.parametrize("block_rows", [hybrid.BLOCK_ROWS, 170])
def test_hybrid_search_beside_all_pairs(spark, block_rows):
    rng = np.random.default_rng(7)
    names = [f"w{i}" for i in range(12)]
    rows, queries = [], [("a", 1, "w1 w2 w2", rng.normal(size=4).tolist()), ("a", 2, "w3", None), ("a", 3, "nothing known", rng.normal(size=4).tolist()), ("b", 4, "w1 w1", [0.0] * 4), ("c", 5, "w1", [1.0] * 4)]
    for agent, n in (("a", 1500), ("b", 3)):
        for i in range(n):
            v = None if rng.random() < 0.3 else [1.0, 2.0, 3.0, 4.0] if rng.random() < 0.2 else rng.normal(size=4).tolist()
            rows.append((agent, i, int(rng.integers(0, n)), " ".join(rng.choice(names, size=rng.integers(0, 9))), v))
    entries = spark.createDataFrame(rows, "agent_id string, entry_id bigint, seq bigint, content string, embedding array<double>")
    asked = spark.createDataFrame(queries, "agent_id string, query_id int, text string, qvec array<double>")
    fused = {}
    for r in M.fused_ranks(asked, entries, 4, digits=9).collect():
        fused.setdefault(r.query_id, []).append((r.entry_id, r.rank_vec, r.rank_bm25, r.rrf))
    seq = {(a, i): s for a, i, s, _, _ in rows}
    want = []
    for agent, q, _, _ in queries:
        latest = max((s for (a, _), s in seq.items() if a == agent), default=0)
        best = sorted((-f[3] * 0.99 ** (latest - seq[agent, f[0]]), f[0], f[1], f[2]) for f in fused.get(q, ()))[:5]
        want += [(agent, q, i, v, k, n) for n, (_, i, v, k) in enumerate(best, 1)]
    got = hybrid.hybrid_search(asked, entries, 5, 4, block_rows=block_rows, digits=9)
    assert sorted((r.agent_id, r.query_id, r.entry_id, r.rank_vec, r.rank_bm25, r.position) for r in got.collect()) == sorted(want)
    kept = hybrid.candidates(entries, 5, ["agent_id"]).groupBy("agent_id").count().collect()
    assert {r.agent_id: r["count"] for r in kept}["a"] < 700  # of 1500
    assert hybrid.hybrid_search(asked, entries.limit(0), 5, 4).count() == 0


def test_long_vectors_take_the_fold(spark):
    d = spark.createDataFrame([([1.0] * 200, [2.0] * 200)], "a array<double>, b array<double>")
    assert d.select(M.dot("a", "b", 200)).first()[0] == 400.0


def test_upsert_and_edit(spark):
    ops = spark.createDataFrame(
        [("a", 1, 1, "upsert", "x"), ("a", 1, 3, "upsert", "z"), ("a", 2, 1, "upsert", "y"), ("a", 2, 2, "forget", None)],
        "agent_id string, entry_id int, seq int, op string, content string",
    )
    assert [tuple(r) for r in M.upsert_entries(ops).collect()] == [("a", 1, 3, "z")]
    entries = spark.createDataFrame([("a", 1, 1, "one two one"), ("a", 2, 1, "none")], "agent_id string, entry_id int, seq int, content string")
    edits = spark.createDataFrame([("a", 1, "one", "1", 9), ("a", 2, "zzz", "1", 9)], "agent_id string, entry_id int, old_text string, new_text string, edit_seq int")
    assert sorted(tuple(r) for r in M.edit_entries(entries, edits).collect()) == [("a", 1, 9, "1 two one", True), ("a", 2, 1, "none", False)]


def test_kv_pairs(spark):
    d = spark.createDataFrame([(1, "Acme | revenue: $73,138.4M | note: a: b | broken")], "id int, content string")
    assert sorted((r.label, r.value) for r in M.extract_kv(d, ["id"]).collect()) == [("note", "a: b"), ("revenue", "$73,138.4M")]
