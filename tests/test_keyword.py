"""The block-max index returns what scoring every entry returns, and leaves blocks unread."""

import random

import pytest

from engramlake.operators import keyword as K
from engramlake.operators import memory as M


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    rare = [f"r{i}" for i in range(200)]
    rows = [(1 if rng.random() < 0.9 else 2, i, " ".join(["the", "of"] + rng.choices(rare, k=rng.randint(0, 6)) + ["and"] * rng.randint(0, 3))) for i in range(n)]
    rows += [(1, n + i, "the r7 r7 r9") for i in range(30)]  # entries that tie
    rows += [(2, n + 30, ""), (2, n + 31, None), (3, n + 32, "alone")]
    entries = spark.createDataFrame(rows, "agent_id long, entry_id long, content string")
    asked = [(1, 1, "the r7 and r9"), (1, 2, "of of the"), (2, 3, "r1 r2 r3 the"), (2, 4, "absent"), (3, 5, "alone the"), (4, 6, "the"), (1, 7, None)]
    return spark.createDataFrame(asked, "agent_id long, query_id long, text string"), entries


@pytest.mark.parametrize("block,lead,k", [(8, 1, 5), (50, 2, 40), (10_000, 1, 3)])
def test_topk_is_the_head_of_all_scores(spark, block, lead, k):
    queries, entries = corpus(spark)
    got = {}
    for r in K.bm25_topk(queries, entries, k, block_entries=block, lead=lead).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.entry_id, round(r.score, 9)))
    want = {}
    for r in M.bm25_scores(queries, entries.fillna("")).collect():
        want.setdefault(r.query_id, []).append((-round(r.score, 9), r.entry_id))
    assert {q: sorted(v) for q, v in got.items()} == {q: [(i + 1, e, -s) for i, (s, e) in enumerate(sorted(v)[:k])] for q, v in want.items()}


def test_common_words_leave_blocks_unread(spark):
    queries, entries = corpus(spark, 2000)
    index = K.keyword_index(entries, block_entries=16)
    one = queries.where("query_id = 1")
    terms = K.weighted_words(one, index)
    bounds = K.block_bounds(terms, index).cache()
    scores = K.block_scores(bounds, terms, index)
    best = {(r.agent_id, r.query_id, r.block): r.bound for r in bounds.collect()}
    blocks = {r.entry_id: r.block for r in index.selectExpr("block", "inline(postings)").collect()}
    assert all(float(r.score) <= best[(r.agent_id, r.query_id, blocks[r.entry_id])] * (1 + K.SLACK) for r in scores.collect() if r.agent_id == 1)
    read = K.top_k(bounds, ["agent_id", "query_id"], [bounds.bound.desc(), bounds.block], 8, "n")
    more = K.open_blocks(bounds, read, K.block_scores(read, terms, index), 5)
    assert read.count() + more.count() < 0.7 * bounds.count()
    whole = K.bm25_topk(one, entries, 5, index=index).select("entry_id", "rank").collect()
    assert sorted(whole) == sorted(K.bm25_topk(one, entries, 5, block_entries=16).select("entry_id", "rank").collect())


def test_no_entries(spark):
    queries, entries = corpus(spark, 10)
    assert K.bm25_topk(queries, entries.limit(0), 3).count() == 0
    assert K.bm25_topk(queries.limit(0), entries, 3).count() == 0
