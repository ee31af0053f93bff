"""Neighbours, URLs, mixing, sharding, quotes and the pipeline beside brute-force versions."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engramlake.llm import mixing, neighbours, oracles, quotes, sharding, simhash, suffixes, urls
from engramlake.llm.queries import QUERIES, WEIGHTS

SF = "/root/testdata/sf0.001"


def plain_nearest(rows, k, asks):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = {}
    for i in ids[[asks(i) for i in ids]]:
        s = np.where(ids == i, -2, neighbours.cosines(x, ok[i]))
        best = np.lexsort([ids, -s])[:k]
        out[int(i)] = [(int(ids[j]), s[j]) for j in best if ids[j] != i]
    return out


def test_neighbours_edges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60, 90)] + [(90, [2.0, 4.0, 6.0, 8.0]), (91, [1e30, 2e30, 3e30, 4e30])]
    rows += [(92, None), (93, [0.0] * 4), (94, [1.0, None, 1.0, 1.0]), (95, [float("nan")] * 4), (96, [1.0]), (97, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (98, [])]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, rows[0]]], "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert dict(got) == plain_nearest(rows, 5, lambda i: i % 10 == 0)
    few = neighbours.nearest(df.where("vec_id in (0, 1)"), F.lit(True)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == [(0, 1, 1), (1, 1, 0)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_probes_come_in_order_of_chance():
    index = neighbours.Index.of(8, 100_000, 0.8, 1, 2, 1.5)
    place = index.places(np.random.default_rng(0).normal(size=(1, 8)))[0, 0]
    probes = index.probes(place, 200)
    assert (probes[0] == np.floor(place)).mean() > 0.5 and len({tuple(p) for p in probes.tolist()}) == 200

    def chance(p):
        edge = lambda e, x: 0.5 * math.erfc(-(e - x) / index.spread / math.sqrt(2))
        return math.prod(edge(b + 1, x) - edge(b, x) for b, x in zip(p, place, strict=True))

    c = [chance(p) for p in probes]
    assert all(a >= b * (1 - 1e-9) for a, b in zip(c, c[1:], strict=False))


@pytest.mark.parametrize("piece", [neighbours.PIECE, 50])
def test_neighbours_recall(spark, piece):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 8000)] + 0.4 * rng.normal(size=(8000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, piece=piece).collect():
        got[r.query_id].add(r.vec_id)
    x, hit = x.astype(float), 0
    for q in range(0, 8000, 50):
        s = neighbours.cosines(x, x[q])
        s[q] = -2
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit / (5 * len(got)) >= 0.9 and len(got) == 160


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.net/en", "http://net/", "http://net", "http://x.net?q=/", "https://example.com/de/1",
    "http://notexample.com/de/", "ftp://a.org/fr/2://b", "http://org/fr/", "http://é.org/fr/ß", "://", "http:///de/", "http://u@example.com/de/", "a://b.net/en/#",
]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    df = spark.createDataFrame([(i if i else None, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.id or 0: r for r in urls.judge(df).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urls.keep_allowed(df).columns == df.columns
    assert urls.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(df.limit(0).union(df.where("page_id = 2"))).collect()} == {"allow"}


def test_url_model_tells_unseen_urls_apart(spark):
    rng = np.random.default_rng(3)
    word = lambda a: "".join(rng.choice(list(a), 12))
    rows = [(f"{word('abc')}/{word('xyz')}", 1) for _ in range(600)] + [(f"{word('pqr')}/{word('stu')}", 0) for _ in range(200)]
    model = urls.fit(spark.createDataFrame(rows, "rest string, kind int"))
    import pyarrow as pa

    d = model.difference(pa.array(["bca/zyxx", "rpq/uts", "", None]))
    assert d[0] > model.threshold > d[1] and d[2] == d[3] == 0


def test_mixing_fills_siblings_first(spark):
    rows = [("a", "x", "s1", 100), ("a", "x", "s2", 10), ("a", "y", "s3", 10), ("b", "x", "s4", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    tree = ("domain", "lang", "source")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, tree, {}, budget=400, max_epochs=2).collect()}
    # a: 200 of 400; its y can use 20 of 100, so x gets 180; s2 can use 20 of 90, so s1 gets 160
    assert got == {"s1": 160, "s2": 20, "s3": 20, "s4": 200}
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, tree, {("b",): 0.0}, budget=400, max_epochs=2).collect()}
    assert got == {"s1": 200, "s2": 20, "s3": 20, "s4": 0}


@pytest.mark.parametrize("slice_rows", [mixing.SLICE_ROWS, 3])
def test_mixing_beside_sql(spark, slice_rows):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    tree = ("domain", "lang", "source")
    want = Counter((r[0], r[5]) for r in con.execute(oracles.mixing_sql(WEIGHTS, tree)).fetchall())
    from engramlake.llm.queries import domain_of

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("domain", domain_of(F.col("source")))
    got = mixing.mixed(docs, tree, WEIGHTS, slice_rows=slice_rows)
    assert Counter((r.doc_id, r["__epoch"]) for r in got.select("doc_id", "__epoch").collect()) == want


def test_mixing_edges(spark):
    rows = [(1, "a b c", None, "s"), (1, "a b c", None, "s"), (None, "d e", None, "s"), (2, None, "en", None), (3, "", "en", None), (4, "x " * 50, "en", "s"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed(df, ("lang", "source"), {}, max_epochs=1)
    assert Counter(r[:4] for r in got.collect()) <= Counter(rows)
    assert got.columns == [*df.columns, "__epoch"]
    whole = mixing.mixed(df, ("lang", "source"), {}, budget=10_000, max_epochs=2)
    used = Counter(r.doc_id for r in whole.where("text like '% %'").collect())
    assert used == {1: 4, None: 2, 4: 2}
    assert mixing.mixed(df.limit(0), ("lang", "source"), {}).count() == 0


@pytest.mark.parametrize("limit", [1 << 14, 1 << 17])
def test_sharding_beside_sql(spark, limit):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: (r[1], r[2], r[3]) for r in con.execute(oracles.sharding_sql(limit)).fetchall()}
    found = sharding.shards(spark.read.parquet(f"{SF}/documents.parquet"), limit=limit)
    got = found.select("doc_id", sharding.shard_name(F.col("__depth"), F.col("__prefix")).alias("s"), "__depth", F.octet_length("text").alias("n")).collect()
    assert {r.doc_id: (r.s, r["__depth"], r.n) for r in got} == want
    size, keys = Counter(), defaultdict(set)
    for i, (s, _, n) in want.items():
        size[s] += n
        keys[s].add(i)
    assert all(n <= limit or len(keys[s]) == 1 for s, n in size.items())
    assert len(size) > 1
    # a directory: prefixes cover every hash once
    assert sum(2.0 ** -len(s) for s in size) <= 1.0


def test_sharding_edges(spark, tmp_path):
    rows = [(1, "a" * 100, "x"), (1, "a" * 100, "x"), (2, None, "x"), (2, "", "x"), (None, "b" * 90, "x"), (None, "c" * 90, "x"), (None, None, None), (5, "d" * 1000, "x"), *[(7, f"{i:050d}", "y") for i in range(40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shards(df, limit=128).collect()
    assert len(got) == len(rows)
    size, texts = Counter(), defaultdict(set)
    for r in got:
        size[r["__depth"], r["__prefix"]] += len(r.text or "")
        texts[r["__depth"], r["__prefix"]].add((r.doc_id, r.text))
    assert all(n <= 128 or len(texts[k]) == 1 for k, n in size.items())
    assert sharding.shards(df.limit(0)).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), limit=128)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


MESSAGES = [
    (1, 0, "Hello there my friend\nHow are you doing today?"), (1, 1, "On Monday Bob wrote:\n> Hello there my friend\n> How are you doing today?\n\nI am doing fine, thanks."),
    (1, 2, "Alice wrote:\n> > How are you doing today?\n> I am doing fine, thanks.\nGood to hear that"), (1, 3, "> hello   THERE my friend\nA separate answer here"),
    (1, 4, "> never said by anyone\nok then we go"), (1, 5, "> ok then\nshort quotes link to nothing"), (2, 0, None), (None, 1, "> x y z\nabc"), (2, 1, ""), (2, 1, ""), (2, None, "x y z"),
    (3, 0, "> x y z\nquoted before it is said"), (3, 1, "x y z"),
]


def test_quotes(spark):
    df = spark.createDataFrame([(*m, 9) for m in MESSAGES], "conv_id long, turn long, text string, thread int")
    got = Counter((r.conv, r.turn, r.own, r.n_quotes, r.n_linked, r.reply_to, r.thread, r.depth) for r in quotes.threads(df).collect())
    assert got == Counter([
        (1, 0, "Hello there my friend\nHow are you doing today?", 0, 0, None, 0, 0), (1, 1, "I am doing fine, thanks.", 1, 1, 0, 0, 1),
        (1, 2, "Good to hear that", 2, 2, 1, 0, 2), (1, 3, "A separate answer here", 1, 1, 0, 0, 1), (1, 4, "ok then we go", 1, 0, None, 4, 0),
        (1, 5, "short quotes link to nothing", 0, 0, None, 5, 0), (2, 0, None, 0, 0, None, 0, 0), (None, 1, "abc", 0, 0, None, 1, 0),
        (2, 1, "", 0, 0, None, 1, 0), (2, 1, "", 0, 0, None, 1, 0), (2, None, "x y z", 0, 0, None, None, 0),
        (3, 0, "quoted before it is said", 0 + 1, 0, None, 0, 0), (3, 1, "x y z", 0, 0, None, 1, 0),
    ])
    assert quotes.threads(df.limit(0)).count() == 0


def test_long_chains_of_replies(spark):
    rows = [(1, i, (f"> line number {i - 1} here\n" if i else "") + f"line number {i} here") for i in range(40)]
    got = quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert {(r.turn, r.thread, r.depth) for r in got} == {(i, 0, i) for i in range(40)}


def test_pipeline_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    own = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "src1", 0), (-1, "", "en", "src1", 0)], docs.schema)
    docs = docs.union(own).withColumn("score", F.lit(1)).withColumn("domain", F.lit("kept"))
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        got = rows.collect()
        assert rows.columns[: len(docs.columns)] == docs.columns
        before = Counter(r.doc_id for r in docs.select("doc_id").collect())
        after = Counter(r.doc_id for r in got)
        assert set(after) <= set(before)
        if name == "simhash_near_dedup":
            found = simhash.near_duplicates(docs).collect()
            assert after == Counter({**{i: 1 for i in {r.component for r in found} - {None}}, None: before[None]})
        if name == "benchmark_decontamination":
            marked = suffixes.contamination(docs, corpus_pipeline.table(spark, SF, "benchmark"))
            assert after == Counter(r.doc_id for r in marked.where(~suffixes.is_contaminated()).collect())
        if name == "sharding":
            assert after == before and all(r.depth == len(r.shard) for r in got)
        docs = spark.createDataFrame(got, rows.schema)
    empty = corpus_pipeline.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_name_their_columns_once(spark, name):
    columns = QUERIES[name](spark, SF).columns
    assert len(set(columns)) == len(columns)
