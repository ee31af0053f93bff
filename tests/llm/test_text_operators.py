"""Operators on texts beside brute-force versions: shared edge rows and the smallest tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from engramlake.llm import pii, simhash, spans, suffixes, superkmers, toxicity, vptree
from engramlake.llm.links import components
from engramlake.llm.queries import QUERIES, held_out

SF = "/root/testdata/sf0.001"
SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDE = " ".join(f"w{i}" for i in range(80))
EDGE = [
    (1, "a " * 100), (2, "b a" * 60), (2, "b a" * 60), (3, None), (4, ""), (5, WIDE), (6, "x\t" + WIDE.replace(" ", "\n ")), (7, " ".join(map(str, range(34)))),
    (None, "no id here but\x0bwords " + WIDE), (None, None), (8, "é\x85x ß😀 Ünï " * 30), (9, "word " * 30_000), (10, "   \n\t "),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def edge(spark):
    """The edge rows with columns whose names clash with results."""
    rows = [(i, t, "x", 0.5, 1) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, component string, score double, n_words int")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize(("members", "pattern", "low"), [(spans.NOT_SPACE, SPACE, False), (spans.ALNUM, ALNUM, True)])
def test_words(members, pattern, low):
    texts, got, seen = [t for _, t in EDGE], [], {}
    for block in spans.blocks(pa.array(texts), 256, low):
        w, raw = block.words(members), block.data.tobytes()
        h = w.hashes()
        words = [raw[a:z] for a, z in zip(w.start, w.end, strict=True)]
        assert all(seen.setdefault(x, y) == y for x, y in zip(words, h, strict=True))
        got += [[x.decode() for x in words[w.bounds[k] : w.bounds[k + 1]]] for k in range(block.hi - block.lo)]
    assert got == [re.findall(pattern, lower(t) if low else t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def plain_fingerprint(text):
    w = re.findall(SPACE, lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(points, reach=3):
    label = list(range(len(points)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, p in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(p ^ points[i + 1 :]) <= reach):
            a, b = find(i), find(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def clustered(seed, n=3000):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)
    flip = np.uint64(1) << rng.integers(0, 64, (n, 3), dtype=np.uint64)
    near = rng.choice(centre, n) ^ np.bitwise_xor.reduce(np.where(rng.random((n, 3)) < 0.6, flip, np.uint64(0)), axis=1)
    return np.unique(np.concatenate([near, rng.integers(0, 1 << 63, n, dtype=np.uint64)]))


def test_tree_separates_no_pair():
    points = clustered(1)
    tree = vptree.build(points[::4], len(points), 300, 3)
    at, leaf = tree.deal(points)
    assert tree.leaves > 4
    homes = [set() for _ in points]
    for a, x in zip(at, leaf, strict=True):
        homes[a].add(int(x))
    for i, p in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(p ^ points) <= 3):
            assert homes[i] & homes[j]


@pytest.mark.parametrize("make", [clustered, lambda s: np.unique(np.arange(3000, dtype=np.uint64) ^ np.uint64(s << 40))])
def test_links_inside_a_shard(make):
    points = make(2)
    a, b = vptree.near_links(points, 3)
    assert (np.bitwise_count(points[a] ^ points[b]) <= 6).all()
    got = list(range(len(points)))

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        got[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(points))] == plain_components(points)


def test_small_shards_and_blocks(spark):
    points = clustered(3, 1000)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    links = simhash.near_fingerprints(df, sample=400, leaf_points=60)
    root = {r.node: r.root for r in components(links).collect()}
    want, low = plain_components(points), {}
    by = [root.get(int(x), int(x)) for x in points.view(np.int64)]
    for g, w in zip(by, want, strict=True):
        assert low.setdefault(w, g) == g
    assert len(set(low.values())) == len(low)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (7, 7), (20, 21), (None, 4), (21, 20), *[(i, i + 1) for i in range(100, 160)]]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 21: 20, **{i: 100 for i in range(101, 161)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    for df, rows in ((edge(spark), EDGE), (spark.read.parquet(f"{SF}/documents.parquet"), documents(spark))):
        prints = [plain_fingerprint(t) for _, t in rows]
        points = np.unique(np.array(prints, np.uint64))
        part = dict(zip(points.tolist(), plain_components(points), strict=True))
        least = {}
        for (i, _), p in zip(rows, prints, strict=True):
            if i is not None:
                least[part[p]] = min(i, least.get(part[p], i))
        want = Counter((i, p, least.get(part[p])) for (i, _), p in zip(rows, prints, strict=True))
        got = simhash.near_duplicates(df).collect()
        assert Counter((r.id, r.fp % (1 << 64), r.component) for r in got) == want
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert simhash.near_duplicates(edge(spark).limit(0)).count() == 0


def plain_repeats(rows, size):
    words = [(i, re.findall(SPACE, t or "")) for i, t in rows]
    count = Counter(tuple(w[k : k + size]) for _, w in words for k in range(len(w) - size + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


@pytest.mark.parametrize("bucket_strings", [superkmers.BUCKET_STRINGS, 1])
def test_substring_dedup(spark, bucket_strings):
    rows = [r for r in EDGE if r[0] != 9]
    df = edge(spark).where("doc_id is null or doc_id <> 9")
    got = superkmers.remove_repeats(df, window=12, gram=4, bucket_strings=bucket_strings).collect()
    assert Counter(map(tuple, got)) == plain_repeats(rows, 12)


def test_substring_dedup_tables(spark):
    got = QUERIES["op4_substring_dedup"](spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter({r[:4]: n for r, n in plain_repeats(documents(spark), 35).items()})
    assert superkmers.remove_repeats(edge(spark).limit(0)).count() == 0


def plain_contamination(rows, bench, size):
    windows = {}
    for item, t in bench:
        w = re.findall(ALNUM, lower(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w, hit, items = re.findall(ALNUM, lower(t)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if o := windows.get(tuple(w[k : k + n])):
                    items |= {str(x) for x in o if x is not None}
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), tuple(sorted(items))))
    return Counter(out)


@pytest.mark.parametrize("block_words", [suffixes.BLOCK_WORDS, 20])
def test_contamination(spark, block_words):
    bench = [(1, WIDE[:200]), (2, "W3 w4"), (2, "b"), (10, "w3, W4!"), (3, None), (4, "..."), (None, "ab ba a"), (5, "word " * 20), (6, WIDE[:100])]
    df = spark.createDataFrame(bench, "item_id long, text string")
    found = suffixes.contamination(edge(spark), df, window=5, block_words=block_words)
    got = Counter((r.doc_id, r.contamination.n_words, r.contamination.n_hit, tuple(r.contamination["items"])) for r in found.collect())
    assert got == plain_contamination(EDGE, bench, 5)
    for r in found.collect():
        assert sum(h["last"] - h["first"] for h in r.contamination.hits) == r.contamination.n_hit
    assert suffixes.clean(edge(spark), df).columns == edge(spark).columns
    assert suffixes.contamination(edge(spark), df.limit(0)).where("contamination.n_hit > 0").count() == 0


def test_decontamination_tables(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = documents(spark)
    want = {r[:3] + (len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[2] > 0 and 20 * r[2] >= r[1]) for r in plain_contamination(rows, bench, 13)}
    assert {tuple(r) for r in QUERIES["op10_benchmark_decontamination"](spark, SF).collect()} == want
    texts, items = dict(rows), {str(i): t for i, t in bench}
    matches = suffixes.longest_matches(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert matches
    docs = {i: re.findall(ALNUM, lower(t)) for i, t in texts.items()}
    for r in matches[:50]:
        item = re.findall(ALNUM, lower(items[r.item]))[r.word :]
        assert docs[r.id][r.at : r.at + r.length] == item[: r.length]
        longest = max(
            next((n for n in range(min(len(item), len(w) - k)) if item[n] != w[k + n]), min(len(item), len(w) - k))
            for w in docs.values() for k in range(len(w))
        ) if r.word % 7 == 0 else r.length
        assert r.length == longest


def plain_segments(x):
    if not len(x) or max(x) <= 0:
        return []
    total = np.concatenate([[0], np.cumsum(x)])
    value, i, j = max((total[j] - total[i], -i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1))
    i = -i
    return plain_segments(x[:i]) + [(i, j)] + [(a + j, b + j) for a, b in plain_segments(x[j:])]


def test_maximal_segments():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.normal(-0.3, 1, rng.integers(0, 25))
        assert [s[:2] for s in toxicity.maximal_segments(x)] == plain_segments(x)


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out()))
    found = toxicity.score(docs, model).join(labels, "doc_id").where(held_out()).select("toxic", "toxicity.score").collect()
    hit = sum(r.score >= 0.5 for r in found if r.toxic)
    false = sum(r.score >= 0.5 for r in found if not r.toxic)
    assert hit >= 0.6 * sum(r.toxic for r in found) and false <= 0.05 * len(found)
    scored = toxicity.score(edge(spark), model).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.toxicity.score <= 1 for r in scored)
    empty = toxicity.fit(edge(spark).limit(0), labels.limit(0))
    assert {r.toxicity.score for r in toxicity.score(edge(spark), empty).collect()} == {0.0}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


#: As the contract states them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    texts = [
        "a@b.co_x@d.e é x@y@z.com", None, "", "1.2.3.4.5.6.7.8 300.1.2.3 000255.0.0.1 99999999999.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1111-1 41111111111111112",
        "+1 (988) 555-2485 +12 +1 23456789 +1((((", "é😀 a.b%c@x-y.z.w +49 30 1234567 😀 10.0.0.1", "1 " * 2000 + "@" * 50, "x@y.z " * 300, "+1 234 567 890 " * 300,
    ]
    long = ["a" * 200_000 + "@b.c", "1" * 200_000 + ".1.1.1", "+1" + " " * 50_000 + "2"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts + long)], "doc_id long, text string, spans string")
    got = {r.id: r for r in pii.personal_data(df).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == plain_pii(t), t
    assert [tuple(s) for s in got[len(texts)].base] == [("email", 0, 200_004)]
    assert not got[len(texts) + 1].base and not got[len(texts) + 2].base
    assert got[5].redacted == "[phone] +12 [phone] +1((((" and got[1].redacted == ""
    assert pii.personal_data(df.limit(0)).count() == 0


def test_pii_tables(spark):
    texts = dict(documents(spark))
    for r in QUERIES["op8_pii"](spark, SF).collect():
        want = plain_pii(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_candidates_that_lack_only_the_mark_are_added(spark):
    """Phones without plus look like those with one, and stand after the same words."""
    rng = np.random.default_rng(5)
    number = lambda: f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    rows = [(i, f"please call +1 {number()} soon") for i in range(300)]
    rows += [(i, f"serial {rng.integers(10**8, 10**9)} part") for i in range(300, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    assert "phone" in model.thresholds
    probe = spark.createDataFrame([(1, f"please call 1 {number()} soon"), (2, "serial 123456789 part")], "doc_id long, text string")
    got = {r.id: [s.kind for s in r.spans] for r in pii.personal_data(probe, model=model).collect()}
    assert got == {1: ["phone"], 2: []}


def test_boosting_orders_and_calibrates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (2000, 4))
    y = (x[:, 0] > 9) & (x[:, 2] < 12)
    model = pii.boost(x, y, ["a"] * 2000, np.ones(2000), np.arange(2000) % 3 == 0)
    m = model.margins(x)
    chosen = m >= model.thresholds["a"]
    assert (y & chosen).sum() / chosen.sum() > 0.95 and (y & chosen).sum() / y.sum() > 0.9


def test_margin_expression_is_the_model(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (200, 4))
    model = pii.boost(x, x[:, 1] > 3, ["a"] * 200, np.ones(200), np.arange(200) % 3 == 0, trees=5)
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i int, x array<int>").select("i", model.margin(F.col("x")).alias("m")).collect()
    assert np.allclose([r.m for r in sorted(got)], model.margins(x))
