"""Cases that once gave wrong rows: copies at a prefix's end, and quotes that later turns repeat in part."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramlake.llm import mixing, pii, quotes, toxicity, vptree


@pytest.mark.parametrize("budget", [5, 15, 25, 35, 45, 55, 60, 75])
def test_mixing_never_overspends_on_copies(spark, budget):
    rows = [(i, "w " * 10, "a") for i in (1, 2, 3)] + [(4, "v " * 10, "a")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, leaf string")
    got = mixing.mixed(df, ["leaf"], {}, budget=budget).collect()
    assert 10 * len(got) <= budget
    copies = [sum(r.doc_id == 4 and r.__getitem__("__epoch") == e for r in got) for e in range(4)]
    assert set(copies) <= {0, 5}
    # the longest prefix of the seeded order that fits: the next key would not
    if budget < 80:
        key = mixing.order_key(df, "doc_id", "text", mixing.SEED, F.lit(0))
        order = sorted((r[0], r[1]) for r in df.groupBy(key.alias("k")).agg(F.count("*") * 10).collect())
        spent = 0
        for _, n in order:
            if spent + n > budget:
                break
            spent += n
        assert 10 * len(got) == spent


def linked(spark, turns):
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id string, turn long, text string, role string")
    _, links = quotes.link_quotes(df)
    return {(r.conv, r.turn): r.origin for r in links.collect()}


def test_most_shared_runs_win_over_later_ones(spark):
    turns = [("c", 0, "one two three four five six and more"), ("c", 1, "three four five again"), ("c", 2, "say two three four five"), ("c", 3, "> one two three four five six")]
    assert linked(spark, turns)[("c", 3)] == 0
    assert linked(spark, [*turns[:3], ("c", 3, "no"), ("c", 4, "> four five six and")])[("c", 4)] == 0


def test_trimmed_quotes_beside_brute_force(spark):
    rng = random.Random(4)
    turns, texts = [], {}
    for c in "ab":
        for t in range(60):
            own = " ".join(rng.choice("pqrs") * rng.randint(1, 2) for _ in range(rng.randint(3, 9)))
            own = rng.choice([*[x for (d, _), x in texts.items() if d == c], own]) if rng.random() < 0.3 else own
            quote = " ".join(rng.choice("pqrs") * rng.randint(1, 2) for _ in range(rng.randint(4, 7)))
            if t and rng.random() < 0.6:
                w = texts[c, rng.randrange(t)].split()
                quote = " ".join([*w[: rng.randint(3, 9)], "zz"])
            texts[c, t] = own
            turns.append((c, t, f"> {quote}\n{own}"))
    got = linked(spark, turns)
    for c, t, text in turns:
        runs = set(quotes.shingles(text.split("\n")[0][2:]))
        best = max(((len(runs & set(quotes.shingles(texts[c, e]))), e) for e in range(t)), default=(0, 0))
        assert got[c, t] == (best[1] if 2 * best[0] > len(runs) else None)
    assert sum(o is not None for o in got.values()) > 20


def test_unmarked_data_of_the_corpus_itself_is_added(spark):
    """Phones without plus, cards with a wrong check digit and written-out addresses gain spans; serials and dates do not."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phone = lambda: f"1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    name = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 9)))
    made = {
        "marked": lambda: f"please call +{phone()} soon", "phone": lambda: f"please call {phone()} soon", "serial": lambda: f"serial {digits(9)} part",
        "date": lambda: f"on 2024-{rng.randint(10, 12)}-{rng.randint(10, 28)} it", "mail": lambda: f"write to {name()}@{name()}.org today",
        "email": lambda: f"write to {name()} (at) {name()} (dot) org today", "number": lambda: f"pay 4{digits(15)} now", "long": lambda: f"at {name() * 40}[at]{name()}[dot]org so",
    }
    rows = [(i, what, make()) for i, (what, make) in enumerate((w, m) for w, m in made.items() for _ in range(1200 if w == "number" else 300))]  # a tenth of the numbers are cards
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = {r.id: r for r in pii.personal_data(df).collect()}
    added = {what: sum(len(got[i].spans) > len(got[i].base) for i, w, _ in rows if w == what) for what in made}
    assert min(added[w] for w in ("phone", "email", "long")) >= 270, added  # a threshold has no full recall
    assert added["serial"] == added["date"] == added["marked"] == added["mail"] == 0, added
    cards = [got[i] for i, w, _ in rows if w == "number"]
    assert sum([s.kind for s in r.spans] == ["card"] for r in cards) >= 1080 and 3 * pii.LEAST < sum(len(r.base) for r in cards) < 300
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got.values())


def test_the_bound_of_examples_and_an_empty_corpus(spark):
    df = spark.createDataFrame([(i, f"call +1 (212) 555-{1000 + i} or serial {10**8 + i}") for i in range(200)], "doc_id long, text string")
    for most in (5, 10_000):
        assert set(pii.fit(df, max_candidates=most).thresholds) <= {"phone"}
    assert pii.fit(df.limit(0)).thresholds == {}


def test_scores_of_texts_with_many_segments(spark):
    """Fitting sees what scoring sees: every segment of a text, however many there are."""
    bad, good = "vile nasty hateful", " ".join(f"calm{i}" for i in range(40))
    rows = [(i, (good + " " + (bad + " " + good + " ") * (i % 90)) if i % 2 else good + f" n{i} " + (good + " ") * (i % 7)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 and i % 90 > 0)) for i, _ in rows], "doc_id long, toxic int")
    seen = []
    plain = toxicity.logistic
    toxicity.logistic = lambda a, y: seen.append(a) or plain(a, y)
    try:
        model = toxicity.fit(docs, labels)
    finally:
        toxicity.logistic = plain
    assert np.expm1(seen[0][:, 3]).max() > 50
    out = toxicity.score(docs, model).join(labels, "doc_id").select("toxic", "toxicity.score").collect()
    assert sum((r.score >= 0.5) != r.toxic for r in out) <= 8


def test_a_dense_shard_needs_little_memory():
    rng = np.random.default_rng(4)
    bits = np.uint64(1) << rng.integers(0, 64, (30_000, 4), dtype=np.uint64)
    points = np.unique(np.uint64(0x0F0F) ^ np.bitwise_or.reduce(bits, axis=1))
    tracemalloc.start()
    a, b = vptree._joined(points[:512], points, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    near = np.bitwise_count(points[:512, None] ^ points[None]) <= 3
    linked = {int(x) for x in b}
    assert set(np.flatnonzero((near.sum(axis=0) - (np.arange(len(points)) < 512)) > 0).tolist()) <= linked | {int(x) for x in a}
    assert (np.bitwise_count(points[a] ^ points[b]) <= 6).all()


def test_toxicity_sends_its_counts_once(spark, monkeypatch):
    from pyspark import SparkContext

    from engramlake.llm import toxicity

    sent, whole = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(1) or whole(self, value))
    docs = spark.createDataFrame([(i, f"word{i % 7} " + ("vile " if i % 2 else "fine ") * (i % 5 + 1) + str(i)) for i in range(60)], "doc_id int, text string")
    labels = docs.selectExpr("doc_id", "doc_id % 2 as toxic")
    model = toxicity.fit(docs, labels)
    assert model.weights is not None and toxicity.score(docs, model).count() == 60
    assert len(sent) == 1
