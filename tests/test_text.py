import random

import pytest

from engramlake.functions import text as T
from engramlake.functions.text import contains_pairs


def brute(needles, docs):
    return {(s, n, d) for s, n, x in needles for s2, d, t in docs if s == s2 and None not in (n, d, x, t) and x.lower() in t.lower()}


def run(spark, needles, docs):
    n = spark.createDataFrame(needles, "s string, n int, x string")
    d = spark.createDataFrame(docs, "s string, d int, t string")
    out = contains_pairs(n, d, scope=["s"], needle_id="n", needle="x", doc_id="d", text="t")
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_embedded_and_partial_words(spark):
    needles = [("w", 1, "Ann Lee"), ("w", 2, "a b"), ("w", 3, "ore"), ("w", 4, "élan"), ("w", 5, "x-1"), ("v", 6, "ore")]
    docs = [
        ("w", 1, "joANN LEEds"), ("w", 2, "more"), ("w", 3, "a  b"), ("w", 4, "za bz"), ("w", 5, "Un ÉLAN vital"),
        ("w", 6, "ax-12"), ("w", 7, ""), ("v", 8, "ann lee"), ("v", 9, "shore"),
    ]
    assert run(spark, needles, docs) == brute(needles, docs)


def test_random_texts_match_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
    docs = [(rng.choice("st"), i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(80)]
    needles = [(rng.choice("st"), i, " ".join(word() for _ in range(rng.randint(1, 2)))) for i in range(60)]
    assert run(spark, needles, docs) == brute(needles, docs)


def test_needles_without_word_characters(spark):
    needles = [("w", 1, "-----"), ("w", 2, "--"), ("w", 3, ""), ("w", 4, "  "), ("w", 5, "!! ??"), ("w", 6, "\u2014"), ("w", 7, None), ("w", 8, "a--"), ("v", 9, "**")]
    docs = [("w", 1, "x ------ y"), ("w", 2, "a--b"), ("w", 3, ""), ("w", 4, "two  blanks"), ("w", 5, "what!! ??no"), ("w", 6, "one\u2014two"), ("w", 7, None), ("v", 8, "a--")]
    assert run(spark, needles, docs) == brute(needles, docs)


@pytest.mark.parametrize("most", [3, T.MOST_NEEDLES])
@pytest.mark.parametrize("few", [0, 1000])
def test_many_needles_of_one_text(spark, monkeypatch, most, few):
    monkeypatch.setattr(T, "MOST_NEEDLES", most)
    monkeypatch.setattr(T, "FEW", few)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab-") for _ in range(rng.randint(1, 4)))
    docs = [("s", i, " ".join(word() for _ in range(40))) for i in range(3)] + [("s", 2, "another text ab of the same id")]
    needles = [("s", i, " ".join(word() for _ in range(rng.randint(1, 2)))) for i in range(150)] + [("s", 150, ""), ("s", 151, "ab"), ("s", 152, "ab")]
    assert run(spark, needles, docs) == brute(needles, docs)


def test_also(spark):
    n = spark.createDataFrame([("s", 1, "Ann", ["1200", "x"]), ("s", 2, "bob", None), ("s", 3, "Ann", [None, "zzz"])], "s string, n int, x string, v array<string>")
    d = spark.createDataFrame([("s", 1, "ann has 1,200"), ("s", 2, "ANN and Bob")], "s string, d int, t string")
    out = contains_pairs(n, d, scope=["s"], needle_id="n", needle="x", doc_id="d", text="t", also="v")
    assert sorted(tuple(r) for r in out.collect()) == [("s", 1, 1, True), ("s", 1, 2, False), ("s", 2, 2, False), ("s", 3, 1, False), ("s", 3, 2, False)]


def test_few_candidates_are_searched_without_python(spark):
    n = spark.createDataFrame([("s", 1, "Ann#07"), ("s", 2, "n#0"), ("s", 3, "--"), ("t", 4, "Ann")], "s string, n int, x string")
    d = spark.createDataFrame([("s", 1, "saw xANN#07y, 1,5"), ("s", 2, "a -- b"), ("s", 2, "ann#07"), ("t", 3, "an n")], "s string, d int, t string")
    out = contains_pairs(n, d, scope=["s"], needle_id="n", needle="x", doc_id="d", text="t")
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.n, r.d) for r in out.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2)]
