"""q_text_match against a comparison of all phrases with all texts, and how often it reads the texts."""

import random
import re

from engramlake import session
from engramlake.operators import questions as C

SIGNS = ".,;:!?()\"'"


def by_hand(rows):
    found = set()
    texts = [(w, e, t.lower()) for w, e, t in rows if None not in (w, e, t) and len(t) > 20]
    phrases = {}
    for w, e, t in texts:
        words = [x.strip(SIGNS) for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]
        own = [x for x in words if len(x) > 4] + [f"{a} {b}" for a, b in zip(words, words[1:]) if len(a) > 2 and len(b) > 2]
        for p in own:
            phrases.setdefault((w, p), set()).add(e)
    for (w, p), users in phrases.items():
        holders = {e for v, e, t in texts if v == w and p in t}
        if len(holders) == 1 and holders == users:
            found.add((w, p, holders.pop()))
    return found


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(3, 14)):
            word = "".join(r.choice("abAB") for _ in range(r.randint(1, 7)))
            word = r.choice(["", "", "", "'", "(", "-", "..."]) + word + r.choice(["", "", "", ".", ",", "'s", "!)", "-x", "é"])
            parts += [word, r.choice([" ", " ", " ", "  ", "\n", " \t", "\xa0"])]
        rows.append((r.choice([1, 1, 2, None]), None if i % 17 == 0 else i // 2, r.choice(["", " "]) + "".join(parts)))
    return [*rows, (1, 3, None), (1, 5, "short one here"), (2, 4, "..., !!! ??? (( )) ... ,,,"), (2, 4, "singletokenofmanyletters")]


def test_same_as_by_hand(spark):
    rows = made(120, 3)
    d = spark.createDataFrame(rows, "world_id int, entity long, text string")
    got = [(r.world_id, r.phrase, r.answer) for r in C.q_text_match(d, ["world_id"], "entity", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows) and len(got) > 200


def test_names_as_entities_and_no_texts(spark):
    rows = [(w, None if e is None else f"e{e}", t) for w, e, t in made(40, 8)]
    d = spark.createDataFrame(rows, "world_id int, entity string, text string")
    assert {(r.world_id, r.phrase, r.answer) for r in C.q_text_match(d, ["world_id"], "entity", "text").collect()} == by_hand(rows)
    assert C.q_text_match(d.where("false"), ["world_id"], "entity", "text").count() == 0


def test_texts_are_read_once(spark, monkeypatch):
    d = session.materialise(spark.createDataFrame(made(30, 1), "world_id int, entity long, text string"), "some-texts")
    plans = []
    kept = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, purpose: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, purpose))
    out = C.q_text_match(d, ["world_id"], "entity", "text")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("some-texts-") for p in plans) == 1
