"""One row of each component of near-duplicates stays."""

from collections import Counter

from engramlake.llm import simhash


def test_each_component_keeps_one_row_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    # b is a copy of document 2; a's group has 5 as its smallest id; c shares an id with a later member of a's group
    rows = [(5, a, 1), (8, a, 2), (9, a, 3), (5, b, 4), (2, b, 5), (8, c, 6), (8, c, 7), (None, c, 8), (5, c + " x y z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    part = {}
    for r, f in zip(df.collect(), simhash.fingerprints(df).collect(), strict=True):
        part.setdefault(f.fp, []).append((r.doc_id, r.text))
    assert len(part) == 4
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert kept == Counter([(5, a), (2, b), (8, c), (5, c + " x y z"), (None, c)])
