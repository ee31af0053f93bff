"""Fill-in-the-middle beside string slicing, and back again."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from engramlake.llm import infill

PARTS = ["a", "<", "P", ">", "S", "M", "é", "漢", "😀", " ", "\n", "<M"]


def plain(text, i, j, form):
    p, m, s = text[:i], text[i:j], text[j:]
    return {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]


def test_rotations_exchange_and_restore():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))
        if any(s in text for s in ("<P>", "<S>", "<M>")):
            continue
        i, j = sorted((r.randint(0, len(text)), r.randint(0, len(text))))
        for form in ("psm", "spm", "plain"):
            out = infill.infill(text.encode(), i, j, form)
            assert out.decode() == plain(text, i, j, form)
            assert infill.restored(out, form).decode() == text


@pytest.mark.parametrize("scan", [1, 3, 1 << 20])
def test_offsets_over_several_scans(monkeypatch, scan):
    monkeypatch.setattr(infill, "_SCAN", scan)
    text = "aé漢😀b" * 3
    assert [infill.offset(text.encode(), i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]


def expected(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text, text)
    form = "spm" if h4 % 100 < 20 else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return (i, n, form, a, b - a, plain(text, a, b, form), text)


def test_whole_tables(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randint(0, 40)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "has <S> in it"), (None, "no id"), (None, None), rows[7], (7, "another text"), (303, "long é " * 300_000)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, output string, n int")
    got = infill.restore(infill.transform(df)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[5])
    assert sorted((tuple(x) for x in got), key=key) == sorted((expected(*x) for x in rows), key=key)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert infill.restore(infill.transform(df.limit(0))).count() == 0
    back = infill.restore(spark.createDataFrame([(None, "psm", "x"), ("a", None, "x")], "output string, form string, restored string"))
    assert back.columns == ["output", "form", "restored"] and back.where(F.col("restored").isNotNull()).count() == 0
