"""The URL models count every context exactly."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from engramlake.llm import urls


def plain_difference(text, tables):
    data, total = text.lower().encode(), 0.0
    for i in range(len(data)):
        p = [1 / 256, 1 / 256]
        for k in range(min(i, urls.ORDER) + 1):
            gram = data[i - k : i + 1]
            p = [(pairs[gram] + urls.STRENGTH * q) / (contexts[gram[:-1]] + urls.STRENGTH) for (pairs, contexts), q in zip(tables, p, strict=True)]
        total += math.log(p[1]) - math.log(p[0])
    return total / max(1, len(data))


def test_differences_beside_plain_counts(spark):
    rng = np.random.default_rng(1)
    rows = [("".join(chr(c) for c in rng.integers(33, 127, 60)) + ("é" if i % 9 == 0 else ""), int(i % 3 == 0)) for i in range(1500)]
    rows += rows[:5]
    tables = [(Counter(), Counter()), (Counter(), Counter())]
    for text, kind in rows:
        data = text.lower().encode()
        for i in range(len(data)):
            for k in range(min(i, urls.ORDER) + 1):
                tables[kind][0][data[i - k : i + 1]] += 1
                tables[kind][1][data[i - k : i]] += 1
    model = urls.fit(spark.createDataFrame(rows, "rest string, kind int"))
    texts = [rows[0][0], rows[1][0], rows[9][0], "example.org/a", "X", "", rows[2][0][:30] + rows[3][0][20:]]
    want = [plain_difference(t, tables) for t in texts]
    # all grams broadcast, and most of them joined
    for common in (urls.COMMON, 4):
        assert model.difference(pa.array(texts), common) == pytest.approx(want, abs=1e-8)
