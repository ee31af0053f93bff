"""Byte-level BPE beside the tokenizer library, and back again."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from engramlake.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.vocabulary(PATH)), special_tokens={})


@pytest.mark.parametrize("block", [bpe.BLOCK_BYTES, 40])
def test_encode_and_decode(spark, library, block):
    r = random.Random(5)
    parts = ["the", " the", "  ", "\n", "'s", "'LL", "漢字", "é", "😀", "123", "٣", "!!", "<|endoftext|>", "\x00", "　", "ǅ", " Straße"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(200)]
    rows += [(200, None), (201, ""), (None, "no id"), (None, "no id"), rows[5], (5, "another text"), (202, "a" * 50_000), (203, " word" * 20_000)]
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], "doc_id long, text string, ids int, block string").repartition(3)
    encoded = bpe.encode(df, block_bytes=block)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=key)
    assert sorted(((x.id, x.ids) for x in encoded.collect()), key=key) == want
    back = bpe.decode(encoded).collect()
    assert sorted(((x.id, x.ids, bytes(x.decoded)) for x in back), key=key) == sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=key)


def test_edges(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert bpe.encode(df.limit(0)).count() == 0
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, None]), (4, [64, 50256]), (5, [64, -1]), (6, [64, 65])], "id long, ids array<int>")
    got = {x.id: (x.ids, x.decoded) for x in bpe.decode(odd).collect()}
    assert got == {1: (None, None), 2: ([], b""), 3: ([64, None], None), 4: ([64, 50256], None), 5: ([64, -1], None), 6: ([64, 65], b"ab")}
    broken = df.selectExpr("doc_id", "cast(unhex('61FF62') as string) text")
    assert bytes(bpe.decode(bpe.encode(broken)).first().decoded).decode() == "a�b"


def test_large_vocabulary_files_are_refused(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.vocabulary(PATH)


def test_packed_numbers():
    for numbers in ([], [0], [127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**32 - 1, 5]):
        assert bpe._unpacked(bpe._packed(np.array(numbers, np.uint32))).tolist() == numbers
