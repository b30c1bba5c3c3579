import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import common
from sluice.llm.minhash import shingle_sets

TEXT = st.text(alphabet="aAbB \t\n\x0b\x1cé日", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words(texts):
    data, offsets = common.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = common.word_bounds(data, offsets)
    got = [[bytes(data[s:e]) for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    flat = [w for x in got for w in x]
    hashes = common.word_hashes(data, starts, ends)
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (hashes[i] == hashes[j]) == (a.lower() == b.lower())


def test_long_words(monkeypatch):
    monkeypatch.setattr(common, "_PIECE", 8)
    monkeypatch.setattr(common, "_powers", None)
    texts = ["abcdefgh" * 5 + " x", "abcdefgh" * 5 + "i x", "x " * 30]
    data, offsets = common.text_bytes(pa.array(texts))
    starts, ends, first = common.word_bounds(data, offsets)
    h = common.word_hashes(data, starts, ends)
    assert h[0] != h[2] and h[1] == h[3] == h[4] == h[-1]


def test_shingles():
    sets = list(shingle_sets(pa.array(["a b c", "A  B\tc", "a", None, " ", "a b c a b"]), 2))
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 3]
    assert np.array_equal(sets[0], sets[1]) and np.isin(sets[0], sets[5]).all()
    one, two, other = shingle_sets(pa.array(["a b", "A B", "b a"]), 5)
    assert np.array_equal(one, two) and not np.array_equal(one, other)


def test_chunks_cover_all():
    offsets = np.array([0, 5, 5, 400, 401, 402])
    runs = list(common.chunks(offsets, 10))
    assert [i for a, b in runs for i in range(a, b)] == list(range(5))


def test_bitmap_filter(spark):
    df = spark.range(1000).withColumnRenamed("id", "x")
    ids = spark.range(0, 1000, 7)
    out = {r.x for r in common.maybe_in(df, "x", ids, "id", bits=16).collect()}
    assert {r.id for r in ids.collect()} <= out and len(out) < 300
    assert common.maybe_in(df, "x", ids.limit(0), "id").count() == 0


def test_long_texts_come_in_spans():
    texts = ["a b", "", "x" * 50 + " y " * 40 + "z" * 90, "q" * 300, " " * 70, "tail"]
    data, offsets = common.text_bytes(pa.array(texts))
    got = list(common.spans(data, offsets, 16))
    assert got[0][2] == 0 and got[-1][3] == len(data) and all(x[3] == y[2] for x, y in zip(got, got[1:]))
    for i, j, a, b in got:
        assert (j == i + 1 and offsets[i] <= a <= b <= offsets[j]) or (a, b) == (offsets[i], offsets[j])
        assert b == offsets[j] or common.SPACE[data[b]]
    assert sum(i == 2 for i, *_ in got) > 3 and sum(i == 3 for i, *_ in got) == 1
