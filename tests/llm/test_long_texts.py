"""Texts that come in many spans give what they give in one."""

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import common, log_templates, minhash, suffix_tree

TEXTS = ["a b c d e f g h i j\nk l\n\nm n o p q  r s t u v w x y z 1 2 3 4 5 6 \n end", None, "", "word " * 40 + "\n" * 20, " " * 50 + "x" * 60 + " \n y", "short\n", "é à ü " * 30, " " * 200, "tail of it"]


@pytest.fixture(params=[3, 16, 40])
def short_spans(request, monkeypatch):
    for module in (log_templates, minhash, suffix_tree):
        monkeypatch.setattr(module, "spans", lambda d, o, most=request.param: common.spans(d, o, most))
    monkeypatch.setattr(log_templates, "_AT_ONCE", 5)


def column():
    return pa.array(TEXTS, pa.string())


def lines():
    return pa.Table.from_batches(log_templates._lines(iter([pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(range(len(TEXTS)), pa.int64()), column()], names=["doc_id", "th", "text"])]))).to_pylist()


def sets():
    return [s.tolist() for n in (1, 2, 5) for s in minhash.shingle_sets(column(), n)]


def counts():
    out = {}
    for b in suffix_tree._count(iter([pa.RecordBatch.from_arrays([column()], names=["text"])])):
        for kind, key, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out[kind, key] = out.get((kind, key), 0) + n
    return out


@pytest.fixture(scope="module")
def whole():
    return lines(), sets(), counts()


def test_same(whole, short_spans):
    assert (lines(), sets(), counts()) == whole


def test_symbols_of_long_texts(short_spans):
    """Each symbol comes once, with the symbols before it."""
    for text in TEXTS:
        want = [*" ".join((text or "").split()).lower().encode(), 256]
        got, before = [], []
        for _, _, symbols, _, held, _, _ in suffix_tree._read(*common.text_bytes(pa.array([text], pa.string()))):
            before.append((len(got), held.tolist()))
            got += symbols.tolist()
        assert got == want
        for at, held in before:
            assert held == ([256] * suffix_tree.DEPTH + want[:at])[at:][: suffix_tree.DEPTH] or held == ([256] * suffix_tree.DEPTH + want[:at])[-suffix_tree.DEPTH :]


def test_memory_of_one_very_long_text():
    """Some megabytes of one text: what is held at once beside the text stays a small multiple of it."""
    import tracemalloc

    text = pa.array([" ".join(f"w{k}" for k in np.random.default_rng(1).integers(0, 5000, 1_600_000))])
    for run in (lambda: list(suffix_tree._count(iter([pa.RecordBatch.from_arrays([text], names=["text"])]))), lambda: list(minhash.shingle_sets(text, 5)), lambda: list(log_templates._parse(*common.text_bytes(text)))):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200e6
