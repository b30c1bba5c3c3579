import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import pii, queries
from sluice.llm.common import spans


@pytest.fixture(scope="module")
def field():
    return pii.train()


def plain_patterns(t):
    """The contract, word for word, by backtracking expressions."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+- (_%4é25", max_size=40))
def test_patterns(text):
    assert pii.patterns(text) == plain_patterns(text)


def test_long_texts_are_linear():
    for text in ("a" * 200_000 + " x", "1" * 200_000, "1." * 100_000, "@" * 100_000, "a@" * 60_000, "+1" * 100_000, "1 " * 100_000):
        pii.patterns(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_field_learns(field):
    rows = pii.labelled(200, seed=77)
    found = field.decode([w for w, _ in rows])
    pairs = [(pii.LABELS.index(a), b) for (_, labels), got in zip(rows, found, strict=True) for a, b in zip(labels, got.tolist(), strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.98
    assert sum(a == b for a, b in pairs if a) / sum(a > 0 for a, _ in pairs) > 0.95


def test_viterbi_against_all_paths(field):
    rng = np.random.default_rng(3)
    words = ["+1", "(017)", "555-7713", "token", "=", '"04dbebab91ab85687d33eeaaf9ac699e1188f962"', "1.2.3.4", "a@b.co", "4111", "1111", "plain"]
    for n in (1, 2, 3, 4):
        for _ in range(4):
            seq = [words[int(k)] for k in rng.integers(0, len(words), n)]
            (got,) = field.decode([seq])
            own = field.scores(np.array([field.number(w) for w in seq]))
            paths = np.array(list(itertools.product(range(len(pii.LABELS)), repeat=n)))
            total = field.first[paths[:, 0]] + own[np.arange(n), paths].sum(1) + field.step[paths[:, :-1], paths[:, 1:]].sum(1)
            assert total[(paths == got).all(1)][0] == pytest.approx(total.max(), abs=1e-6)


def test_gradient_step_by_step():
    """One step of training moves each weight the way that raises the likelihood, as differences say."""
    rows = [(["call", "555-1234", "now"], ["O", "B-phone", "O"]), (["from", "1.2.3.4"], ["O", "B-ip"])]

    def likelihood(f):
        out = 0.0
        for words, labels in rows:
            own = np.array([sum((f.unary[k][[f.names[x] for x in pii.shape(words[t - by]) if x in f.names]].sum(0) for k, by in enumerate(pii.PLACES) if 0 <= t - by < len(words)), np.zeros(len(pii.LABELS))) for t in range(len(words))])
            paths = np.array(list(itertools.product(range(len(pii.LABELS)), repeat=len(words))))
            total = f.first[paths[:, 0]] + own[np.arange(len(words)), paths].sum(1) + f.step[paths[:, :-1], paths[:, 1:]].sum(1)
            gold = [pii.LABELS.index(x) for x in labels]
            out += total[(paths == gold).all(1)][0] - np.log(np.exp(total).sum())
        return out

    doubled = [(w, x) for w, x in rows for _ in range(2)]
    values = [likelihood(pii.train(doubled, steps=n, rate=0.05, keep=0.0)) for n in (1, 5, 20, 60)]
    assert values == sorted(values) and values[-1] > -0.5


def test_calls_do_not_depend_on_each_other(field, monkeypatch):
    monkeypatch.setattr(pii, "REMEMBERED", 50)
    mine = [["write", f"a{k}.b@c{k}.org", "today"] for k in range(30)]
    others = [[f"q{k}", f"{k}"] for k in range(3000)]
    alone, together = field.decode(mine), field.decode(mine + others)
    assert [x.tolist() for x in alone] == [x.tolist() for x in together[:30]]
    assert [x.tolist() for x in field.decode(others)] == [x.tolist() for x in together[30:]]


def test_sequences(monkeypatch):
    text = "a b c d 1 é f g h i j k@l m  n o p 2 3 q r s t u v 4"
    data = np.frombuffer(text.encode(), np.uint8)
    want = [["c", "d", "1", "é", "f"], ["i", "j", "k@l", "m", "n", "o", "p", "2", "3", "q", "r"], ["u", "v", "4"]]
    assert [[text[s:e] for s, e in q] for q in pii._sequences(data)] == want
    for most in (2, 5, 9):
        monkeypatch.setattr(pii, "spans", lambda d, o, most=most: spans(d, o, most))
        assert [[text[s:e] for s, e in q] for q in pii._sequences(data)] == want


def test_find(spark, docs, field):
    texts = ["mail bob.x@site.com or call (555) 123-4567 now", "from 10.0.0.1 and 999.1.1.1", "card 4111 1111 1111 1111, no 4111111111111112 here", "é +49 170 1234567 end", None, "", "nothing 2024 v1.2.3", "x" * 10_000]
    rows = {r.doc_id: r.spans for r in pii.find(docs(texts), field).collect()}
    for i, t in enumerate(texts):
        assert [(pii.KINDS.index(s.kind), s.start, s.end) for s in rows[i] if s.base] == plain_patterns(t or "")
    assert [(s.kind, texts[0][s.start : s.end]) for s in rows[0] if not s.base] == [("phone", "(555) 123-4567")]
    assert [s.kind for s in rows[2]] == ["card"] and rows[6] == []
    secret = 'our token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"!! of commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 there'
    (row,) = pii.find(docs([secret]), field).collect()
    assert [(s.kind, s.start, s.end, s.base) for s in row.spans] == [("secret", 13, 53, False)]
    assert pii.find(docs(texts).limit(0), field).count() == 0
    assert pii.find(docs(["1.2.3.4"] * 3, ids=[1, 1, None]), field).count() == 3


def test_query(spark, docs, monkeypatch):
    texts = ["a@b.co 1.2.3.4 x@y.zz", "", None]
    monkeypatch.setattr(queries, "table", lambda s, d, n: docs(texts))
    rows = {r.doc_id: r for r in queries.op1_crf(spark, "").collect()}
    spans = "email:0:6,email:15:21,ip:7:14"
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == (2, 1, 0, 0)
    assert rows[0].spans == spans and rows[0].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert rows[2].base_sha256 == rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
