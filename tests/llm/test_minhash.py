import random
import re

import pytest

from sluice.llm import minhash
from sluice.llm.components import components


def brute(texts, n, percent=80):
    sets = []
    for t in texts:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def edited(text, rng, k):
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(prose, size=120, family=60):
    rng = random.Random(4)
    texts = [prose(rng.randrange(1, 120), i) for i in range(size)]
    texts += [edited(texts[i], rng, rng.randrange(0, 6)) for i in range(0, size, 3)]
    base = prose(100, 999)
    texts += [edited(base, rng, rng.randrange(0, 12)) for _ in range(family)]  # more than a short list holds
    short = prose(5, 77)
    texts += [short, short, " ".join(short.split()[:-1]), "one two", "One  TWO", "one", "one", "", None, " \n", base + " " + base]
    return texts


@pytest.mark.parametrize("n", [2, 5])
def test_equals_brute_force(docs, prose, n):
    texts = corpus(prose)
    out = {r.doc_id: r for r in minhash.near_duplicates(docs(texts), n=n).collect()}
    assert [(out[i].n_shingles, out[i].component_id) for i in range(len(texts))] == brute(texts, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.values())


def test_long_lists_by_blocks(docs, prose, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", 2)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1 << 14)
    texts = corpus(prose, 30, 40)
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(texts), n=2).collect()}
    assert [out[i] for i in range(len(texts))] == [c for _, c in brute(texts, 2)]


def test_odd_rows(docs, prose, spark):
    assert minhash.near_duplicates(docs([]).limit(0)).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(docs(["a b c", None]), n=2).orderBy("doc_id").collect()] == [(0, 2, 0, True), (1, 0, 1, True)]
    text, other = prose(50, 1), prose(50, 2)
    rows = docs([text, text, other, other, text], ids=[7, None, 3, 7, 9])  # id 7 has two texts: one node; no id: linked with nothing
    out = sorted((tuple(r) for r in minhash.near_duplicates(rows, n=2).collect()), key=repr)
    assert [(r[0], r[2], r[3]) for r in out] == [(3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False), (None, None, True)]
    again = docs([text, text], ids=[5, 5])
    assert [(r.doc_id, r.kept) for r in minhash.near_duplicates(again).collect()] == [(5, True), (5, True)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)], "a long, b long")
    out = {r.node: r.component for r in components(links).collect()}
    assert {out[i] for i in range(61)} == {0} and out[100] == out[150] == out[200] == 100
