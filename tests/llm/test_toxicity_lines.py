import numpy as np
import pandas as pd
import pytest

from sluice.llm import log_templates, toxicity
from sluice.llm.common import spans as real

BAD = ["grub", "oaf", "louse", "cad"]


@pytest.fixture(scope="module")
def labelled(spark, docs, prose):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(400):
        words, toxic, junk = prose(60, i).split(" "), i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), BAD[int(rng.integers(0, 4))] + ",")
        texts.append(" ".join(words).upper() + " !!!" * 20 if junk else " ".join(words))
        labels.append((i, int(junk), int(toxic), None))
    return docs(texts), spark.createDataFrame(labels + [(0, 0, 1, None), (401, None, 1, None), (402, 0, None, None), (None, 1, 1, None)], "doc_id long, junk int, toxic int, text string"), texts


def test_chain(labelled, docs):
    table, labels, texts = labelled
    chain = toxicity.train(table, labels, ("junk", "toxic"))
    assert {toxicity.key(w) for w in BAD} <= set(chain.vocabulary.tolist()) and chain.models[1].dense.shape[0] == chain.models[0].dense.shape[0] + 1
    out = {r.doc_id: r for r in toxicity.scored(table, chain).collect()}
    right = np.mean([out[i]["_toxic"] == (i % 5 == 0) for i in range(400)])
    assert right > 0.98 and np.mean([(out[i]["_p"][0] > 0.5) == (i % 7 == 0) for i in range(400)]) > 0.98
    fresh = docs(["some new words and a Grub! here, LOUSE", "some new words", None, "", "x " * 50_000 + "oaf cad grub"])
    found = {r.doc_id: r["_toxic"] for r in toxicity.scored(fresh, chain).collect()}
    assert found == {0: True, 1: False, 2: False, 3: False, 4: True}
    clean = toxicity.scored(fresh, chain, keep="clean")
    assert clean.columns == fresh.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 3]
    assert toxicity.scored(fresh.limit(0), chain, keep="clean").count() == 0


def test_features(monkeypatch):
    import pyarrow as pa

    texts = ["Grubs, oaf! 'oaf' (Émile) word", None, "", "... !!", "oaf " * 30 + "lousy " * 30 + "éclairs end"]
    vocabulary = np.sort(np.array([toxicity.key("oaf"), toxicity.key("grub", stem=True), toxicity.key("écla", stem=True), toxicity.key("zzz")], np.uint64))

    def seen():
        rows, columns, form = toxicity._features(pa.array(texts), vocabulary)
        return sorted(zip(rows.tolist(), vocabulary[columns].tolist(), strict=True)), form

    pairs, form = seen()
    assert pairs == sorted([(0, toxicity.key("oaf")), (0, toxicity.key("grub", stem=True)), (4, toxicity.key("oaf")), (4, toxicity.key("écla", stem=True))])
    first = texts[0].encode()
    assert form[0].tolist() == pytest.approx([1 / len(first), 6 / len(first), 0, 4 / len(first), np.log1p(len(first)), 4 / 5])
    assert form[4][5] == pytest.approx(4 / 62)
    monkeypatch.setattr(toxicity, "spans", lambda data, offsets: real(data, offsets, 24))
    again, same = seen()
    assert again == pairs and np.allclose(form, same)


def test_chain_by_hand():
    """The chain against plain logistic regressions, link by link."""
    rng = np.random.default_rng(4)
    n, width = 300, 12
    held = rng.random((n, width)) < 0.3
    form = rng.normal(size=(n, 6))
    first = (held[:, 0] | held[:, 1]).astype(int)
    second = (first & held[:, 2]).astype(int)
    table = pd.DataFrame({"id": range(n), "found": [np.flatnonzero(h).tolist() for h in held], "form": form.tolist(), "c0": first, "c1": second})
    chain = toxicity._chain(table, ("c0", "c1"), ("a", "b"), np.arange(width, dtype=np.uint64))
    rows, columns = np.nonzero(held)
    got = chain.probabilities(rows, columns, form)
    dense, before = np.clip((form - form.mean(0)) / (form.std(0) + 1e-9), -2, 2), []
    for i in range(n):
        x, p = dense[i], []
        for m in chain.models:
            z = m.words[held[i]].sum() + np.concatenate([x, [np.log(q / (1 - q)) / 4 for q in p]]) @ m.dense + m.bias
            p.append(min(max(1 / (1 + np.exp(-z)), 1e-6), 1 - 1e-6))
        before.append(p)
    assert np.allclose(got, before)
    assert ((got[:, 1] >= chain.threshold) == second).mean() > 0.97


def test_clashing_names_and_repeated_ids(spark, docs):
    table = docs(["bad grub"] * 8 + ["good"] * 8, ids=[0] * 4 + [1] * 4 + [2] * 4 + [3] * 4).selectExpr("*", "1 AS _p", "'x' AS _toxic", "2 AS x0", "3 AS id", "4 AS c0", "5 AS _id")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    out = toxicity.scored(table, toxicity.train(table, labels, ("toxic",)))
    assert out.columns == [c for c in table.columns if c not in ("_p", "_toxic")] + ["_p", "_toxic"] and out.count() == 16
    assert toxicity.scored(table, toxicity.train(table, labels, ("toxic",)), keep="clean").columns == table.columns


def test_three_links(labelled):
    table, labels, _ = labelled
    more = labels.withColumn("both", labels.junk * labels.toxic)
    chain = toxicity.train(table, more, ("junk", "toxic", "both"), sample=300)
    out = {r.doc_id: r["_p"] for r in toxicity.scored(table, chain).collect()}
    assert np.mean([(out[i][2] > 0.5) == (i % 35 == 0) for i in range(400)]) > 0.97


def test_nothing_to_learn(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.train(docs(["a b"]), none, ("toxic",))
    assert [r["_toxic"] for r in toxicity.scored(docs(["a b", None]), chain).collect()] == [False, False]
    same = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, toxic int")
    assert not any(r["_toxic"] for r in toxicity.scored(docs(["a", "b"]), toxicity.train(docs(["a", "b"]), same, ("toxic",))).collect())


def by_hand(texts, least=4):
    """Exact-line dedup with digit words as one, first occurrence kept; lines of one document only are left."""
    holders, out = {}, []
    keys = [[tuple("<*>" if any(c.isdigit() for c in w) else w for w in line.split()) for line in (t or "").split("\n")] for t in texts]
    for i, k in enumerate(keys):
        for x in k:
            holders.setdefault(x, set()).add(i)
    seen = set()
    for i, t in enumerate(texts):
        kept = []
        for line, x in zip((t or "").split("\n"), keys[i], strict=True):
            if len(x) >= least and len(holders[x]) > 1:
                if x in seen:
                    continue
                seen.add(x)
            kept.append(line)
        out.append(None if t is None else "\n".join(kept))
    return out


def letters(k):
    return "".join(chr(97 + int(c)) for c in str(k))


def test_lines(docs, prose):
    def line(i, n=9):
        return " ".join(letters(w[1:].replace("q", "")) for w in prose(n, i).replace("x", "w").split(" "))

    texts = ["\n".join([line(3 * i), "shared words in all documents here", line(3 * i + 1, 14), f"visit number {i} of user{i} today please", "short one", ""]) for i in range(40)]
    texts += [texts[3], None, "", "\n\n", "own line twice in here\nown line twice in here", "a b c d e\r"]
    out = log_templates.clean(docs(texts))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*docs(texts).columns, "_lines"]
    assert [rows[i].text for i in range(len(texts))] == by_hand(texts)
    assert rows[40].text == "short one\n" and rows[40]["_lines"].n_dropped == 4 and rows[41]["_lines"].n_lines == 0


def test_variable_fields(docs):
    names = ["anna", "berta", "carl", "dora", "emil"]
    texts = [f"please contact our friendly support agent {n} for any further help with this product\nunique to document {letters(7 * i + 100)} alone" for i, n in enumerate(names)]
    rows = [r.text.split("\n") for r in log_templates.clean(docs(texts)).orderBy("doc_id").collect()]
    assert [len(r) for r in rows] == [2, 1, 1, 1, 1]


def test_hot_leaves_are_divided(docs, monkeypatch):
    monkeypatch.setattr(log_templates, "LEAF", 4)
    texts = [f"same three words then {letters(i)} {letters(i * 31)} {letters(i * 57)} {letters(i * 91)} end" for i in range(60)] + ["same three words then ba ba ba ba end"] * 2
    rows = log_templates.clean(docs(texts)).orderBy("doc_id").collect()
    assert [r["_lines"].n_dropped for r in rows] == [0] * 61 + [1]


@pytest.mark.parametrize("at", [1, 5, 9])
@pytest.mark.parametrize("n", [5, 5000])
def test_many_variants(docs, n, at):
    """A variable word is found in any field, whatever the number of variants."""
    words = "please contact our friendly support agent for any further help with".split()
    texts = [" ".join(words[:at + 2] + [letters(i)] + words[at + 3 :]) for i in range(n)]
    rows = log_templates.clean(docs(texts)).collect()
    assert [r.doc_id for r in rows if not r["_lines"].n_dropped] == [0]


def test_templates_do_not_depend_on_leaf(spark):
    rng = np.random.default_rng(8)
    rows = sorted({(7 * (i % 2), *(int(x) for x in rng.integers(0, 3, 8))) for i in range(600)})
    lines = spark.createDataFrame([(int(w), lead, fields) for w, (lead, *fields) in zip(rng.permutation(len(rows)), rows, strict=True)], "whole long, lead long, fields array<int>")
    small, large = ({tuple(r) for r in log_templates.templates(lines, leaf=k).collect()} for k in (10**6, 1))
    assert small == large and len(small) > 100


def test_line_edges(docs):
    assert log_templates.clean(docs([]).limit(0)).count() == 0
    twice = docs(["one two three four five"] * 2, ids=[1, 1])  # the same document twice: treated alike
    assert [r["_lines"].n_dropped for r in log_templates.clean(twice).collect()] == [0, 0]
    nulls = docs(["one two three four five"] * 2, ids=[None, 1])
    assert {r.doc_id: r["_lines"].n_dropped for r in log_templates.clean(nulls).collect()} == {1: 0, None: 1}
    long = " ".join(f"w{letters(i)}" for i in range(20_000))
    assert [r["_lines"].n_dropped for r in log_templates.clean(docs([long, long, long + " x"])).orderBy("doc_id").collect()] == [0, 1, 0]
