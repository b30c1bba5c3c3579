import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import mixing, packing, queries

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def fill(sizes, most=3):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values())
    target, full = {}, set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: most * sizes[s] if s in full else rest * weight[s] / max(1, sum(weight[x] for x in free)) for s in order}
        above = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not above:
            return target
        full |= set(above)


def mixed(docs):
    sizes = docs.select("doc_id", "source", mixing.words(docs["text"]).alias("size"))
    return mixing.with_copies(sizes, mixing.targets(sizes)).selectExpr("doc_id", "source", "size", "_mix.source_size", "_mix.target", "_mix.copies").collect()


@pytest.mark.parametrize("sources", [("a", "b", None), ("z", "é", "Z", "aa", "b", "c", "d")])
def test_targets(docs, prose, sources):
    texts = [prose(1 + (i * 37) % 200, i) if i % 11 else None for i in range(150)]
    rows = mixed(docs(texts, sources))
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        assert r["size"] == len((texts[r.doc_id] or "").split())
    want = fill(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size
        assert r.copies in (int(rate), int(rate) + 1) and 0 <= r.copies <= 3
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert rows == mixed(docs(texts, sources))


def test_mix_rows(docs, prose):
    d = docs([prose(20, i) for i in range(60)])
    copies = {r.doc_id: r.copies for r in mixed(d)}
    out = mixing.mix(d)
    assert out.columns == d.columns
    counted = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counted == {k: c for k, c in copies.items() if c}
    assert mixing.mix(d.limit(0)).count() == 0
    assert mixing.mix(docs([None, ""])).count() == 0
    assert mixing.mix(docs(["a b", "a b"], ids=[None, None], sources=("s",))).count() == 2


def test_lengths_fill_gaps():
    runs = packing.plan({4000: 2, 96: 1, 50: 1, 46: 1, 3000: 1, 1000: 1, 90: 1, 6: 1}, 4096)
    used = {}
    for n, _, times, first, _ in runs:
        for k in range(times):
            used[first + k] = used.get(first + k, 0) + n
    assert sorted(used.values()) == [4096, 4096, 4096]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=25))
def test_plan_is_whole(counts):
    runs = packing.plan(counts, 60)
    ranks, spans = {}, {}
    for n, rank, times, first, offset in runs:
        for k in range(times):
            ranks.setdefault(n, []).append(rank + k)
            spans.setdefault(first + k, []).append((offset, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for parts in spans.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 60
    least = max(-(-sum(n * c for n, c in counts.items()) // 60), sum(c for n, c in counts.items() if n > 30))
    assert least <= len(spans) <= 1.5 * least + 1


TEXTS = ["Hello world it's 2024!", "HELLO  World", None, "", " \n", "é à Ça ß 日本語 <|endoftext|> x<|startoftext|>", "don't we'll I'd you're", "a" * 3000, "Σίσυφος ÉÀ İ ﬁ", "x y z \x1c q", "é café", "1234 12,5%"]


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_and_sequences(docs, prose):
    texts = TEXTS + [prose(3000, 1), prose(900, 2)] + [prose(40 * i, i) for i in range(1, 12)]
    rows = packing.pack(docs(texts), PATH, most=512).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = ids_of(t)
        for p, s in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[s : s + 512], "<u4")
            want[i, p] = (s, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 512) + 1


def test_repeated_and_no_rows(docs):
    assert packing.pack(docs([]).limit(0), PATH).count() == 0
    out = packing.pack(docs(["a b"] * 5, ids=[1, 1, 1, None, None]), PATH).collect()
    assert len(out) == 5 and len({(r.sequence_id, r.offset) for r in out}) == 5 and len({r.sequence_id for r in out}) == 1


def test_cache_limits(monkeypatch):
    monkeypatch.setattr(packing, "SLOTS", 2)
    monkeypatch.setattr(packing, "IDS", 2)
    enc = packing.WordIds(PATH)
    from sluice.llm.common import text_bytes

    for text in ("one two three", "four five", "one two three"):
        ids, at = enc.encode(*text_bytes(pa.array([text])))
        assert ids.tolist() == ids_of(text)[:-1] and at.tolist() == [0, len(ids)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAzß'ÀÿÖ×÷0123 <|>.,!-\n\t\x01\x02\x1c\x7f\x85\xa0éİſﬁ日s"), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_any_letters(texts):
    from sluice.llm.common import text_bytes

    enc = packing.word_ids(PATH)
    ids, at = enc.encode(*text_bytes(pa.array([*texts, *texts], pa.string())))
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [enc.whole.encode(t, add_special_tokens=False).ids for t in [*texts, *texts]]


def test_many_equal_lengths(docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 7)
    monkeypatch.setattr(packing, "RUNS", 0)
    rows = packing.pack(docs(["a b c"] * 60 + ["a"] * 25), PATH, most=10).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 85 and sorted(r.doc_id for r in rows) == list(range(85))
    for parts in spans.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert len(spans) == 30


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_op5_sql(spark, duck):
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cursor = duck.execute(queries.OP5_SQL)
    names = [d[0] for d in cursor.description]
    got = queries.op5_mixing(spark, "/root/testdata/sf0.001").select(names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())
