import collections
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import image_descriptors as im
from sluice.llm import suffix_tree as st


def png(pixels, filters=(0, 1, 2, 3, 4)):
    """A PNG whose lines use all filters in turn."""
    h, w = pixels.shape[:2]
    depth = 1 if pixels.ndim == 2 else pixels.shape[2]
    lines, above = b"", np.zeros(w * depth, np.int64)
    for y in range(h):
        line, how = pixels[y].reshape(-1).astype(np.int64), filters[y % len(filters)]
        left, corner = np.concatenate([np.zeros(depth, np.int64), line[:-depth]]), np.concatenate([np.zeros(depth, np.int64), above[:-depth]])
        near = left + above - corner
        d = np.abs(np.stack([near - left, near - above, near - corner]))
        paeth = np.choose(d.argmin(0), [left, above, corner])
        guess = [np.zeros_like(line), left, above, (left + above) // 2, paeth][how]
        lines += bytes([how]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[depth], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_decoding():
    grey = im.drawn(np.arange(5.0), 20)
    assert np.array_equal(im.decode(im.pgm(grey)), grey) and np.array_equal(im.decode(png(grey)), grey)
    colour = np.stack([grey] * 3, 2)
    assert np.abs(im.decode(png(colour)).astype(int) - grey).max() <= 1
    for bad in (None, b"", b"P5", b"P5 9 9 255\nxx", b"\x89PNG\r\n\x1a\n", b"\x89PNG\r\n\x1a\n" + b"\0" * 30, b"GIF89a", png(grey)[:60]):
        assert im.decode(bad) is None


def test_copies(spark):
    rng = np.random.default_rng(5)
    pictures = [im.drawn(rng.normal(size=8)) for _ in range(30)]
    rows = [(i, im.pgm(p)) for i, p in enumerate(pictures)]
    rows += [(100 + 10 * i + k, im.pgm(im.edited(pictures[i], k))) for i in range(6) for k in range(5)]
    rows += [(300, png(pictures[7])), (301, None), (302, b""), (303, b"text"), (304, im.pgm(np.full((40, 40), 9))), (305, im.pgm(np.full((40, 40), 9))), (306, im.pgm(np.zeros((1, 1)))), (None, im.pgm(pictures[0]))]
    media = spark.createDataFrame(rows, "media_id long, bytes binary").selectExpr("*", "media_id AS digest")
    out = {r.media_id: r for r in im.copies(media).collect()}
    assert len(out) == len(rows)
    for i in range(6):
        assert {out[100 + 10 * i + k].component_id for k in range(5)} == {i}
    assert all(out[i].component_id == i for i in range(30)) and all(out[i].n_links == 0 for i in range(8, 30))
    assert out[300].component_id == 7 and out[305].component_id == 304
    assert [out[i].component_id for i in (301, 302, 303)] == [301, 302, 303] and out[None].component_id is None
    assert im.copies(media.limit(0)).count() == 0


def test_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(im, "LIST", 4)
    picture = im.drawn(np.arange(8.0))
    rows = [(i, im.pgm(np.clip(picture * (0.8 + 0.004 * i) + i / 3, 0, 255))) for i in range(40)]
    out = im.copies(spark.createDataFrame(rows, "media_id long, bytes binary")).collect()
    assert {r.component_id for r in out} == {0}


@pytest.mark.parametrize("n", [30, 50])
def test_links_on_long_lists(spark, monkeypatch, n):
    """Copies that differ in one pixel at the edge: each is linked with all others, however many they are and however they are dealt."""
    monkeypatch.setattr(im, "BLOCK", 20_000)
    rows = []
    for i in range(n):
        picture = im.drawn(np.arange(8.0))
        picture[0, i] = 255 - picture[0, i]
        rows.append((i, im.pgm(picture)))
    out = im.copies(spark.createDataFrame(rows, "media_id long, bytes binary")).collect()
    assert {r.component_id for r in out} == {0} and {r.n_links for r in out} == {n - 1}


def test_recall_against_brute_force():
    """Of the copies that a comparison of all descriptors (NEAR bits apart at most) links, nearly all are found, and no others."""
    rng = np.random.default_rng(3)
    pictures = [im.drawn(rng.normal(size=8)) for _ in range(30)]

    def block(images, first):
        records = [next(im._described(im.tests())(iter([pa.record_batch([pa.array([0]), pa.array([im.pgm(p)], pa.binary())], names=["id", "bytes"])])))["features"][0] for p in images]
        return im._Block(pa.table({"rep": pa.array(range(first, first + len(images)), pa.int64()), "features": pa.array(records, pa.binary())}))

    def brute(x, y, k):
        i, j = (np.arange(b.first[k], b.first[k + 1]) for b in (x, y))
        a, b = np.nonzero(np.bitwise_count(x.words[i][:, None] ^ y.words[j][None]).sum(2) <= im.NEAR)
        return len(a) > 0 and len(im._agreeing(x, y, i[a], j[b], np.zeros(len(a), np.int64), im.CONFIRM)) > 0

    edits = [lambda p: np.clip(p + rng.integers(-10, 11, p.shape), 0, 255).astype(np.uint8), lambda p: p[10:60, 12:62], lambda p: p // 16 * 16 + 8]
    edits += [lambda p, s=s: np.rint(im._resized(p.astype(np.float64), s)).astype(np.uint8) for s in (0.75, 0.85, 1.3)]
    x = block(pictures, 0)
    for edit in edits:
        y = block([edit(p) for p in pictures], 1000)
        want = {k for k in range(30) if brute(x, y, k)}
        i, j = im._linked(x, y, False, im.VOTES)
        found = {int(k) for k in i[i == j]}
        assert (i == j).all() and len(want) > 24 and len(found & want) >= 0.9 * len(want)


def test_corners_by_area():
    """A quarter of a large picture keeps as many corners as a picture of its own."""
    large = np.block([[im.drawn(np.arange(k, k + 8.0)) for k in (0, 9)], [im.drawn(np.arange(k, k + 8.0)) for k in (18, 27)]])
    places = im.features(large, im.tests())
    assert ((places["x"] < 72 * im.GRAIN) & (places["y"] < 72 * im.GRAIN)).sum() >= 20 and len(im.features(large[:72, :72], im.tests())) > 40 and len(places) > 160


def test_bits_are_balanced():
    """On pictures that the tests were not chosen on, bits are as often set as not, and descriptors differ."""
    rng = np.random.default_rng(99)
    words = np.concatenate([im.features(im.drawn(rng.normal(size=8)), im.tests())["words"] for _ in range(40)])
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
    a, b = (rng.integers(0, len(bits), 20_000) for _ in range(2))
    assert np.abs(bits.mean(0) - 0.5).max() < 0.15 and ((bits[a] != bits[b]).sum(1) <= im.NEAR).mean() < 0.01


def words(t):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]


@pytest.fixture(scope="module")
def scored(docs, prose):
    texts = [prose(5 + (i * 13) % 150, i, 40) for i in range(120)] + [None, "", " \n ", "Ünïcödé 日本 A a", "new unseen words qqq"]
    return texts, {r.doc_id: r for r in st.scored(docs(texts)).collect()}


def test_base(scored):
    texts, rows = scored
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    counts = collections.Counter(w for i, t in enumerate(texts) if not held[i] for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens, r = [*words(t), None], rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens))


def test_rare_words_are_joined(docs, scored, monkeypatch):
    monkeypatch.setattr(st, "TOP", 5)
    texts, rows = scored
    for r in st.scored(docs(texts)).collect():
        assert (r.n_known, r.base_score) == (rows[r.doc_id].n_known, pytest.approx(rows[r.doc_id].base_score))


def plain_score(tree, text):
    """Symbol by symbol, by the definition."""
    data = list(b" ".join(words(text))) + [256]
    past, out = [63] * 5, 0.0
    for b in data:
        s = int(tree.symbol_of[b])
        state = 0
        for d in range(tree.depth, -1, -1):
            code = sum(x << 6 * k for k, x in enumerate(past[:d]))
            if (d, code) in tree.index:
                state = tree.index[d, code]
                break
        out += float(tree.log10[state, s]) + tree.other[b]
        past = [s, *past][:5]
    return out


def test_tree(docs, scored, spark):
    texts, rows = scored
    train = docs(texts).where(~st.held_out("doc_id")).select("text")
    grams = train.mapInArrow(st._count, "kind byte, key long, n long").where("kind = 1").groupBy("key").sum("n").withColumnRenamed("sum(n)", "n")
    tree = st.learn(grams)
    assert np.allclose((10 ** tree.log10.astype(float)).sum(1), 1, atol=1e-4)
    rest = tree.other[tree.symbol_of == 62]
    assert (10**rest).sum() == pytest.approx(1) and {d for d, _ in tree.order} == {0, 1, 2, 3, 4, 5}
    for i in (0, 1, 7, 120, 121, 122, 123, 124):
        assert rows[i].score == pytest.approx(plain_score(tree, texts[i]), rel=1e-5)
    held = [r for r in rows.values() if r.held_out]
    flat = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / flat > sum(len(b" ".join(words(texts[r.doc_id]))) + 1 for r in held) * math.log10(1 / 64) / flat


def byte_runs(df):
    return df.select("text").mapInArrow(st._count, "kind byte, key long, n long").where("kind = 1").groupBy("key").sum("n").withColumnRenamed("sum(n)", "n")


def test_contexts_by_definition(docs, prose):
    """The contexts that pass the test, and no others, with the counts of their next symbols."""
    texts = [prose(5 + (i * 13) % 150, i, 40) for i in range(40)] + [None, "", "aa aab aac " * 30]
    tree, counts = st.learn(byte_runs(docs(texts))), collections.defaultdict(collections.Counter)
    for t in texts:
        past = [63] * 5
        for b in [*b" ".join(words(t)), 256]:
            s = int(tree.symbol_of[b])
            for d in range(6):
                counts[tuple(past[:d])][s] += 1
            past = [s, *past][:5]
    want, near = set(), set()
    for c, n in counts.items():
        if c:
            up = counts[c[:-1]]
            bits = sum(x * math.log2(x / n.total() * up.total() / up[s]) for s, x in n.items())
            (near if abs(bits - st.FLOOR) < 1e-6 else want if bits > st.FLOOR else set()).add((len(c), sum(x << 6 * k for k, x in enumerate(c))))
    assert want <= set(tree.order) <= want | near | {(0, 0)} and {d for d, _ in want} == {1, 2, 3, 4, 5}


def test_few_queries(docs, scored, spark, monkeypatch):
    """A tree takes one query, as each plan takes some of the driver's memory."""
    monkeypatch.setattr(st, "STATES", 60)
    texts, _ = scored
    grams = byte_runs(docs(texts)).localCheckpoint()
    n, made = st.trees(grams)
    assert n > 3
    spark.sparkContext.setJobGroup("trees", "trees")
    try:
        assert len([next(made) for _ in range(3)]) == 3
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("trees")) <= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_parts_and_groups():
    """However runs are dealt into batches, the same contexts are chosen."""
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 4, (300_000, 6)) @ (1 << 6 * np.arange(6))[::-1])
    n, pairs = rng.integers(1, 2000, len(keys)), np.zeros(1 << 18, np.int64)
    np.add.at(pairs, keys >> 24 << 6 | keys & 63, n)
    keys, n = np.repeat(keys, 60), np.repeat(n, 60)  # sums of 60 rows

    def chosen(size):
        batches = (pa.record_batch([pa.array(keys[i : i + size]), pa.array(n[i : i + size])], names=["run", "n"]) for i in range(0, len(keys), size))
        return sorted((r["d"], r["turned"], r["upto"], tuple(r["s"]), tuple(r["n"])) for b in st._chosen(pairs * 60)(batches) for r in b.to_pylist())

    whole = chosen(len(keys))
    assert len(whole) > 100 and {r[0] for r in whole} == {3, 4, 5} and chosen(977) == whole


def test_model_is_bounded(docs, prose, monkeypatch):
    monkeypatch.setattr(st, "STATES", 20)
    df = docs([prose(200, 1, 30)])
    grams = df.select("text").mapInArrow(st._count, "kind byte, key long, n long").where("kind = 1").groupBy("key").sum("n").withColumnRenamed("sum(n)", "n")
    assert 1 < len(st.learn(grams).order) <= 21


def test_all_contexts_count(docs, scored, monkeypatch):
    """However few contexts a tree holds, all that pass are kept and the scores stay the same."""
    texts, rows = scored
    monkeypatch.setattr(st, "STATES", 60)
    monkeypatch.setattr(st, "HELD", 2)
    used = []
    monkeypatch.setattr(st, "_part", lambda numbered, held, f=st._part: used.extend(len(t.order) for t in held) or f(numbered, held))
    for r in st.scored(docs(texts)).collect():
        assert r.score == pytest.approx(rows[r.doc_id].score, rel=1e-6)
    assert used and max(used) <= 61


def test_odd_tables(docs):
    assert st.scored(docs([]).limit(0)).count() == 0
    out = st.scored(docs(["a b", "a b", None], ids=[1, 1, None])).collect()
    assert len(out) == 3 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    only_held = st.scored(docs(["a b"], ids=[next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)])).first()
    assert (only_held.train_tokens, only_held.n_known, only_held.base_score) == (0, 0, 0.0)
