"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over the presence of words, of word beginnings, and a few figures of the text's
form; each model also sees the probabilities of the categories before it, which in training are out-of-fold predictions, so
that later models learn from what earlier ones really know. The vocabulary is what separates the labelled classes: words
whose share of documents differs between a category's classes by more than Z standard errors.

The models are fitted on at most `sample` labelled documents (those with the least hash of the id); scoring covers every
document and its whole text. A document is rejected if the probability of the last category reaches the threshold that
gives the best F1 out of fold.

Null or empty text: no words, scored like any text. Very long texts are read span by span. Null or unknown labels: not used in
training. A category with one class only: its share. Repeated rows are scored each; repeated ids count once in training (of several
texts the one with the least hash, of several labels the greatest). Ties: words of equal weight enter the vocabulary by hash, a
probability equal to the threshold rejects. Empty tables: nothing is rejected. Other columns are kept or ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import SPACE, drop_stage, lean, mix, spans, stage, text_bytes, word_bounds, word_hashes

SAMPLE, FOLDS, Z, WORDS, MIN_DOCS, STEMS, LONGEST = 10_000, 5, 5.0, 2000, 4, (4, 5), 64
_STRIP = b".,;:!?\"'()[]{}<>#$%&*-_|~"


def _among(values) -> np.ndarray:
    return np.isin(np.arange(256), list(values))


#: Of a text's form: the shares of capitals, signs, digits and white space among its bytes.
_CLASSES = [_among(range(65, 91)), _among(_STRIP), _among(range(48, 58)), SPACE]
_SOLID = ~(_among(_STRIP) | SPACE)
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a letter
_IN_TEXT = np.uint64(44)


def _rank(marks: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts without the signs around them, A-Z in lower case, and the text of each; the same for their beginnings, which stand for all endings of a stem."""
    starts, ends, first = word_bounds(data, offsets)
    text, solid = np.repeat(np.arange(len(offsets) - 1), np.diff(first)), _SOLID[data]
    rank, at = _rank(solid), np.flatnonzero(solid)
    some = rank[ends] > rank[starts]
    text, starts, ends = text[some], at[rank[starts[some]]], at[rank[ends[some]] - 1] + 1
    begins = _FIRST[data]
    rank, at = _rank(begins), np.flatnonzero(begins)
    stems, of = [np.zeros(0, np.uint64)], [text[:0]]
    for n in STEMS:
        long = rank[ends] - rank[starts] > n
        stems.append(mix(word_hashes(data, starts[long], at[rank[starts[long]] + n]) + np.uint64(n)))
        of.append(text[long])
    short = ends - starts <= LONGEST
    words = word_hashes(data, starts, ends)
    words[~short] |= np.uint64(1)  # not in any vocabulary
    words[short] &= ~np.uint64(1)
    return words, text, np.concatenate(stems) & ~np.uint64(1), np.concatenate(of)


def key(word: str, stem: bool = False) -> int:
    """What stands for a word, or for a beginning, in vocabularies."""
    data = np.frombuffer(word.encode(), np.uint8)
    h = word_hashes(data, np.array([0]), np.array([len(data)]))
    return int((mix(h + np.uint64(len(word))) if stem else h)[0] & ~np.uint64(1))


@dataclass
class Model:
    """One link of the chain: weights of vocabulary words, form figures and earlier probabilities."""

    words: np.ndarray
    dense: np.ndarray
    bias: float


@dataclass
class Chain:
    categories: tuple[str, ...]
    vocabulary: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    models: list[Model]
    threshold: float

    def probabilities(self, rows: np.ndarray, columns: np.ndarray, form: np.ndarray) -> np.ndarray:
        """Documents x categories, from the vocabulary words (columns) that documents (rows) hold, and figures of their form."""
        dense, out = _standard(form, self.centre, self.scale), []
        for m in self.models:
            x = np.column_stack([dense, *[np.log(p / (1 - p)) / 4 for p in out]])
            z = np.bincount(rows, m.words[columns], len(form)) + x @ m.dense + m.bias
            out.append(np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6))
        return np.column_stack(out) if out else np.zeros((len(form), 0))


def _standard(form: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Figures in standard units, at most 2: a text of a form never seen is not judged by its form alone."""
    return np.clip((form - centre) / scale, -2, 2)


def _fit(rows: np.ndarray, columns: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, use: np.ndarray, ridge: float = 1.0, steps: int = 200) -> Model:
    """Logistic regression on sparse word marks and dense figures, by Adam with a ridge; use: the documents to learn from."""
    n, rate = max(1, int(use.sum())), 0.1
    share = float(np.clip(y[use].mean() if use.any() else 0.0, 1e-4, 1 - 1e-4))
    w, d, b = np.zeros(width), np.zeros(dense.shape[1]), float(np.log(share / (1 - share)))
    if len(np.unique(y[use])) < 2:
        return Model(w, d, b)
    on = use[rows]
    rows, columns = rows[on], columns[on]
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(d), np.zeros_like(d)], [np.zeros(1), np.zeros(1)]]
    for i in range(steps):
        z = np.bincount(rows, w[columns], len(y)) + dense @ d + b
        off = np.where(use, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0.0) / n
        grads = [np.bincount(columns, off[rows], width) + ridge * w / n, dense.T @ off + 10 * ridge * d / n, np.array([off.sum()])]
        moves = []
        for g, m in zip(grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            moves.append(rate * (m[0] / (1 - 0.9 ** (i + 1))) / (np.sqrt(m[1] / (1 - 0.99 ** (i + 1))) + 1e-9))
        w, d, b = w - moves[0], d - moves[1], b - float(moves[2][0])
    return Model(w, d, b)


def _vocabulary(texts: DataFrame, categories: tuple[str, ...]) -> np.ndarray:
    """Words and beginnings that separate the classes of some category among the sampled documents (text, categories): their keys, sorted."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            held: list[np.ndarray] = []
            for i, j, a, b in spans(data, offsets):
                words, of, stems, stems_of = _words(data[a:b], np.clip(offsets[i : j + 1], a, b) - a)
                known = (words & np.uint64(1)) == 0
                keys, text = np.concatenate([words[known], stems]), np.concatenate([of[known], stems_of])
                _, one = np.unique(mix(keys + text.astype(np.uint64)), return_index=True)
                keys, text = keys[one], text[one]
                if held or b < offsets[j]:  # a long text
                    held = [np.unique(np.concatenate([*held, keys]))]
                    if b < offsets[j]:
                        continue
                    keys, held = held[0], []
                    text = np.zeros(len(keys), np.int64)
                which = pa.array(text + i)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch.column(k + 1).take(which) for k in range(len(categories)))], names=["word", *(f"c{k}" for k in range(len(categories)))])

    schema = "word long, " + ", ".join(f"c{k} int" for k in range(len(categories)))
    shares = texts.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    counted = texts.select("text", *categories).mapInArrow(lean(split), schema).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(categories))]).where(F.col("n") >= MIN_DOCS)
    scores = []
    for k, c in enumerate(categories):
        yes, all_ = float(shares[c] or 0), float(shares["n"] or 0)
        if not 0 < yes < all_:
            continue
        rate = F.col("n") / all_
        scores.append(F.abs(F.col(f"c{k}") / yes - (F.col("n") - F.col(f"c{k}")) / (all_ - yes)) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1 / yes + 1 / (all_ - yes))))
    if not scores:
        return np.zeros(0, np.uint64)
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    rows = counted.withColumn("z", best).where(F.col("z") >= Z).orderBy(F.desc("z"), "word").limit(WORDS).select("word").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """Fits a chain to the documents that labels (id, one 0/1 column per category) covers; the last category is the one that decides."""
    names = tuple(f"c{k}" for k in range(len(categories)))
    known = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(n) for c, n in zip(categories, names, strict=True)])
    known = known.where("id IS NOT NULL AND " + " AND ".join(f"{n} IN (0, 1)" for n in names))
    ids = known.groupBy("id").agg(*[F.max(n).alias(n) for n in names]).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id")  # at most `sample` ids
    # of rows that repeat an id the one with the least hash of its text
    chosen = chosen.groupBy("id").agg(F.min_by(F.struct("text", *names), F.struct(F.xxhash64("text"), "text")).alias("row")).select("id", "row.*")
    chosen = stage(chosen, "sample")
    vocabulary = _vocabulary(chosen, names)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns, form = _features(batch.column(1), vocabulary)
            at = np.searchsorted(rows, np.arange(len(form) + 1))
            found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(columns, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, pa.array(form.tolist(), pa.list_(pa.float64())), *(batch.column(k + 2) for k in range(len(names)))], names=["id", "found", "form", *names])

    kind = dict(chosen.dtypes)["id"]
    schema = f"id {kind}, found array<int>, form array<double>, " + ", ".join(f"{c} int" for c in names)
    table = chosen.mapInArrow(lean(marks), schema).toPandas().sort_values("id")
    drop_stage(chosen)
    return _chain(table, names, categories, vocabulary)


def _features(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts hold which vocabulary words, sorted, and figures of each text's form: shares of capitals, signs, digits and white
    space among its bytes, the logarithm of their number, and the share of distinct words."""
    data, offsets = text_bytes(column)
    n, own = np.diff(offsets), np.zeros(1 << 16, bool)
    own[vocabulary >> np.uint64(48)] = True
    counts, distinct = np.zeros((len(n), len(_CLASSES))), np.zeros(len(n))
    found, held = [np.zeros(0, np.int64)], []
    for i, j, a, b in spans(data, offsets):
        part, at = data[a:b], np.clip(offsets[i : j + 1], a, b) - a
        for k, c in enumerate(_CLASSES):
            counts[i:j, k] += np.diff(_rank(c[part])[at])
        words, of, stems, stems_of = _words(part, at)
        for keys, text in ((words, of), (stems, stems_of)):
            maybe = np.flatnonzero(own[keys >> np.uint64(48)])
            place = np.searchsorted(vocabulary, keys[maybe])
            place[place == len(vocabulary)] = 0
            hit = vocabulary[place] == keys[maybe] if len(vocabulary) else np.zeros(0, bool)
            found.append(np.unique((text[maybe[hit]] + i) * max(1, len(vocabulary)) + place[hit]))
        different = np.unique(words >> (np.uint64(64) - _IN_TEXT) | of.astype(np.uint64) << _IN_TEXT)
        if held or b < offsets[j]:  # a long text
            held = [np.unique(np.concatenate([*held, different]))]
            if b == offsets[j]:
                distinct[i], held = len(held[0]), []
        else:
            distinct[i:j] = np.bincount((different >> _IN_TEXT).astype(np.int64), minlength=j - i)
    rows, columns = np.divmod(np.unique(np.concatenate(found)), max(1, len(vocabulary)))
    form = np.column_stack([counts / np.maximum(n, 1)[:, None], np.log1p(n), distinct / (1 + counts[:, 3])])
    return rows, columns, form


def _chain(table: pd.DataFrame, names: tuple[str, ...], categories: tuple[str, ...], vocabulary: np.ndarray) -> Chain:
    form = np.array([list(x) for x in table["form"]], np.float64).reshape(-1, 6)
    rows = np.repeat(np.arange(len(table)), [len(x) for x in table["found"]])
    columns = np.concatenate([np.zeros(0, np.int64), *table["found"]]).astype(np.int64)
    centre, scale = (form.mean(0), form.std(0) + 1e-9) if len(form) else (np.zeros(6), np.ones(6))
    dense, fold = _standard(form, centre, scale), np.array([zlib.crc32(str(i).encode()) % FOLDS for i in table["id"]], np.int64)
    models, p = [], np.zeros(0)
    for c in names:
        y = table[c].to_numpy(np.float64)
        p = np.zeros(len(y))
        for k in range(FOLDS):  # what later links see of this one: predictions for documents that it was not fitted on
            m = _fit(rows, columns, len(vocabulary), dense, y, fold != k)
            z = np.bincount(rows, m.words[columns], len(y)) + dense @ m.dense + m.bias
            p = np.where(fold == k, np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6), p)
        models.append(_fit(rows, columns, len(vocabulary), dense, y, np.ones(len(y), bool)))
        dense = np.column_stack([dense, np.log(p / (1 - p)) / 4])
    threshold = 2.0
    if len(p) and 0 < (y := table[names[-1]].to_numpy()).sum() < len(y):
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
        last = np.append(np.diff(p[order]) != 0, True)  # between equal probabilities there is no threshold
        best = int(np.argmax(np.where(last, f1, -1)))
        after = p[order][best + 1] if best + 1 < len(p) else 0.0
        threshold = float((p[order][best] + after) / 2)
    return Chain(categories, vocabulary, centre, scale, models, threshold)


def scored(docs: DataFrame, chain: Chain, text_col: str = "text", keep: str = "all") -> DataFrame:
    """docs with _p (a probability for each category) and _toxic, which replace columns of these names; keep="clean": only the rows that are not, with the columns of docs alone."""
    told = docs.sparkSession.sparkContext.broadcast(chain)
    at, fields = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = told.value
        for batch in batches:
            p = c.probabilities(*_features(batch.column(at).cast(pa.string()), c.vocabulary))
            toxic = p[:, -1] >= c.threshold if p.shape[1] else np.zeros(len(p), bool)
            if keep == "clean":
                yield batch.filter(pa.array(~toxic))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(toxic)], names=[*(f"x{i}" for i in range(fields)), "p", "toxic"])

    inner = docs.toDF(*[f"x{i}" for i in range(fields)])
    schema = T.StructType(list(inner.schema.fields) + ([] if keep == "clean" else [T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("toxic", T.BooleanType())]))
    out = inner.mapInArrow(lean(run), schema)
    if keep == "clean":
        return out.toDF(*docs.columns)
    kept = [F.col(f"x{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ("_p", "_toxic")]
    return out.select(*kept, F.col("p").alias("_p"), F.col("toxic").alias("_toxic"))
