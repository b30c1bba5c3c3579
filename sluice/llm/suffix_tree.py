"""A probabilistic suffix tree as language model, and the word unigram scores that it is held against.

A text is read as its words, A-Z in lower case, with one space between two and an end after the last. The tree's symbols are
bytes: the commonest SYMBOLS - 2 of them, one symbol for all others (whose byte then costs its own share among them), and
the end. Counts of all runs of DEPTH + 1 symbols of all training texts are summed by Spark. A context of up to DEPTH symbols
passes the divergence test if its next-symbol distribution saves at least FLOOR bits over its suffix's (the count times the
divergence); the model keeps all that pass. In the order of their symbols from the last on they are divided into trees of up to
STATES contexts, which bounds what is broadcast: the texts are gone through once for each HELD trees, each of which scores the
symbols whose contexts lie in its range. Distributions are smoothed
towards that of the longest retained suffix; a text is scored by its longest suffix states, as lookups in whole arrays.

Word counts: the TOP commonest words go to every task, the rest are joined, so that no common word makes a hot key.

Null or blank text: the end alone. Very long texts are read span by span. Null id: a training document. Rows that repeat an id:
scored each. Ties: bytes as frequent are taken in their order, words as frequent by hash. No training text: all
symbols are as likely, base scores 0. Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, lean, spans, stage, text_bytes, word_bounds, word_hashes

DEPTH, SYMBOLS, STATES, HELD, FLOOR, TOP, PRIOR = 5, 64, 32_767, 8, 10.0, 1 << 18, 4.0
#: Contexts of so many symbols are found by their code in a table, longer ones by search.
_DIRECT = 4
_END = 256  # among bytes
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5 == 1


def _spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Bytes (0-255) and ends (256) of the texts in a row, where each text begins in them, and the bounds of the words."""
    starts, ends, first = word_bounds(data, offsets)
    length = ends - starts
    n = np.diff(first)
    blank = np.cumsum(n == 0) - (n == 0)  # blank texts before each text
    out_at = np.concatenate([[0], np.cumsum(length + 1)])
    begins = out_at[first[:-1]] + blank
    shift = out_at[:-1] + np.repeat(blank, n)
    out = np.full(int(out_at[-1] + (n == 0).sum()), 32, np.int64)
    out[np.repeat(shift - (np.cumsum(length) - length), length) + np.arange(length.sum())] = _LOWER[data[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())]]
    out[np.concatenate([begins[1:], [len(out)]]) - 1] = _END
    return out, begins, (starts, ends, first)


def _contexts(symbols: np.ndarray, begins: np.ndarray, end: int, bits: int, depth: int = DEPTH, turned: bool = False) -> np.ndarray:
    """The last `depth` symbols before each, the latest lowest (turned: highest); before a text there are ends."""
    at = np.arange(len(symbols)) - np.repeat(begins, np.diff(np.append(begins, len(symbols))))
    out = np.zeros(len(symbols), np.int64)
    for d in range(1, depth + 1):
        back = np.full(len(symbols), end, np.int64)
        back[d:] = symbols[:-d]
        back[at < d] = end
        out |= back << (bits * (depth - d if turned else d - 1))
    return out


def _read(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """(first text, last + 1, symbols, where texts begin in them, symbols before the first, bytes, bounds of words) of spans of texts; one text may come in several."""
    before, seen = np.full(DEPTH, _END, np.int64), False
    for i, j, a, b in spans(data, offsets):
        part, end = data[a:b], int(offsets[j])
        symbols, begins, bounds = _spelled(part, np.clip(offsets[i : j + 1], a, b) - a)
        if b < end:  # the text goes on
            if any(not SPACE[data[x : min(x + (1 << 20), end)]].all() for x in range(b, end, 1 << 20)):
                symbols[-1] = 32
            symbols = symbols if len(bounds[0]) else symbols[:0]
        elif seen and not len(bounds[0]):  # white space after its last word
            symbols = symbols[:0]
        yield i, j, symbols, begins, before, part, bounds
        seen = b < end and (seen or len(bounds[0]) > 0)
        before = np.concatenate([before, symbols])[-DEPTH:] if b < end else np.full(DEPTH, _END, np.int64)


def _after(symbols: np.ndarray, begins: np.ndarray, before: np.ndarray, end: int, bits: int, depth: int = DEPTH, turned: bool = False) -> np.ndarray:
    """The contexts of a span's symbols, of which the first text may have begun earlier."""
    if (before == end).all():
        return _contexts(symbols, begins, end, bits, depth, turned)
    return _contexts(np.concatenate([before, symbols]), np.append(0, begins[1:] + len(before)), end, bits, depth, turned)[len(before) :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): kind 0 words by hash, 1 runs of symbols."""
    for batch in batches:
        words, grams = [], []
        for _, _, symbols, begins, before, part, (starts, ends, _) in _read(*text_bytes(batch.column(0))):
            words.append(word_hashes(part, starts, ends).view(np.int64))
            grams.append(_after(symbols, begins, before, _END, 9) << 9 | symbols)
            if sum(map(len, grams)) > 4_000_000:
                yield from _counted(words, grams)
                words, grams = [], []
        if grams:
            yield from _counted(words, grams)


def _counted(words: list[np.ndarray], grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for kind, lists in enumerate((words, grams)):
        keys, n = np.unique(np.concatenate(lists), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])


def _turned(contexts: np.ndarray, depth: int, bits: int = 6) -> np.ndarray:
    """Codes of so many symbols with the latest highest, as if followed by symbols 0 up to DEPTH: contexts with a common suffix are a range."""
    out = contexts * 0
    for i in range(depth):
        out = out | (contexts >> bits * i & ((1 << bits) - 1)) << bits * (DEPTH - 1 - i)
    return out


def _straight(turned: np.ndarray, depth: int, bits: int = 6) -> np.ndarray:
    """The codes of so many symbols, the latest lowest, that _turned() gave these for."""
    out = turned * 0
    for i in range(depth):
        out = out | (turned >> bits * (DEPTH - 1 - i) & ((1 << bits) - 1)) << bits * i
    return out


class Tree:
    """Retained contexts of a range with their smoothed next-symbol distributions."""

    def __init__(self, symbol_of: np.ndarray, other: np.ndarray, entries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], bounds: tuple[int, int], symbols: int = SYMBOLS, depth: int = DEPTH):
        """symbol_of: for bytes and end; other: log10 share of a byte among those of its symbol; entries: depth -> codes, next symbols, counts; bounds: of the range."""
        self.symbol_of, self.other, self.depth, self.bits, self.bounds = symbol_of, other, depth, (symbols - 1).bit_length(), bounds
        self.codes, self.first, parts = [], [0], []
        for d in range(depth + 1):
            ctx, s, n = entries[d]
            codes, at = np.unique(np.append(ctx, 0) if d == 0 else ctx, return_inverse=True)
            at, order = at[: len(ctx)], np.argsort(at[: len(ctx)], kind="stable")
            at, s, n = at[order], s[order], n[order]
            parent, above_all = self._longest(codes), np.concatenate(parts) if d else None
            for i in range(0, len(codes), 8192):
                j = min(i + 8192, len(codes))
                (a, b), counts = np.searchsorted(at, [i, j]), np.zeros((j - i, symbols))
                counts[at[a:b] - i, s[a:b]] = n[a:b]
                if d == 0:
                    rows = (counts + 0.5) / (counts.sum() + 0.5 * symbols)
                else:
                    prior = PRIOR * np.count_nonzero(counts, 1)[:, None] ** 0.5
                    above = 10.0 ** above_all[parent[i:j]]
                    rows = (counts + prior * above) / (counts.sum(1)[:, None] + prior)
                parts.append(np.log10(rows).astype(np.float32))
            self.codes.append(codes)
            self.first.append(self.first[-1] + len(codes))
        self.log10, self._lookup = np.concatenate(parts), None

    def _longest(self, codes: np.ndarray) -> np.ndarray:
        """The state of the longest retained suffix among the depths so far."""
        out = np.zeros(len(codes), np.int64)
        for k, own in enumerate(self.codes):
            suffix = codes & ((1 << self.bits * k) - 1)
            at = np.minimum(np.searchsorted(own, suffix), max(len(own) - 1, 0))
            hit = own[at] == suffix if len(own) else np.zeros(len(codes), bool)
            out[hit] = self.first[k] + at[hit]
        return out

    @property
    def order(self) -> list[tuple[int, int]]:
        return [(d, code) for d, own in enumerate(self.codes) for code in own.tolist()]

    @property
    def index(self) -> dict[tuple[int, int], int]:
        return {c: i for i, c in enumerate(self.order)}

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The state of each turned run of _DIRECT symbols in the range, whether such a run ends retained contexts of more symbols, and these with their states."""
        if self._lookup is None:
            low, high = (x >> self.bits * (self.depth - _DIRECT) for x in (self.bounds[0], self.bounds[1] - 1))
            table, ends = np.zeros(high - low + 1, np.int32 if len(self.log10) > 1 << 16 else np.uint16), np.zeros(high - low + 1, bool)
            for d, codes in enumerate(self.codes):
                turned, ids = _turned(codes, d), np.arange(self.first[d], self.first[d + 1])
                at = (turned >> self.bits * (self.depth - _DIRECT)) - low
                if d < _DIRECT:
                    span = 1 << self.bits * (_DIRECT - d)
                    for i, j in zip(at.tolist(), ids.tolist(), strict=True):
                        table[max(i, 0) : max(i + span, 0)] = j
                else:
                    inside = (at >= 0) & (at < len(table))
                    if d == _DIRECT:
                        table[at[inside]] = ids[inside]
                    else:
                        ends[at[inside]] = True
            order = np.argsort(turned)
            self._lookup = table, ends, turned[order], ids[order].astype(table.dtype)
        return self._lookup

    def states(self, turned: np.ndarray) -> np.ndarray:
        """The state of the longest retained suffix of each turned run of `depth` symbols, all in the range."""
        table, ends, longer, ids = self.lookup()
        last = (turned >> self.bits * (self.depth - _DIRECT)) - (self.bounds[0] >> self.bits * (self.depth - _DIRECT))
        out = table[last]
        where = np.flatnonzero(ends[last])
        if len(where):
            at = np.searchsorted(longer, turned[where])
            at[at == len(longer)] = 0
            hit = longer[at] == turned[where]
            out[where[hit]] = ids[at[hit]]
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lookup": None}


def _scores(held: list[Tree], spelled: np.ndarray, begins: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 probability of the symbols of each text of a span whose contexts are in the ranges of the trees."""
    if not len(spelled):
        return np.zeros(len(begins))
    symbols, first = held[0].symbol_of[spelled], held[0].symbol_of[before]
    turned = _after(symbols, begins, first, int(held[0].symbol_of[_END]), held[0].bits, held[0].depth, turned=True)
    each = np.zeros(len(symbols))
    for tree in held:
        mine = slice(None) if tree.bounds == (0, 1 << 6 * DEPTH) else np.flatnonzero((turned >= tree.bounds[0]) & (turned < tree.bounds[1]))
        each[mine] = tree.log10[tree.states(turned[mine]), symbols[mine]].astype(np.float64) + tree.other[spelled[mine]]
    return np.add.reduceat(each, begins)


def _most(df: DataFrame, column: str, at_most: int) -> DataFrame:
    """The rows with the greatest values (1 at least), at most so many: those from the least step of a fine logarithmic scale from which on there are no more. No task sorts, or returns more than its own of them."""
    step = F.floor(F.log2(F.col(column).cast("double")) * 64)
    left, least = at_most, None
    for s, n in sorted(df.groupBy(step.alias("s")).count().collect(), reverse=True):  # 64 steps for each power of two
        left -= n
        if left < 0:
            break
        least = s
    return df.where(step >= F.lit(least)) if least is not None else df.limit(0)


def _ranges(kept: DataFrame, short: np.ndarray, at_most: int) -> list[tuple[int, int]]:
    """Ranges of turned codes, in each of which so many of the contexts (those kept, and the short ones) begin at most (but at least those that begin at one code)."""
    shift = 6 * (DEPTH - 3)  # three symbols: at most 4161 contexts and those of fewer symbols
    while True:
        found = kept.groupBy(F.shiftright("turned", shift).alias("c")).agg(F.count("*").alias("n")).toArrow()
        codes, at = np.unique(np.concatenate([found["c"].to_numpy(), short >> shift]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([found["n"].to_numpy(), np.ones(len(short), np.int64)]), len(codes)).astype(np.int64)
        if shift == 0 or not len(counts) or counts.max() <= at_most:
            break
        shift -= 6
    bounds, held = [0], 0
    for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
        if held and held + n > at_most:
            bounds.append(c << shift)
            held = 0
        held += n
    return list(zip(bounds, [*bounds[1:], 1 << 6 * DEPTH], strict=True))


def learn(grams: DataFrame) -> Tree:
    """The first tree for counts (key, n) of runs of DEPTH + 1 bytes or ends; the only one if all contexts fit into it."""
    return next(trees(grams)[1])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, with their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _saved(n: np.ndarray, up: np.ndarray, up_all: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits that contexts save over their suffixes: sum of n * log2(p / p of the suffix), with the context's own total taken out of the logarithm. first: where each context's next symbols begin."""
    total = np.add.reduceat(n, first).astype(np.float64)
    return np.add.reduceat(n * np.log2(n.astype(np.float64) * up_all / up), first) - total * np.log2(total)


def _passing(keys: np.ndarray, n: np.ndarray, up_keys: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that pass the test, and from where to where in keys their next symbols are. keys: context, latest symbol highest, and next symbol, in order; up_keys: those of the suffixes."""
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    contexts, suffixes = keys >> 6, up_keys >> 6
    first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
    starts = np.flatnonzero(np.append(True, suffixes[1:] != suffixes[:-1]))
    all_of = np.add.reduceat(up, starts)[np.searchsorted(suffixes[starts], contexts >> 6)]
    passed = _saved(n, up[np.searchsorted(up_keys, contexts >> 6 << 6 | keys & 63)], all_of, first) >= FLOOR
    return contexts[first[passed]], first[passed], np.append(first[1:], len(keys))[passed]


def _within(keys: np.ndarray, n: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next symbols and counts of the contexts, one after the other."""
    size = last - first
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return keys[at] & 63, n[at]


def _chosen(pairs: np.ndarray):
    """For runs in order of their contexts' latest symbols, whose runs of 3 such symbols are whole: the contexts of 3 symbols or more that pass. pairs: counts of two symbols, latest first, and the next one."""
    up_keys = np.flatnonzero(pairs)
    up_n = pairs[up_keys]

    def whole(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, n = _summed(keys, n)
        for d in range(DEPTH, 2, -1):
            above = _summed(keys >> 12 << 6 | keys & 63, n) if d > 3 else (up_keys, up_n)
            contexts, first, last = _passing(keys, n, *above)
            symbols, counts = _within(keys, n, first, last)
            at, turned = pa.array(np.append(0, np.cumsum(last - first)), pa.int32()), contexts << 6 * (DEPTH - d)
            columns = [pa.array(turned), pa.array(turned + (1 << 6 * (DEPTH - d))), pa.array(np.full(len(contexts), d, np.int8)), pa.ListArray.from_arrays(at, pa.array(symbols.astype(np.int8))), pa.ListArray.from_arrays(at, pa.array(counts))]
            yield pa.RecordBatch.from_arrays(columns, names=["turned", "upto", "d", "s", "n"])
            keys, n = above

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            counts.append(batch.column(1).to_numpy())
            held += len(keys[-1])
            if held < 200_000:
                continue
            k, c = np.concatenate(keys), np.concatenate(counts)
            cut = int(np.searchsorted(k, k[-1] >> 18 << 18))  # the last run of 3 symbols may go on
            if cut:
                yield from whole(k[:cut], c[:cut])
            keys, counts, held = [k[cut:]], [c[cut:]], len(k) - cut
        if held:
            yield from whole(np.concatenate(keys), np.concatenate(counts))

    return choose


def trees(grams: DataFrame) -> tuple[int, Iterator[Tree]]:
    """The number of trees, and the trees, each made when it is asked for.

    Contexts of up to 2 symbols (4161 at most) are tested here. The runs that share the latest 3 symbols of their contexts (1 << 18
    at most) are tested in one task, which has all suffixes of these contexts from 3 symbols on. The driver plans few queries, one
    for each tree, as every plan takes some of its memory."""
    spark = grams.sparkSession
    bytes_ = dict(grams.groupBy((F.col("key").bitwiseAND(F.lit(511))).alias("b")).agg(F.sum("n").alias("n")).collect())
    order = sorted((b for b in range(256)), key=lambda b: (b != 32, -bytes_.get(b, 0), b))
    symbol_of, other, rest = np.full(257, SYMBOLS - 2, np.int64), np.zeros(257), order[SYMBOLS - 2 :]
    symbol_of[order[: SYMBOLS - 2]] = np.arange(SYMBOLS - 2)
    symbol_of[_END] = SYMBOLS - 1
    of_rest = np.array([bytes_.get(b, 0) + 0.5 for b in rest])
    other[rest] = np.log10(of_rest / of_rest.sum())
    names = F.array(*[F.lit(int(s)) for s in symbol_of])

    def run(depth: int) -> F.Column:
        """The latest symbols before a run's last, the latest highest, and the last."""
        code = F.lit(0).cast("long")
        for d in [*range(1, depth + 1), 0]:
            b = F.shiftright(F.col("key"), 9 * d).bitwiseAND(F.lit(511).cast("long")) + 1
            code = F.shiftleft(code, 6).bitwiseOR(F.element_at(names, b.cast("int")).cast("long"))
        return code

    found = grams.select(run(2).alias("run"), "n").groupBy("run").agg(F.sum("n").alias("n")).toArrow()  # at most 1 << 18
    pairs = np.zeros(1 << 18, np.int64)
    pairs[found["run"].to_numpy()] = found["n"].to_numpy()
    short, above = {}, None
    for d in range(3):
        dense = pairs.reshape(64, 64, 64).sum(tuple(range(d, 2))).ravel()
        keys, n = np.flatnonzero(dense), dense[dense > 0]
        contexts, first, last = _passing(keys, n, *above) if d else (np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, len(keys)))
        short[d], above = (contexts << 6 * (DEPTH - d), first, last, keys, n), (keys, n)
    runs = grams.select(run(DEPTH).alias("run"), "n").groupBy("run").agg(F.sum("n").alias("n"))  # first, as many runs of bytes may share the symbol of all others
    runs = runs.repartition(F.shiftright("run", 18)).sortWithinPartitions("run")
    model = spark.sparkContext.broadcast(pairs)
    choose = lambda batches: _chosen(model.value)(batches)
    kept = stage(runs.mapInArrow(lean(choose), "turned long, upto long, d byte, s array<tinyint>, n array<bigint>"), "contexts")
    model.destroy()
    ranges = _ranges(kept, np.concatenate([short[d][0] for d in (1, 2)]), max(1, STATES - DEPTH))

    def entries(low: int, high: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the contexts that have longer ones, or themselves, in the range, by their number of symbols."""
        rows, out = kept.where((F.col("turned") < high) & (F.col("upto") > low)).toArrow().combine_chunks(), {}  # at most STATES contexts
        for d, (turned, first, last, keys, n) in short.items():
            mine = (turned < high) & (turned + (1 << 6 * (DEPTH - d)) > low)
            out[d] = (np.repeat(_straight(turned[mine], d), (last - first)[mine]), *_within(keys, n, first[mine], last[mine]))
        for d in range(3, DEPTH + 1):
            own = rows.filter(pc.equal(rows["d"], d))
            s, n = (pa.concat_arrays(own[c].chunks or [pa.array([], own[c].type)]) for c in ("s", "n"))
            out[d] = np.repeat(_straight(own["turned"].to_numpy(), d), s.value_lengths().to_numpy()), s.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy()
        return out

    return len(ranges), (Tree(symbol_of, other, entries(*r), r) for r in ranges)


def _part(numbered: DataFrame, held: list[Tree]) -> DataFrame:
    """(row, part): what the symbols in the ranges of further trees add to the scores."""
    model = numbered.sparkSession.sparkContext.broadcast(held)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            parts = np.zeros(len(batch.column(0)))
            for i, j, symbols, begins, before, _, _ in _read(*text_bytes(batch.column(1))):
                parts[i:j] += _scores(own, symbols, begins, before)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts)], names=["row", "part"])

    out = stage(numbered.select("row", "text").mapInArrow(lean(score), "row long, part double"), "parts")
    model.destroy()  # the driver holds a copy as well
    return out


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    training = plain.where("NOT held_out")
    counts = stage(training.select("text").mapInArrow(lean(_count), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("kind = 0").select("key", "n")
    ends = training.select("doc_id").count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    scale = total + 0.5 * (distinct + 1)
    top = _most(words, "n", TOP).toArrow().sort_by("key")
    keys, log10_of = top["key"].to_numpy(), np.log10((top["n"].to_numpy() + 0.5) / scale)
    log10_end = float(np.log10((ends + 0.5) / scale))
    n_trees, made = trees(counts.where("kind = 1").select("key", "n"))
    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    if n_trees > HELD:
        numbered = stage(numbered, "texts")  # the texts are gone through again
    model = spark.sparkContext.broadcast((list(itertools.islice(made, HELD)), keys, log10_of))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, log10_known = model.value
        for batch in batches:
            n = len(batch.column(0))
            scores, base, n_words, n_common = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            rare = [np.zeros(0, np.int64)]
            for i, j, symbols, begins, before, part, (starts, ends_, first) in _read(*text_bytes(batch.column(1))):
                scores[i:j] += _scores(held, symbols, begins, before)
                h = word_hashes(part, starts, ends_).view(np.int64)
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                common = known[at] == h if len(known) else np.zeros(len(h), bool)
                sums = np.concatenate([[0.0], np.cumsum(np.where(common, log10_known[at], 0.0) if len(known) else np.zeros(len(h)))])
                n_words[i:j] += np.diff(first)
                n_common[i:j] += np.diff(np.concatenate([[0], np.cumsum(common)])[first])
                base[i:j] += np.diff(sums[first])
                rare.append(h[~common])
            rare_at = np.concatenate([[0], np.cumsum(n_words - n_common)])
            lists = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(np.concatenate(rare)))
            columns = [pa.array(x) for x in (n_words, n_common, base, scores)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns, lists], names=["doc_id", "held_out", "row", "words", "common", "base", "score", "rare"])

    kind = dict(plain.dtypes)["doc_id"]
    each = stage(numbered.mapInArrow(lean(score), f"doc_id {kind}, held_out boolean, row long, words long, common long, base double, score double, rare array<bigint>"), "scores")
    model.destroy()
    parts = []
    for _ in range(HELD, n_trees, HELD):  # no name for the trees, so that these go before the next are made
        parts.append(_part(numbered, list(itertools.islice(made, HELD))))
    if parts:
        more = parts[0]
        for part in parts[1:]:
            more = more.union(part)
        more = more.groupBy("row").agg(F.sum("part").alias("part"))
        each = each.join(more, "row").withColumn("score", F.col("score") + F.col("part")).drop("part")
    rare = each.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    joined = rare.join(words, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per_row = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(scale))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = each.drop("rare").join(per_row, "row", "left")
    end_known = 1 if ends else 0
    return out.select("doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), (F.col("common") + F.coalesce("known", F.lit(0)) + end_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0)) + log10_end).alias("base_score"), "score")
