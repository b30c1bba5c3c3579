"""Best-fit packing by exact-complement hashing.

Documents are tokenised where they are read and cut into pieces of at most `most` tokens. How pieces share sequences depends
on their lengths alone, so the plan is made on the histogram of lengths, which has at most `most` rows however many
documents there are: a sequence opens with the longest piece left, its gap is looked up among the single lengths, the sums
of two and the sums of three that are still available, and where nothing fills it exactly the best-fitting piece narrows it
first; the pattern is then taken as often as the counts allow. The plan is a table of runs: the pieces of a length by rank
from .. to are in so many consecutive sequences at this offset. Pieces get their rank within their length from counts per
(length, bucket), so that no task sees a whole length, and find their run by a join on the length and a block of ranks.

Null text: no words, so the end token alone. Very long texts are tokenised span by span. Rows that repeat an id are packed once
each. Ties: pieces of one length are placed by id, piece and check sum. Empty table: empty result. Other columns are never looked at.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, lean, mix, spans, stage, text_bytes, word_bounds, word_hashes

MOST, END = 4096, 1
#: Pieces of one length and one bucket, or block of ranks, at most about.
SHARE = 100_000
#: Rows of a plan (48 bytes each) that are broadcast.
RUNS = 200_000
#: Places for parts of words that a worker remembers between tasks (each new part takes the place that its hash names), and their ids in all.
SLOTS, IDS = 1 << 19, 1 << 22


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others numbered from 256."""
    keep, out, more = {*range(33, 127), *range(161, 173), *range(174, 256)}, [], 0
    for b in range(256):
        out.append(chr(b if b in keep else 256 + more))
        more += b not in keep
    return out


#: Kinds of bytes in words of printable ASCII and Latin-1 letters: letters, digits (each a part by itself) and signs.
_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[SPACE] = 0
_KIND[0x27] = _ODD  # what follows an apostrophe may belong to it
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, and bounds and kinds of the parts of words: runs of letters, single digits, runs of signs. A word that
    holds anything else, an apostrophe or the beginning of a special token is one part, as it is."""
    low, kind = _LOWER[data], _KIND[data]
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    second &= (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
    kind[second] = _LETTER
    low[second & (data < 0x9F)] += 0x20
    kind[:-1][(data[:-1] == 0x3C) & (data[1:] == 0x7C)] = _ODD
    # a lead byte whose letter is none of these is odd as its follower is, and with it the word
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        starts, ends, _ = word_bounds(data, offsets)
        own = np.unique(np.searchsorted(starts, odd, "right") - 1)
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[own]] = 1
        step[ends[own]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        kind[inside] = _ODD
        low[inside] = data[inside]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    new[offsets] = True
    word = kind > 0
    starts, ends = np.flatnonzero(new[:-1] & word), np.flatnonzero(new[1:] & word) + 1
    return low, starts, ends, kind[starts]


class WordIds:
    """Token ids of the words of a text. The vocabulary's rules never look across white space, and cut words where kinds of letters
    change; parts are encoded once and remembered by hash, words of other letters go through the tokenizer as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.whole = path, Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def ids(self, part: bytes, odd: bool) -> list[int]:
        if odd:
            return self.whole.encode(part.decode(), add_special_tokens=False).ids
        spelled = part.decode() if part.isascii() else "".join([self.letters[b] for b in part])
        return [t.id for t in self.model.tokenize(spelled)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and n + 1 offsets into them."""
        if len(self.flat) > IDS or len(self.begin) > 2 * SLOTS:
            self.clear()
        low, starts, ends, kind = _parts(data, offsets)
        keys = word_hashes(low, starts, ends, fold=False)
        keys[kind == _ODD] = mix(keys[kind == _ODD] + np.uint64(1))
        slot = keys & np.uint64(SLOTS - 1)
        which, missed = self.at[slot], np.flatnonzero((self.keys[slot] != keys) | (keys == 0))
        if len(missed):
            new, first, inverse = np.unique(keys[missed], return_index=True, return_inverse=True)
            first, raw = missed[first], low.tobytes()
            lists = [self.ids(raw[s:e], k == _ODD) for s, e, k in zip(starts[first].tolist(), ends[first].tolist(), kind[first].tolist(), strict=True)]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            number = len(self.begin) - 1 + np.arange(len(new))
            which[missed] = number[inverse]
            at = new & np.uint64(SLOTS - 1)
            _, one = np.unique(at, return_index=True)  # of parts that share a place one is remembered
            self.keys[at[one]], self.at[at[one]] = new[one], number[one]
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(lengths)])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(lengths.sum()))])
        n = self.begin[which + 1] - self.begin[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.begin[which] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]


_ids: WordIds | None = None


def word_ids(path: str) -> WordIds:
    global _ids
    if _ids is None or _ids.path != path:
        _ids = WordIds(path)
    return _ids


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end: int = END) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32) for each piece; row tells apart the rows that repeat an id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            doc, piece, start, length, crc = [], [], [], [], []
            held: list[np.ndarray] = []
            for i, j, a, b in spans(data, offsets, 1 << 20):
                ids, at = encoder.encode(data[a:b], np.clip(offsets[i : j + 1], a, b) - a)
                if held or b < offsets[j]:  # a long text
                    held.append(ids)
                    if b < offsets[j]:
                        continue
                    ids = np.concatenate(held)
                    at, held = [0, len(ids)], []
                for k in range(j - i):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), most)):
                        part = own[s : s + most]
                        doc.append(i + k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Lengths:
    """How many pieces of each length are left, and the sums that they make."""

    def __init__(self, counts: dict[int, int], most: int):
        self.left = np.zeros(most + 1, np.int64)
        for n, c in counts.items():
            self.left[n] = c
        self.index()

    def index(self) -> None:
        """Sums of two and of three lengths, as they were when indexed: what is left later makes no others."""
        there = (self.left > 0).astype(np.float64)
        self.pairs = np.rint(np.convolve(there, there)[: len(there)]) > 0
        self.triples = np.rint(np.convolve(self.pairs, there)[: len(there)]) > 0

    def often(self, lengths: list[int]) -> int:
        return min(int(self.left[n]) // lengths.count(n) for n in lengths)

    def pair(self, gap: int, pattern: list[int]) -> list[int] | None:
        if not self.pairs[gap]:
            return None
        a = np.arange((gap + 1) // 2, gap)
        for x in a[(self.left[a] > 0) & (self.left[gap - a] > 0)][::-1].tolist():
            if self.often([*pattern, x, gap - x]):
                return [x, gap - x]
        return None

    def exact(self, gap: int, pattern: list[int]) -> list[int] | None:
        """One, two or three lengths that fill the gap, with what the pattern already holds."""
        if self.left[gap] and self.often([*pattern, gap]):
            return [gap]
        if found := self.pair(gap, pattern):
            return found
        if not self.triples[gap]:
            return None
        c = np.arange(1, gap)
        for x in c[(self.left[c] > 0) & self.pairs[gap - c]][::-1].tolist():
            if self.often([*pattern, x]) and (found := self.pair(gap - x, [*pattern, x])):
                return [x, *found]
        return None

    def best(self, gap: int, pattern: list[int]) -> int | None:
        """The largest length that the gap holds."""
        fits = np.flatnonzero(self.left[: gap + 1])[::-1]
        return next((x for x in fits.tolist() if self.often([*pattern, x])), None)


def plan(counts: dict[int, int], most: int = MOST) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset): the pieces of that length by rank are in consecutive sequences, each at that offset."""
    lengths, done, runs, sequences, since = Lengths(counts, most), np.zeros(most + 1, np.int64), [], 0, 0
    while len(there := np.flatnonzero(lengths.left)):
        pattern, gap = [int(there[-1])], most - int(there[-1])
        while gap:
            if (more := lengths.exact(gap, pattern)) is None:
                more = [m] if (m := lengths.best(gap, pattern)) is not None else None
            if more is None:
                break
            pattern += more
            gap -= sum(more)
        times, offset = lengths.often(pattern), 0
        for n in pattern:
            runs.append((n, int(done[n]), times, sequences, offset))
            done[n] += times
            lengths.left[n] -= times
            offset += n
        sequences += times
        since += 1
        if since % 64 == 0:
            lengths.index()
    return runs


def _shares(n: int) -> int:
    """In how many buckets, or blocks of ranks, the n pieces of a length are."""
    return -(-n // SHARE)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end: int = END) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, tokenizer, id_col, text_col, most, end), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `most` rows
    shares = spark.createDataFrame([(n, _shares(c)) for n, c in histogram.items()], "length long, shares long")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("shares"))
    dealt = cut.join(F.broadcast(shares), "length").withColumn("bucket", bucket)  # at most `most` rows
    own = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"))
    local = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("r", F.row_number().over(local) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("r") + F.col("before"))
    ranked = ranked.withColumn("block", F.expr(f"rank DIV {SHARE}"))
    runs = []
    for n, rank, times, first, offset in plan(histogram, most):
        runs += [(n, b, rank, times, first, offset) for b in range(rank // SHARE, (rank + times - 1) // SHARE + 1)]
    table = spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in runs], pa.int64()) for i in range(6)], names=["length", "block", "rank0", "times", "first", "offset"]))
    table = F.broadcast(table) if len(runs) <= RUNS else table
    placed = ranked.join(table, ["length", "block"]).where("rank >= rank0 AND rank < rank0 + times")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("rank0")).alias("sequence_id"), "offset")
