"""Line dedup by a log-template tree.

Every line is parsed at a fixed depth: by its number of words, then by its LEAD leading words, words with a digit standing for
any such word. What follows is read as at most FIELDS fields of neighbouring words, one word each in short lines. Lines in
one leaf belong to a template if enough of their fields agree; the fields that differ are its variable ones. Lines that agree
in all fields but a set of the allowed number are a group; groups are taken from the largest on (ties: by the fields left
out, then by their least line), and those of their lines that are in no template yet, if two at least, become one. Distinct lines
are found before anything else, so a line that a third of all documents holds is one row from then on. A leaf of up to LEAF
distinct lines is done in one task; the lines of larger ones meet by the hashes of what their groups share, in rounds, with the
same result: no task holds a leaf, and no line is given up.

A template that occurs in at least `min_docs` documents, and has `min_words` words, is dropped from all of them but for its first
occurrence, by document id and place. A row's document is its id and text: rows that repeat both count as one and
are treated alike. Null text: no lines, stays null. Very long texts are read span by span, of their words only hashes are held.
Blank and short lines stay. Null id: a document of its own, after all others. Ties: of groups of a size, as said above. Empty
table: empty result. Other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import drop_stage, lean, mix, spans, stage, text_bytes, word_bounds, word_hashes

LEAD, FIELDS, SIMILAR, LEAF, MIN_DOCS, MIN_WORDS = 3, 8, 0.85, 512, 2, 4
_NEWLINE, _ANY = 10, np.uint64(0x5851F42D4C957F2D)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SEED = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 18
_LINES = "doc_id {id}, th long, n int, at int, whole long, lead long, fields array<int>"


def _words(data: np.ndarray, offsets: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of texts in a row: hash (one for all words with a digit), text, and line (the first text begins in line `before`)."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, fold=False)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    words[digits[ends] > digits[starts]] = _ANY
    breaks = np.flatnonzero(data == _NEWLINE)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    place = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[text]
    place[text == 0] += before
    return words, text.astype(np.int32), place.astype(np.int32)


def _figures(words: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the lines with words: text, place, number of words, hashes of the whole and the lead, fields."""
    new = np.ones(len(words), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(words)))
    count = mix(n.astype(np.uint64) * _SEED)
    whole, lead, fields = count.copy(), count.copy(), np.zeros((len(begin), FIELDS), np.uint64)
    for lo in range(0, len(words), _AT_ONCE):
        hi = min(lo + _AT_ONCE, len(words))
        line = np.cumsum(new[lo:hi]) + int(np.searchsorted(begin, lo, "right")) - 1 - new[lo]
        at = np.arange(lo, hi) - begin[line]
        each = mix(words[lo:hi] + (at.astype(np.uint64) + np.uint64(1)) * _SEED)
        runs = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        whole[line[runs]] += np.add.reduceat(each, runs)
        lead[line[runs]] += np.add.reduceat(np.where(at < LEAD, each, np.uint64(0)), runs)
        rest = np.maximum(n - LEAD, 1)[line]
        field = np.minimum((at - LEAD) * FIELDS // np.maximum(rest, FIELDS), FIELDS - 1)
        tail = at >= LEAD
        np.add.at(fields, (line[tail], field[tail]), each[tail])
    return text[begin], place[begin], n, mix(whole), mix(lead), fields


def _parse(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The first text and the figures of its lines and of those after it; of a very long text only words' hashes are held at once."""
    held: list[tuple[np.ndarray, ...]] = []
    before = 0
    for i, j, a, b in spans(data, offsets):
        part = data[a:b]
        found = _words(part, np.clip(offsets[i : j + 1], a, b) - a, before)
        if held or b < offsets[j]:
            held.append(found)
            before += int((part == _NEWLINE).sum())
            if b < offsets[j]:
                continue
            found, held, before = tuple(np.concatenate(x) for x in zip(*held, strict=True)), [], 0
        yield i, _figures(*found)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, (text, place, n, whole, lead, fields) in _parse(*text_bytes(batch.column(2))):
            row = pa.array(text.astype(np.int64) + i)
            used = np.minimum(np.maximum(n - LEAD, 0), FIELDS)
            keep = np.arange(FIELDS)[None, :] < used[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used)]), pa.int32()), pa.array(fields[keep].view(np.int64).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(n, pa.int32()), pa.array(place, pa.int32()), pa.array(whole.view(np.int64)), pa.array(lead.view(np.int64)), lists], names=["doc_id", "th", "n", "at", "whole", "lead", "fields"])


def _kept(width: int, similar: float) -> list[tuple[int, ...]]:
    """The sets of fields that lines of so many fields must share to be one group; none if all of them must agree."""
    least = math.ceil(similar * width - 1e-9)
    return list(itertools.combinations(range(width), max(least, 0)))[::-1] if least < width else []


def _merge(rows: list[tuple[int, list[int]]], similar: float) -> list[int]:
    """For the lines of a leaf (whole, fields) the template of each: its least line."""
    out, groups = [whole for whole, _ in rows], {}
    for mask, kept in enumerate(_kept(len(rows[0][1]), similar)):
        for i, (_, fields) in enumerate(rows):
            groups.setdefault((mask, *(fields[k] for k in kept)), []).append(i)
    ranked = sorted((-len(g), key[0], -min(rows[i][0] for i in g), g) for key, g in groups.items() if len(g) > 1)
    free = set(range(len(rows)))
    for *_, group in ranked:
        mine = [i for i in group if i in free]
        if len(mine) > 1:
            free.difference_update(mine)
            least = min(rows[i][0] for i in mine)
            for i in mine:
                out[i] = least
    return out


def _leaves(similar: float):
    """Over rows (leaf, whole, fields) sorted by leaf: (whole, template)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, rows = None, []

        def done() -> pa.RecordBatch:
            found = _merge(rows, similar)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(found, pa.int64())], names=["whole", "template"])

        for batch in batches:
            ready = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != leaf and rows:
                    ready.append(done())
                    rows = []
                leaf = key
                rows.append(tuple(row))
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
        if rows:
            yield done()

    return run


def _rounds(lines: DataFrame, similar: float) -> DataFrame:
    """(whole, template) for lines (whole, lead, fields) of leaves of any size, as _merge has them. A round takes each group that
    is the first of two free lines at least; lines that are left go on with the groups that are taken or still have two free ones."""
    keys = F.array().cast("array<struct<mask:int,key:bigint>>")
    for width in range(1, FIELDS + 1):
        if masks := _kept(width, similar):
            each = [F.struct(F.lit(m).alias("mask"), F.xxhash64("lead", F.lit(m), *(F.col("fields")[k] for k in kept)).alias("key")) for m, kept in enumerate(masks)]
            keys = F.when(F.size("fields") == width, F.array(*each)).otherwise(keys)
    entries = lines.select("whole", F.explode(keys).alias("g")).select("whole", "g.mask", "g.key")
    groups = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("whole").alias("least")).where("size > 1")
    left = stage(entries.join(groups, "key"), "groups")
    taken = found = None
    while not left.isEmpty():
        first = stage(left.groupBy("whole").agg(F.max(F.struct("size", -F.col("mask"), "least", "key"))["key"].alias("key")), "first")
        new = first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        taken = stage(new if taken is None else taken.union(new).distinct(), "taken")
        settled = stage(first.join(taken, "key", "left_semi"), "settled")
        found = settled if found is None else found.union(settled)
        free = left.join(settled.select("whole"), "whole", "left_anti")
        open_ = free.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").union(taken).distinct()
        left = stage(free.join(open_, "key", "left_semi"), "groups")
    if found is None:
        return lines.select("whole", F.col("whole").alias("template")).limit(0)
    return found.join(found.groupBy("key").agg(F.min("whole").alias("template")), "key").select("whole", "template")


def templates(lines: DataFrame, similar: float = SIMILAR, leaf: int | None = None) -> DataFrame:
    """(whole, template) for the distinct lines that share a template with another; all others are their own."""
    leaf = LEAF if leaf is None else leaf
    widths = [w for w in range(1, FIELDS + 1) if _kept(w, similar)]
    distinct = stage(lines.where(F.size("fields").isin(widths)).groupBy("whole").agg(F.first("lead").alias("lead"), F.first("fields").alias("fields")), "distinct")
    sizes = distinct.groupBy("lead").agg(F.count("*").alias("size")).where("size > 1")
    joined = stage(distinct.join(sizes, "lead"), "leaves")
    dealt = joined.where(F.col("size") <= leaf).select("lead", "whole", "fields").repartition("lead").sortWithinPartitions("lead")
    found = dealt.mapInArrow(lean(_leaves(similar)), "whole long, template long")
    large = joined.where(F.col("size") > leaf).select("whole", "lead", "fields")
    if not large.isEmpty():
        found = found.union(_rounds(large, similar))
    return found.where("whole != template")


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, th, drop): for each document by id and hash of its text, the sorted places of the lines that go."""
    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    lines = stage(plain.mapInArrow(lean(_lines), _LINES.format(id=kind)).where(F.col("n") >= min_words).dropDuplicates(["doc_id", "th", "at"]), "lines")
    found = stage(templates(lines, similar), "templates")
    joined = lines.select("doc_id", "th", "at", "whole").join(found, "whole", "left").withColumn("template", F.coalesce("template", "whole")).drop("whole")
    # one row for each template and document first: a template that every document holds is summed in parts
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "at")
    per_doc = joined.groupBy("template", "doc_id", "th").agg(F.min("at").alias("at"))
    common = per_doc.groupBy("template").agg(F.count("*").alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= min_docs).select("template", "first")
    gone = joined.join(common, "template").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "at")
    out = stage(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("at")).alias("drop")), "drops")
    drop_stage(lines)
    drop_stage(found)
    return out


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "_lines", **settings) -> DataFrame:
    """docs with the text that remains, and under this name, which replaces a column of docs, how many lines the text had and how many went."""
    drops = dropped(docs, id_col, text_col, **settings).alias("g")
    text, gone = F.col(f"d.`{text_col}`"), F.col("g.drop")
    joined = docs.alias("d").join(drops, F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(text.cast("string")) == F.col("g.th")), "left")
    kept = F.concat_ws("\n", F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)))
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_dropped = F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    columns = [F.when(gone.isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns if c.lower() != name.lower()]
    return joined.select(*columns, F.struct(n_lines.alias("n_lines"), n_dropped.alias("n_dropped")).alias(name))
