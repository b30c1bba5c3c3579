"""Near-duplicate documents by bottom-k sketches.

One hash function gives every word shingle a 64-bit value; a document's sketch is its k least values. Documents with equal
sets are one class from the start. Inverted lists are kept of runs of RUN values that follow one another in a sketch (for
sets of up to SMALL shingles also of RUN - 1 values): documents at the threshold share such a run unless more than a quarter
of their joint sketch differs, which for k = 64 and a similarity of 0.8 has a probability near 1e-12, and which can't happen
where the sketch is the whole set; a shingle that millions of documents hold makes no list by itself. The least k values of
the union estimate the similarity of a candidate pair, with a margin of six standard deviations, and full sets decide.

A long list is not expanded into pairs. Every member is first compared with the list's most central member; components of
the confirmed links follow. A list whose members then are in one component is done. Of the others, lists of up to PAIRS
members compare those of different components pair by pair. A document with at most one run in FREE on longer lists needs
those no more: its links show on its other lists, but for a probability near 1e-7 even if all it has on long lists were
shared (against an exact join of all documents no link was lost in tables of 51,282 and 256,410 rows, see README). The remaining members of long lists, in general variants of one text, make families, whose full sets are compared
in blocks of bounded bytes. There is no cap on lists, partners or candidates.

Null or blank text: an empty set, linked with nothing. Fewer words than a shingle: the whole sequence is the one shingle. Very
long texts are read span by span; a text's set must fit in a worker. Null id: not linked, and kept. Ties: the least id stays.
Rows that repeat an id: each comes out, with the same component if their texts are linked. Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import drop_stage, lean, lean_group, maybe_in, mix, spans, stage, text_bytes, word_bounds, word_hashes
from sluice.llm.components import components

K, RUN, SMALL, PAIRS, FREE, SALT = 64, 3, 8, 24, 8, 256
BLOCK_ROWS, BLOCK_BYTES, SLAB = 512, 8 << 20, 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles."""
    data, offsets = text_bytes(column)
    held: list[np.ndarray] = []
    for i, j, x, y in spans(data, offsets):
        part = data[x:y]
        starts, ends, first = word_bounds(part, np.clip(offsets[i : j + 1], x, y) - x)
        words = word_hashes(part, starts, ends)
        if held or y < offsets[j]:  # a long text
            held.append(words)
            if y < offsets[j]:
                continue
            words, held = np.concatenate(held), []
            first = np.array([0, len(words)])
        joined = words.copy()
        for k in range(1, n):
            joined = mix(joined * _STEP)[: len(words) - k]
            joined = joined + words[k:]
        joined = mix(joined) if len(words) >= n else joined[:0]
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(joined[a : b - n + 1])
            elif b > a:
                h = words[a : a + 1] + np.uint64(b - a)
                for k in range(a + 1, b):
                    h = mix(h * _STEP) + words[k]
                yield mix(h)
            else:
                yield np.zeros(0, np.uint64)


def _sketches(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for s in shingle_sets(batch.column(1), n):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(s[:k].view(np.int64))
            lengths = np.cumsum([0, *map(len, sketches)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sketches]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)], names=["doc_id", "n", "digest", "sketch"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), n)], pa.binary())], names=["doc_id", "shingles"])

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of the intersection of each pair of sorted sets."""
    for batch in batches:
        out, sets, right, last = [], batch.column("right"), None, None
        for i, left in enumerate(batch.column("left")):
            if last != (key := batch.column("b")[i].as_py()):
                last, right = key, np.frombuffer(sets[i].as_buffer(), np.uint64)
            a, b = np.frombuffer(left.as_buffer(), np.uint64), right
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            out.append(int((b[at] == a).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(out, pa.int64())], names=["a", "b", "na", "nb", "common"])


def _runs(sketch: Column, size: Column) -> Column:
    """Hashes of the runs of a sketch."""

    def of(r: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(sketch) - (r - 1)), lambda i: F.xxhash64(*[F.element_at(sketch, i + k) for k in range(r)]))

    none = F.array().cast("array<bigint>")
    long = F.when(F.size(sketch) >= RUN, of(RUN)).otherwise(none)
    short = F.when((size <= SMALL) & (F.size(sketch) >= RUN - 1), of(RUN - 1)).otherwise(none)
    return F.concat(long, short)


class _Verifier:
    """Decides candidate pairs (a, b): by size, by sketch, then by the full sets of the documents that remain.

    members: (rep, n, sketch, shingles) of the classes that are on a list. Its joins are merge joins, whatever the statistics
    say of pairs that are not there yet, so that plans do not change their kind as the input grows.
    """

    def __init__(self, members: DataFrame, k: int, percent: int):
        self.members, self.k, self.percent = members, k, percent

    def estimated(self, pairs: DataFrame) -> DataFrame:
        sides = [self.members.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")).hint("merge") for x in "ab"]
        joined = pairs.join(sides[0], "a").join(sides[1], "b").where(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, self.k)
        shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
        p = self.percent / 100
        whole = (F.col("na") <= self.k) & (F.col("nb") <= self.k)
        m = F.when(whole, F.size(F.array_union("sa", "sb"))).otherwise(self.k)
        least = F.when(whole, F.lit(p)).otherwise(F.lit(p - 6 * (p * (1 - p) / self.k) ** 0.5))
        exact_shared = F.when(whole, F.size(F.array_intersect("sa", "sb"))).otherwise(shared)
        return joined.where(exact_shared + F.lit(1e-9) >= least * m).select("a", "b", "na", "nb")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are linked."""
        left = stage(self.estimated(pairs), "candidates")
        salts = left.groupBy("b").agg((F.expr(f"count(*) DIV {SALT}") + 1).alias("salts"))
        right = self.members.select(F.col("rep").alias("b"), F.col("shingles").alias("right")).join(salts, "b").select("b", "right", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        salted = left.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts"))).drop("salts")
        with_left = salted.join(self.members.select(F.col("rep").alias("a"), F.col("shingles").alias("left")).hint("merge"), "a")
        both = with_left.join(right.hint("merge"), ["b", "salt"]).select("a", "b", "na", "nb", "left", "right")
        common = both.mapInArrow(lean(_common), "a long, b long, na long, nb long, common long")
        return stage(common.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * self.percent).select("a", "b"), "linked")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; linked: 100 * intersection >= percent * union of the sets."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stage(plain.mapInArrow(lean(_sketches(n, k)), "doc_id long, n long, digest binary, sketch array<bigint>"), "sketches")
    own = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = stage(own.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "classes")
    # one id may stand for several classes where rows repeat an id with other texts: those classes are linked through it
    repeated = own.groupBy("doc_id").agg(F.count_distinct("digest").alias("c")).where("c > 1").select("doc_id")
    if not repeated.isEmpty():
        return _with_repeats(plain, n, percent, k)
    return _dedupe(plain, signed, classes, n, percent, k)


def _with_repeats(plain: DataFrame, n: int, percent: int, k: int) -> DataFrame:
    """Rows that repeat an id with other texts get ids of their own for the comparison; an id's rows are then one node."""
    rows = stage(plain.withColumn("row", F.xxhash64("doc_id", "text")), "rows")
    alone = near_duplicates(rows.select("row", "text"), "row", "text", n, percent, k).select(F.col("doc_id").alias("row"), F.col("n_shingles"), F.col("component_id").alias("group")).dropDuplicates(["row"])
    found = stage(rows.select("doc_id", "row").join(alone, "row"), "rows")
    links = found.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "group").distinct()
    hub = links.groupBy("group").agg(F.min("doc_id").alias("b"))
    joined = components(links.join(hub, "group").select(F.col("doc_id").alias("a"), "b"))
    out = found.where("doc_id IS NOT NULL AND n_shingles > 0").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    rest = found.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def class_links(classes: DataFrame, docs: DataFrame, n: int, percent: int, k: int) -> DataFrame | None:
    """(node, component) of the classes that are linked with another; None if there is none."""
    held = classes.where("n > 1").select("rep", F.array_distinct(_runs(F.col("sketch"), F.col("n"))).alias("runs"))
    runs = held.select("rep", F.size("runs").alias("held"), F.explode("runs").alias("run"))
    found = stage(runs.join(runs.groupBy("run").agg(F.count("*").alias("size")).where("size > 1"), "run"), "lists")
    if found.isEmpty():
        return None
    # the pivot of a list is the member that shares most with all others: edits are counted from there
    shared = stage(found.groupBy("rep").agg(F.sum("size").alias("shared")), "shared")
    pivots = found.join(shared, "rep").groupBy("run").agg(F.max(F.struct("shared", -F.col("rep"))).alias("top")).select("run", (-F.col("top")["col2"]).alias("pivot"))
    lists = stage(found.join(pivots, "run"), "lists")
    drop_stage(found)
    own = maybe_in(docs, "doc_id", shared, "rep").mapInArrow(lean(_sets(n)), "doc_id long, shingles binary").withColumnRenamed("doc_id", "rep").dropDuplicates(["rep"])
    members = stage(classes.select("rep", "n", "sketch").join(own, "rep"), "members")
    check = _Verifier(members, k, percent)
    links = check.linked(lists.where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct())
    # lists whose members are now in several components
    known = components(links).withColumnRenamed("node", "rep")
    placed = lists.join(known, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    unsettled = placed.groupBy("run").agg(F.count("*").alias("now"), F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("run", "now")
    still = stage(placed.join(unsettled, "run"), "open")
    drop_stage(lists)
    long = still.where(f"now > {PAIRS}")
    bound = long.groupBy("rep").agg(F.count("*").alias("on_long"), F.first("held").alias("held")).where(f"{FREE} * on_long > held").select("rep")
    crowd = stage(long.join(bound, "rep", "left_semi").select("run", "rep", "part"), "crowd")
    left, right = still.where(f"now <= {PAIRS}").select("run", F.col("rep").alias("a"), F.col("part").alias("pa"), "pivot"), still.where(f"now <= {PAIRS}").select("run", F.col("rep").alias("b"), F.col("part").alias("pb"))
    rest = left.join(right, "run").where("a > b AND pa != pb AND b != pivot AND a != pivot").select("a", "b").distinct()
    more = [check.linked(rest)]
    if not crowd.isEmpty():
        more.append(stage(_crowded(crowd, members, percent), "linked"))
    if all(x.isEmpty() for x in more):
        return known.withColumnRenamed("rep", "node")
    for x in more:
        links = links.union(x)
    return components(links)


def _crowded(crowd: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components among documents that meet on long lists: (run, rep, part).

    Lists with common members make a family. Its full sets are compared in blocks of bounded bytes, as products of matrices;
    two blocks of the family's largest component are not compared with each other.
    """
    hub = crowd.groupBy("run").agg(F.min("rep").alias("b"))
    family = components(crowd.join(hub, "run").select(F.col("rep").alias("a"), "b").distinct()).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    rows = stage(crowd.select("rep", "part").distinct().join(family, "rep"), "family")
    parts = rows.groupBy("family", "part").agg(F.count("*").alias("c")).groupBy("family").agg(F.max(F.struct("c", "part"))["part"].alias("main"))
    full = stage(members.select("rep", "shingles").join(rows, "rep").join(parts, "family").withColumn("in_main", F.col("part") == F.col("main")).drop("main"), "family")
    shape = full.groupBy("family", "in_main").agg((F.expr(f"sum(greatest(length(shingles), {BLOCK_BYTES // BLOCK_ROWS})) DIV {BLOCK_BYTES}") + 1).alias("blocks"))
    blocked = full.join(shape, ["family", "in_main"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")) * 2 + F.col("in_main").cast("long")).drop("blocks")
    blocks = stage(blocked, "blocks")
    names = blocks.select("family", "block").distinct()
    pairs = names.alias("x").join(names.withColumnRenamed("block", "other").alias("y"), "family").where("block <= other AND NOT (block % 2 = 1 AND other % 2 = 1)")
    sides = pairs.select("family", "block", "other", F.explode(F.array_distinct(F.array("block", "other"))).alias("own"))
    dealt = blocks.withColumnRenamed("block", "own").join(sides, ["family", "own"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        x = table.filter(pa.compute.equal(table["own"], key[1]))
        y = table.filter(pa.compute.equal(table["own"], key[2]))
        a, b = _linked_in(x, y, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("family", "block", "other").applyInArrow(lean_group(compare), "a long, b long")


def _linked_in(x: pa.Table, y: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the linked pairs of different components between two blocks; each pair at least once."""

    def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for c in t["shingles"].chunks for v in c]
        sizes = np.array([len(v) for v in sets], np.int64)
        return np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes), sizes, np.array(t["part"]), np.array(t["rep"])

    (vx, rx, nx, px, ix), (vy, ry, ny, py, iy) = side(x), side(y)
    common = np.zeros((len(ix), len(iy)), np.float32)
    values = np.intersect1d(vx, vy)
    cx, cy = np.searchsorted(values, vx), np.searchsorted(values, vy)
    hx, hy = cx < len(values), cy < len(values)
    hx[hx], hy[hy] = values[cx[hx]] == vx[hx], values[cy[hy]] == vy[hy]
    cx, rx, cy, ry = cx[hx], rx[hx], cy[hy], ry[hy]
    ox, oy = np.argsort(cx, kind="stable"), np.argsort(cy, kind="stable")
    cx, rx, cy, ry = cx[ox], rx[ox], cy[oy], ry[oy]
    for at in range(0, len(values), SLAB):
        (a, b), (c, d) = np.searchsorted(cx, [at, at + SLAB]), np.searchsorted(cy, [at, at + SLAB])
        left, right = np.zeros((len(ix), SLAB), np.float32), np.zeros((len(iy), SLAB), np.float32)
        left[rx[a:b], cx[a:b] - at], right[ry[c:d], cy[c:d] - at] = 1, 1
        common += left @ right.T
    common = common.astype(np.int64)
    i, j = np.nonzero((common * 100 >= percent * (nx[:, None] + ny[None, :] - common)) & (px[:, None] != py[None, :]))
    return ix[i], iy[j]


def _dedupe(plain: DataFrame, signed: DataFrame, classes: DataFrame, n: int, percent: int, k: int) -> DataFrame:
    linked = class_links(classes, plain, n, percent, k)
    named = classes.select("digest", "rep")
    if linked is not None:
        named = named.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    else:
        named = named.withColumnRenamed("rep", "component")
    out = signed.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
