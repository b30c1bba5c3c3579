"""Exact top-k search by inner product: ball trees per shard, branch and bound.

Vectors are turned into integers, floor(scale * x). Rows are dealt into shards of about SHARD vectors by a hash of the id, so
that no common vector fills a shard. A shard's tree halves its vectors along the line between two far ones; a node is a
centre and a radius. The tree is built once, by the task that has the shard, which then takes the queries as they stream in,
a block at a time. Nodes are visited in the order of their upper bound, query . centre + |query| * radius, and left out for
the queries whose kth best score is above it. That score begins as the kth best among SEEDS vectors that all tasks know, is
shared by all nodes of a walk, and is carried on: one shard in FIRST answers all queries before the others begin. A bound
equal to the kth score is not left out, as a smaller id wins a tie. Vectors are shuffled once; each query goes to each shard.

Vectors that are null, or hold null or non-finite components, take no part; vectors of another length are scored only against
their like. Rows that repeat an id count once each as candidates, but not as candidates of that id. Fewer candidates than k: all of them. Empty
table: empty result. Other columns are not looked at. Scores must fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import lean, stage

K, EVERY, SCALE, SHARD, BLOCK, LEAF, SEEDS, FIRST = 5, 50, 256, 8192, 256, 128, 512, 8
_NONE = -(1 << 62)


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v): the vectors that take part, as integers."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale))
    fine = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dim"), x.cast("array<bigint>").alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows; through doubles where these hold them exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Tree:
    """Nodes in an array: centre, radius, children or a run of the reordered vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, left, right, from, to
        work = [(0, len(ids), -1, 0)] if len(ids) else []
        while work:
            a, b, parent, side = work.pop()
            part = self.vectors[a:b].astype(np.float64)
            centre = part.mean(0)
            far = ((part - centre) ** 2).sum(1)
            k = len(self.nodes)
            # a hair wider than computed, so that rounding never cuts off a vector
            self.nodes.append((centre, float(np.sqrt(far.max()) * (1 + 1e-9) + 1e-6), -1, -1, a, b))
            if parent >= 0:
                p = list(self.nodes[parent])
                p[2 + side] = k
                self.nodes[parent] = tuple(p)
            if b - a > leaf and far.max() > 0:
                one = part[far.argmax()]
                other = part[((part - one) ** 2).sum(1).argmax()]
                along = part @ (one - other)
                split = np.argsort(along, kind="stable")
                self.ids[a:b], self.vectors[a:b] = self.ids[a:b][split], self.vectors[a:b][split]
                middle = (a + b) // 2
                work += [(a, middle, k, 0), (middle, b, k, 1)]

    def search(self, qids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ids and scores (queries x k, id -1 where there is none) of at least floor; floor grows on the way."""
        best = np.full((len(queries), k), _NONE)
        who = np.full((len(queries), k), -1, np.int64)
        if not self.nodes:
            return who, best
        q = queries.astype(np.float64)
        norm = np.sqrt((q * q).sum(1))
        floor = floor.copy()

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            at = q[rows] @ centre
            return at + norm[rows] * radius + np.abs(at) * 1e-9 + 1e-6

        every = np.arange(len(queries))
        work = [(0.0, 0, every, bound(0, every))]
        while work:
            _, node, rows, most = heapq.heappop(work)
            rows = rows[most >= floor[rows]]
            if not len(rows):
                continue
            _, _, left, right, a, b = self.nodes[node]
            if left < 0:
                scores = _exact(queries[rows], self.vectors[a:b])
                ids = np.broadcast_to(self.ids[a:b], scores.shape)
                scores = np.where(ids == qids[rows][:, None], _NONE, scores)
                all_s, all_i = np.concatenate([best[rows], scores], 1), np.concatenate([who[rows], ids], 1)
                order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best[rows], who[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
                floor[rows] = np.maximum(floor[rows], best[rows, k - 1].astype(np.float64))
                continue
            for child in (left, right):
                promise = bound(child, rows)
                heapq.heappush(work, (-float(promise.max()), child, rows, promise))
        return who, best


def _walks(k: int, block: int, known):
    """Over rows (dim, shard, asked, vec_id, floor, v) sorted so that a shard's vectors come before its queries: each query's best there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree = None, [], None

        def answers(ids: np.ndarray, q: np.ndarray, floor: np.ndarray, dim: int) -> pa.RecordBatch:
            seed_ids, seed = known.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, q.shape[1]), np.int64)))
            scores = _exact(q, seed).astype(np.float64)
            scores[seed_ids[None, :] == ids[:, None]] = -np.inf
            if scores.shape[1] > k:
                floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
            who, best = tree.search(ids, q, floor, k)
            i, j = np.nonzero((best > _NONE) & (best >= floor[:, None]))
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(who[i, j]), pa.array(best[i, j])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            dims, shards, asked = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(3))
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (shards[1:] != shards[:-1]) | (asked[1:] != asked[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dims)], strict=True):
                if a == b:
                    continue
                if (now := (int(dims[a]), int(shards[a]))) != shard:
                    shard, parts, tree = now, [], None
                part = batch.slice(a, b - a)
                ids, matrix = part.column(3).to_numpy(zero_copy_only=False), _matrix(part.column(5))
                if not asked[a]:
                    parts.append((ids, matrix))
                    continue
                if tree is None:
                    tree = Tree(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Tree(ids[:0], matrix[:0])
                    parts = []
                floor = part.column(4).cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                floor = np.where(np.abs(floor) < 2.0**53, floor, np.nextafter(floor, -np.inf))  # not above the score that it stands for
                for i in range(0, len(ids), block):
                    yield answers(ids[i : i + block], matrix[i : i + block], floor[i : i + block], now[0])

    return run


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` its k best others."""
    rows = stage(integers(vectors, id_col, vector_col, scale), "vectors")
    queries = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).dropDuplicates(["vec_id", "v"])
    sizes = dict(rows.groupBy("dim").count().collect())  # a row for each length of vectors
    shards = max([-(-n // shard) for n in sizes.values()], default=1)
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in sorted(sizes, key=sizes.get)[-8:]:  # without seeds the walks begin without a score, and are as exact
        norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
        top = rows.where(F.col("dim") == dim).withColumn("norm", norm).orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
        seeds[dim] = np.array(top["vec_id"], np.int64), _matrix(top["v"])
    known = rows.sparkSession.sparkContext.broadcast(seeds)
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))

    def answered(low: int, high: int, asked: DataFrame) -> DataFrame:
        """The best of each query in the shards from low to high - 1."""
        left = placed.where(F.col("shard").between(low, high - 1)).select("dim", "shard", F.lit(False).alias("asked"), "vec_id", F.lit(None).cast("long").alias("floor"), "v")
        right = asked.select("dim", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))).alias("shard"), F.lit(True).alias("asked"), "vec_id", "floor", "v")
        dealt = left.union(right).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asked")
        return dealt.mapInArrow(lean(_walks(k, block, known)), "query_id long, vec_id long, score long")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = -(-shards // FIRST)
    found = stage(answered(0, first, queries.withColumn("floor", F.lit(None).cast("long"))), "found")
    if first < shards:
        kth = found.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        found = found.union(answered(first, shards, queries.join(kth, "vec_id", "left")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
