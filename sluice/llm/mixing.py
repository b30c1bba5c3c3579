"""Mixing sources to target weights [native].

Words are summed per source; weights share the whole among the sources, a target stopping at `most` times its source's
size and its excess going to the others by weight. A document then comes floor(rate) times, and once more if a hash of the
seed and its id falls below the fraction, so that reruns agree.

Null text: size 0. Very long texts: counted where they are, like any. Null source: a source of its own, after all others. Null
id: a hash of the word null. Rows that repeat an id are decided alike. Ties: sources that are full at the same level are taken in
their order. Empty table: empty result. Other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import fresh, stage

#: SOURCES: rows of targets that are broadcast, by count.
WEIGHTS, MOST, SEED, SOURCES = (5, 2, 1), 3, 17, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row (source, source_size, target) for each source of sizes (source, size), as a table: its size is then known to whoever joins it, so that texts are not shuffled by source for a few rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per.withColumn("i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    every, before = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("full_at", "i").rowsBetween(W.unboundedPreceding, -1)
    cap = F.col("source_size") * most
    filled = numbered.withColumn("weight", weight).withColumn("full_at", cap.cast("double") / F.col("weight"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = filled.withColumn("level", left.cast("double") / open_weight.cast("double"))
    # the water level is that of the first source, by the level at which each is full, that it does not fill
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "i", "level"))).over(every)["level"]
    return stage(level.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * first).alias("target")), "targets")


def with_copies(docs: DataFrame, per_source: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, name: str = "_mix") -> DataFrame:
    """All columns of docs, and under this name, which replaces a column of docs: its source's source_size and target, and how many copies the mix takes."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"d.`{id_col}`").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rate = F.when(F.col("s.source_size") > 0, F.col("s.target") / F.col("s.source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    small = F.broadcast(per_source) if per_source.count() <= SOURCES else per_source
    joined = docs.alias("d").join(small.alias("s"), F.col(f"d.`{source_col}`").eqNullSafe(F.col("s.source")))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns if c.lower() != name.lower()], F.struct(F.col("s.source_size").alias("source_size"), F.col("s.target").alias("target"), copies.alias("copies")).alias(name))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of docs as often as the mix takes it, with the columns of docs."""
    sizes = docs.select(F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size"))
    name = fresh("_mix", docs.columns)
    counted = with_copies(docs, targets(sizes, weights, most), id_col, source_col, seed, name).where(F.col(name)["copies"] > 0)
    copy = fresh("_copy", docs.columns)
    each = counted.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)["copies"])))
    return each.select(*[F.col(f"`{c}`") for c in docs.columns])
