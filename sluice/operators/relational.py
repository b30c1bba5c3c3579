"""Each stage as DataFrame operations; Catalyst and AQE choose how they run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.values import equals, key_pair, literal
from sluice.plans import stages as S

#: Finds the rows of another base: (schema, table) -> DataFrame.
Bases = Callable[[str | None, str], DataFrame]


def col(name: str):
    return F.col(f"`{name}`")


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def project(df: DataFrame, s: S.Project) -> DataFrame:
    return df.select(*[col(f) for f in dict.fromkeys(s.fields) if f in df.columns])


def match(df: DataFrame, s: S.Match) -> DataFrame:
    if s.field not in df.columns:
        return df.where(F.lit(False))
    return df.where(equals(col(s.field), _kind(df, s.field), s.value))


def add_fields(df: DataFrame, s: S.AddFields) -> DataFrame:
    """In order: a later entry sees what earlier ones wrote."""
    for name, source in s.entries:
        if isinstance(source, S.Literal):
            value = literal(source.value)
        else:
            value = col(source.field) if source.field in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name, value)
    return df


def unset(df: DataFrame, s: S.Unset) -> DataFrame:
    return df.drop(*s.fields)


def rename(df: DataFrame, s: S.Rename) -> DataFrame:
    """One pair after the other; a destination that is there is overwritten."""
    for old, new in s.pairs:
        if old in df.columns and old != new:
            df = df.drop(new).withColumnRenamed(old, new)
    return df


def lookup(df: DataFrame, s: S.Lookup, foreign: DataFrame) -> DataFrame:
    """Left outer, null equal to null; matches as an array of whole foreign rows, in the order of their columns, none as []."""
    row = F.struct(*[col(c) for c in foreign.columns])
    mine, theirs = key_pair(col(s.local), _kind(df, s.local), col(s.foreign), _kind(foreign, s.foreign)) if s.local in df.columns else (F.lit(None).cast("string"), F.lit("-"))
    if s.foreign not in foreign.columns:
        return df.withColumn(s.name, F.array().cast(T.ArrayType(foreign.select(row.alias("r")).schema["r"].dataType)))
    matches = foreign.groupBy(theirs.alias("__k")).agg(F.sort_array(F.collect_list(row)).alias("__m"))
    joined = df.drop(s.name).withColumn("__l", mine).join(matches, F.col("__l").eqNullSafe(F.col("__k")), "left")
    empty = F.array().cast(matches.schema["__m"].dataType)
    return joined.withColumn(s.name, F.coalesce("__m", empty)).drop("__l", "__k", "__m")


def lookup_unwound(df: DataFrame, s: S.Lookup, foreign: DataFrame) -> DataFrame:
    """$lookup and $unwind of its array in one: an inner join, no array is built. Foreign columns override the parent's."""
    if s.local not in df.columns or s.foreign not in foreign.columns:
        return unwind(lookup(df, s, foreign), S.Unwind(s.name))
    mine, theirs = key_pair(col(s.local), _kind(df, s.local), col(s.foreign), _kind(foreign, s.foreign))
    kept = [c for c in df.columns if c not in foreign.columns and c != s.name]
    left = df.withColumn("__l", mine).select("__l", *[col(c) for c in kept]).alias("l")
    right = foreign.withColumn("__k", theirs).alias("r")
    return left.join(right, F.col("l.__l").eqNullSafe(F.col("r.__k"))).select(*[F.col(f"l.`{c}`") for c in kept], *[F.col(f"r.`{c}`") for c in foreign.columns])


def unwind(df: DataFrame, s: S.Unwind) -> DataFrame:
    """Objects are merged into the parent, whose fields they override; scalars replace the path. Null and empty give no row."""
    if s.path not in df.columns:
        return df.where(F.lit(False))
    kind = _kind(df, s.path)
    if not isinstance(kind, T.ArrayType):
        if isinstance(kind, T.NullType):
            return df.where(F.lit(False))
        raise S.InvalidStage(f"$unwind: {s.path} is no array")
    exploded = df.withColumn("__e", F.explode(col(s.path)))
    if isinstance(kind.elementType, T.StructType):
        inner = kind.elementType.fieldNames()
        kept = [col(c) for c in df.columns if c != s.path and c not in inner]
        return exploded.select(*kept, *[F.col("__e")[c].alias(c) for c in inner])
    return exploded.withColumn(s.path, F.col("__e")).drop("__e")


def union(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.unionByName(other, allowMissingColumns=True)


def no_number(df: DataFrame, s: S.Group, needed: Callable[[str], bool]) -> Column | None:
    """The first text of a row that a needed aggregate of the stage takes as a number and that spells none; None if no aggregate takes texts as numbers."""
    texts = dict.fromkeys(a.field for a in s.aggregates if a.op in ("sum", "min", "max", "avg") and needed(a.name) and a.field in df.columns and isinstance(_kind(df, a.field), T.StringType))
    return F.coalesce(*[F.when(col(t).try_cast("decimal(38,10)").isNull(), col(t)) for t in texts]) if texts else None


def group(df: DataFrame, s: S.Group) -> DataFrame:
    keys = [col(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in s.keys]
    if not s.aggregates:
        return df.select(*keys).distinct()
    out = []
    for a in s.aggregates:
        there = a.field in df.columns
        field, kind = (col(a.field), _kind(df, a.field)) if there else (F.lit(None).cast("decimal(38,10)"), T.DecimalType(38, 10))
        if a.op in ("sum", "min", "max", "avg") and not isinstance(kind, T.NumericType):
            if not isinstance(kind, T.StringType):
                raise S.InvalidStage(f"$group {a.name}: ${a.op} takes numbers, {a.field} is {kind.simpleString()}")
            field = field.cast("decimal(38,10)")  # texts that spell no number are an error when they are read
        if a.op == "sum":
            value = F.coalesce(F.sum(field), F.lit(0))
        elif a.op == "add_to_set":
            value = F.sort_array(F.collect_set(field))
        else:
            value = {"count": F.count, "min": F.min, "max": F.max, "avg": F.avg}[a.op](field)
        out.append(value.alias(a.name))
    return df.groupBy(*keys).agg(*out)


_ROWWISE = {S.Project: project, S.Match: match, S.AddFields: add_fields, S.Unset: unset, S.Rename: rename, S.Unwind: unwind, S.Group: group}


def apply(df: DataFrame, stage: S.Stage, bases: Bases) -> DataFrame:
    if isinstance(stage, S.Lookup):
        return lookup(df, stage, bases(stage.schema, stage.table))
    if isinstance(stage, S.Union):
        return union(df, bases(stage.schema, stage.table))
    return _ROWWISE[type(stage)](df, stage)


def run(df: DataFrame, stages: tuple[S.Stage, ...], bases: Bases) -> DataFrame:
    """All stages in order; a $lookup whose array the next stage unwinds becomes an inner join."""
    i = 0
    while i < len(stages):
        s = stages[i]
        if isinstance(s, S.Lookup) and i + 1 < len(stages) and stages[i + 1] == S.Unwind(s.name):
            df = lookup_unwound(df, s, bases(s.schema, s.table))
            i += 2
        else:
            df = apply(df, s, bases)
            i += 1
    return df
