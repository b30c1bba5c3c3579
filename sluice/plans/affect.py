"""Affect analysis over whole batches: which output identities a set of changed base rows can touch.

Changed rows go through the stages twice, as they were (over the old bases) and as they are (over the new ones). Where a
stage ties rows together, the rows tied to a changed one join in: all rows of a group, all rows whose key a changed foreign
row has or had. What comes out at the end, on either side, names every identity that can differ, vanished ones included;
nothing is read from a definition's last grouping alone, so groups of groups and renamed keys are covered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.values import key_pair
from sluice.operators import relational as R
from sluice.operators.relational import col
from sluice.plans import lineage
from sluice.plans import stages as S

Name = tuple[str | None, str]


@dataclass
class Change:
    """Net change of one base: rows before (of updates and deletes) and after (of inserts and updates), by primary key."""

    before: DataFrame
    after: DataFrame
    keys: tuple[str, ...]

    def relevant(self, used: list[str]) -> Change:
        """Without updates that touch no used field."""
        if set(used) >= set(self.before.columns):
            return self
        used = list(dict.fromkeys([*self.keys, *used]))
        both = self.before.select(*[col(k) for k in self.keys], F.struct(*[col(c) for c in used]).alias("__b")).join(self.after.select(*[col(k) for k in self.keys], F.struct(*[col(c) for c in used]).alias("__a")), list(self.keys))
        same = both.where(F.col("__b").eqNullSafe(F.col("__a"))).select(*[col(k) for k in self.keys])
        return Change(self.before.join(same, list(self.keys), "left_anti"), self.after.join(same, list(self.keys), "left_anti"), self.keys)


class Tables:
    """Old and new state of the bases, and their changes, by (schema, table); table names match in any case."""

    def __init__(self, old: dict[Name, DataFrame], new: dict[Name, DataFrame], changes: dict[Name, Change], schema: str | None = None):
        def fold(d: dict) -> dict:
            return {(s, t.upper()): v for (s, t), v in d.items()}

        self.old_rows, self.new_rows, self.changes, self.schema = fold(old), fold(new), fold(changes), schema
        self.buckets: dict[str, list[int]] = {}  # of each base's store, those that the changes touch

    def name(self, schema: str | None, table: str) -> Name:
        return (schema or self.schema, table.upper())

    def old(self, schema: str | None, table: str) -> DataFrame:
        return self.old_rows[self.name(schema, table)]

    def new(self, schema: str | None, table: str) -> DataFrame:
        return self.new_rows[self.name(schema, table)]

    def change(self, schema: str | None, table: str) -> Change | None:
        return self.changes.get(self.name(schema, table))


def semi(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of df whose columns are among keys, null equal to null."""
    right = keys.select(*[col(c).alias(f"__{i}") for i, c in enumerate(columns)]).distinct()
    on: Column | None = None
    for i, c in enumerate(columns):
        this = col(c).eqNullSafe(F.col(f"__{i}"))
        on = this if on is None else on & this
    return df.join(right, on, "left_semi")


def _matching(foreign: DataFrame, s: S.Lookup, rows: DataFrame) -> DataFrame:
    """The foreign rows whose keys are among those of rows: no others are gathered into arrays."""
    if s.local not in rows.columns or s.foreign not in foreign.columns:
        return foreign
    mine, theirs = key_pair(col(s.local), rows.schema[s.local].dataType, col(s.foreign), foreign.schema[s.foreign].dataType)
    keys = rows.select(mine.alias("__v")).distinct()
    return foreign.withColumn("__l", theirs).join(keys, F.col("__l").eqNullSafe(F.col("__v")), "left_semi").drop("__l")


def _typed(value: Column, a: T.DataType, other: T.DataType) -> Column:
    return key_pair(value, a, value, other)[0]


def affected(stages: tuple[S.Stage, ...], source: Name, tables: Tables, identity: list[str]) -> DataFrame | None:
    """The distinct identities that the changes can touch; None if no change can touch any."""
    primary = tables.change(*source)
    needs = lineage.needs_at(stages)
    old_all, new_all = tables.old(*source), tables.new(*source)
    if primary is not None:
        primary = primary.relevant(needs[0].of(old_all.columns))
        old, new = primary.before, primary.after
    else:
        old, new = old_all.limit(0), new_all.limit(0)
    touched, skip = primary is not None, -1
    for i, s in enumerate(stages):
        if i == skip:  # an $unwind that went with the $lookup before it
            continue
        if isinstance(s, S.Lookup) and needs[i + 1].has(s.name):
            change = tables.change(s.schema, s.table)
            if change is not None and s.local in old_all.columns and s.foreign in change.before.columns:
                touched = True
                used = lineage.used_secondary(stages, tables.schema if s.schema is None else s.schema, s.table, change.before.columns, tables.schema)
                change = change.relevant(used)
                kind = change.before.schema[s.foreign].dataType
                values = change.before.select(col(s.foreign).alias("__v")).union(change.after.select(col(s.foreign).alias("__v")))
                mine = old_all.schema[s.local].dataType
                values = values.select(_typed(F.col("__v"), kind, mine).alias("__v")).distinct()

                def tied(df: DataFrame, values: DataFrame = values, kind: T.DataType = kind, mine: T.DataType = mine, local: str = s.local) -> DataFrame:
                    return df.withColumn("__l", _typed(col(local), mine, kind)).join(values, F.col("__l").eqNullSafe(F.col("__v")), "left_semi").drop("__l")

                old, new = old.unionByName(tied(old_all), allowMissingColumns=True), new.unionByName(tied(new_all), allowMissingColumns=True)
            theirs = tables.old(s.schema, s.table), tables.new(s.schema, s.table)
            if i + 1 < len(stages) and stages[i + 1] == S.Unwind(s.name):  # one inner join, no arrays
                skip = i + 1
                old, new, old_all, new_all = (R.lookup_unwound(x, s, f) for x, f in zip((old, new, old_all, new_all), theirs * 2, strict=True))
            else:
                old, new = (R.lookup(x, s, _matching(f, s, x)) for x, f in zip((old, new), theirs, strict=True))
                old_all, new_all = R.lookup(old_all, s, theirs[0]), R.lookup(new_all, s, theirs[1])
        elif isinstance(s, S.Lookup):
            pass  # its array is dropped unread
        elif isinstance(s, S.Union):
            change = tables.change(s.schema, s.table)
            if change is not None:
                touched = True
                change = change.relevant(needs[i + 1].of(change.before.columns))
                old, new = R.union(old, change.before), R.union(new, change.after)
            else:  # the columns of the other side, none of its rows
                old, new = R.union(old, tables.old(s.schema, s.table).limit(0)), R.union(new, tables.new(s.schema, s.table).limit(0))
            old_all, new_all = R.union(old_all, tables.old(s.schema, s.table)), R.union(new_all, tables.new(s.schema, s.table))
        elif isinstance(s, S.Group):
            keys = [k for k in s.keys if k in old.columns]
            if keys:
                hit = old.select(*[col(k) for k in keys]).union(new.select(*[col(k) for k in keys])).distinct()
                rest = stages[i + 1 :]
                if set(identity) <= set(keys) and all(lineage.passes(t, identity) and not isinstance(t, S.Lookup) for t in rest):
                    # the rest can only drop rows of these keys: an identity too many costs a look, one too few would be wrong
                    return hit.select(*[col(c) for c in identity]).distinct() if touched else None
                # what follows may read the aggregates, so they have to be those of whole groups
                old, new = R.group(semi(old_all, hit, keys), s), R.group(semi(new_all, hit, keys), s)
                old_all, new_all = R.group(old_all, s), R.group(new_all, s)
            else:
                old, new, old_all, new_all = (R.group(x, s) for x in (old, new, old_all, new_all))
        else:
            old, new, old_all, new_all = (R.apply(x, s, tables.new) for x in (old, new, old_all, new_all))
    if not touched:
        return None
    names = [col(c) for c in identity]
    return old.select(*names).union(new.select(*names)).distinct()


def evaluate_for(identities: DataFrame, stages: tuple[S.Stage, ...], source: Name, bases: R.Bases, identity: list[str]) -> DataFrame:
    """The plan's rows for these identities: the semi-join stands before the earliest stage through which identities pass unchanged."""
    df, filtered, i = bases(*source), False, 0
    while i <= len(stages):
        rest = stages[i:]
        if not filtered and set(identity) <= set(df.columns) and all(lineage.passes(s, identity) for s in rest):
            df, filtered = semi(df, identities, identity), True
        if not rest:
            break
        if isinstance(rest[0], S.Lookup) and len(rest) > 1 and rest[1] == S.Unwind(rest[0].name):
            df = R.lookup_unwound(df, rest[0], bases(rest[0].schema, rest[0].table))
            i += 2
        else:
            df = R.apply(df, rest[0], bases)
            i += 1
    return df


def unreadable(identities: DataFrame, stages: tuple[S.Stage, ...], source: Name, bases: R.Bases, identity: list[str]) -> DataFrame | None:
    """Those of the identities whose first $group would fail on a text that spells no number, each with one such text as __text,
    found in one pass in which nothing fails; None where no texts are taken as numbers, or rows before the $group do not show their identity."""
    i = next((i for i, s in enumerate(stages) if isinstance(s, S.Group)), None)
    if i is None or not all(lineage.passes(s, identity) for s in stages[i:]):
        return None
    rows = evaluate_for(identities, stages[:i], source, bases, identity)
    text = R.no_number(rows, stages[i], lineage.needs_at(stages)[i + 1].has)
    if text is None or not set(identity) <= set(rows.columns):
        return None
    return rows.select(*[col(c) for c in identity], text.alias("__text")).where("__text IS NOT NULL").groupBy(*[col(c) for c in identity]).agg(F.min("__text").alias("__text"))


def counted_input(stages: tuple[S.Stage, ...]) -> tuple[int, S.Group] | None:
    """The distinct or $addToSet stage of a transform and its place, if it has one and ends with it."""
    for i, s in enumerate(stages):
        if isinstance(s, S.Group) and s.counted:
            return (i, s) if not any(isinstance(t, S.Group | S.Unwind | S.Lookup) for t in stages[i + 1 :]) else None
    return None


def refcounts(df: DataFrame, s: S.Group) -> DataFrame:
    """How many input rows stand behind each key, or each key and member."""
    keys = [col(k) for k in s.keys]
    if s.aggregates:
        field = s.aggregates[0].field
        return df.where(col(field).isNotNull()).groupBy(*keys, col(field).alias("__member")).agg(F.count("*").alias("refcount"))
    return df.groupBy(*keys).agg(F.count("*").alias("refcount"))
