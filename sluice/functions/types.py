"""Source column types, their Spark types, number classes, field mapping, time zones, and inferred output schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans import stages as S


class MappingError(ValueError):
    """A field mapping that does not fit the table."""


@dataclass(frozen=True)
class ColumnShape:
    name: str
    data_type: str
    precision: int | None = None
    scale: int | None = None

    @property
    def base(self) -> str:
        return re.sub(r"\s*\([^)]*\)", "", self.data_type).strip().upper()


#: Source types that are read, the widest integer and decimal that targets hold exactly, the widest RAW in bytes.
TEXTS = ("CHAR", "NCHAR", "VARCHAR2", "NVARCHAR2")
FLOATS = ("FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE")
NAIVE_TIMES = ("DATE", "TIMESTAMP", "TIMESTAMP WITH LOCAL TIME ZONE")
AWARE_TIMES = ("TIMESTAMP WITH TIME ZONE",)
LONG_DIGITS, DECIMAL_DIGITS, RAW_BYTES = 18, 34, 2000


def number_class(precision: int | None, scale: int | None) -> str:
    """long, decimal, or unsafe: a number that targets cannot hold exactly."""
    scale = scale or 0
    if precision is None or not 0 < precision <= 38 or not 0 <= scale <= precision:
        return "unsafe"
    if scale == 0 and precision <= LONG_DIGITS:
        return "long"
    return "decimal" if precision <= DECIMAL_DIGITS else "unsafe"


def supported(c: ColumnShape, size: int | None = None) -> bool:
    return c.base in ("NUMBER", *TEXTS, *FLOATS, *NAIVE_TIMES, *AWARE_TIMES) or (c.base == "RAW" and (size or 0) <= RAW_BYTES)


def spark_type(c: ColumnShape) -> T.DataType:
    if c.base == "NUMBER":
        kind = number_class(c.precision, c.scale)
        if kind == "long":
            return T.LongType()
        if c.precision and 0 < c.precision <= 38 and 0 <= (c.scale or 0) <= c.precision:
            return T.DecimalType(c.precision, c.scale or 0)
        return T.StringType()
    if c.base in FLOATS:
        return T.DoubleType()
    return T.TimestampType() if c.base in (*NAIVE_TIMES, *AWARE_TIMES) else T.StringType()


def truncated(column: Column, precision: int, scale: int) -> Column:
    """A decimal of that scale; digits beyond it are cut off, not rounded."""
    text = column.cast("string")
    cut = F.regexp_replace(text, rf"(\.[0-9]{{{scale}}})[0-9]+$", "$1") if scale else F.regexp_replace(text, r"\.[0-9]+$", "")
    return cut.cast(T.DecimalType(precision, scale))


def zone_of(database: str | None, configured: str | None) -> str:
    """The zone of naive times: the database's, else the configured one; an error if neither is usable."""
    for zone in (database, configured):
        if zone and zone.strip():
            zone = zone.strip()
            if re.fullmatch(r"[+-](0\d|1[0-4]):[0-5]\d", zone):
                return zone
            try:
                return ZoneInfo(zone).key
            except (KeyError, ValueError, OSError):
                continue
    raise MappingError("naive times need a time zone, as an IANA name or +HH:MM")


def to_utc(column: Column, zone: str) -> Column:
    """A naive local time as an instant. Local times that a zone skips are an error; of those it has twice, too."""
    local = column.cast("timestamp")
    utc = F.to_utc_timestamp(local, zone)
    if zone[0] in "+-":
        return utc
    hour = F.expr("INTERVAL 1 HOUR")
    skipped = F.from_utc_timestamp(utc, zone) != local
    twice = (F.from_utc_timestamp(utc + hour, zone) == local) | (F.from_utc_timestamp(utc - hour, zone) == local)
    return F.when(skipped | twice, F.raise_error(F.concat(F.lit(f"no single instant in {zone}: "), local.cast("string"))).cast("timestamp")).otherwise(utc)


def mapped(df: DataFrame, fields: dict[str, str], shapes: list[ColumnShape] | None = None) -> DataFrame:
    """Managed fields for delivery: each "string" field as text, each "omit" field left out; checked before anything runs."""
    unknown = sorted(set(fields) - set(df.columns) - {s.name for s in shapes or []})
    if unknown:
        raise MappingError(f"no such field: {', '.join(unknown)}")
    for name, how in fields.items():
        if how not in ("string", "omit"):
            raise MappingError(f"{name}: as must be string or omit, not {how}")
    for s in shapes or []:
        if fields.get(s.name) == "omit":
            continue
        if s.base != "JSON" and not supported(s):
            if s.name in df.columns:
                raise MappingError(f"{s.name}: type {s.data_type} is not read; omit it")
        elif s.base == "NUMBER" and number_class(s.precision, s.scale) == "unsafe" and fields.get(s.name) != "string":
            raise MappingError(f"{s.name}: this number cannot be held exactly; map it as string or omit it")
    out = []
    for f in df.schema.fields:
        how, column = fields.get(f.name), F.col(f"`{f.name}`")
        if how != "omit":
            out.append(_plain(column, f.dataType).alias(f.name) if how == "string" else column)
    return df.select(*out)


def _plain(column: Column, kind: T.DataType) -> Column:
    """Text of a value; decimals at their scale, never with an exponent."""
    if isinstance(kind, T.DecimalType):
        return F.regexp_replace(F.format_number(column, kind.scale), ",", "") if kind.precision <= 15 else column.cast("string")
    return column.cast("string") if not isinstance(kind, T.ArrayType | T.StructType | T.MapType) else F.to_json(column)


def for_target(df: DataFrame) -> DataFrame:
    """What targets hold: times to the millisecond."""
    return df.select(*[F.date_trunc("millisecond", F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`") for f in df.schema.fields])


_AVG, _COUNT, _ANY, _JSON, _TEXT = ("NUMBER", 34, 10), ("NUMBER", 18, 0), ("NUMBER", None, None), ("JSON", None, None), ("VARCHAR2", None, None)


def derived_shapes(stages: tuple[S.Stage, ...], primary: list[ColumnShape], tables: dict[str, list[ColumnShape]] | None = None) -> list[ColumnShape]:
    """Shapes of the output columns, by name: averages NUMBER(34,10), counts NUMBER(18,0), sums and extremes as their field, arrays JSON."""
    tables = {k.upper(): v for k, v in (tables or {}).items()}
    now = {c.name: (c.data_type, c.precision, c.scale) for c in primary}
    arrays: dict[str, list[ColumnShape]] = {}
    for s in stages:
        match s:
            case S.Project(fields):
                now = {f: now[f] for f in fields if f in now}
            case S.AddFields(entries):
                for name, source in entries:
                    now[name] = now.get(source.field, _ANY) if isinstance(source, S.Copy) else _literal_shape(source.value)
            case S.Unset(fields):
                now = {k: v for k, v in now.items() if k not in fields}
            case S.Rename(pairs):
                for old, new in pairs:
                    if old in now and old != new:
                        now[new] = now.pop(old)
            case S.Lookup(table, _, _, _, name):
                now[name], arrays[name] = _JSON, tables.get(table.upper(), [])
            case S.Unwind(path):
                if path in arrays:
                    now.pop(path, None)
                    now |= {c.name: (c.data_type, c.precision, c.scale) for c in arrays.pop(path)}
            case S.Union(table, _):
                now |= {c.name: (c.data_type, c.precision, c.scale) for c in tables.get(table.upper(), []) if c.name not in now}
            case S.Group(keys, aggregates):
                kinds = {"avg": _AVG, "count": _COUNT, "add_to_set": _JSON}
                now = {k: now.get(k, _ANY) for k in keys} | {a.name: kinds.get(a.op) or now.get(a.field, _ANY) for a in aggregates}
    return [ColumnShape(n, *now[n]) for n in sorted(now)]


def _literal_shape(value) -> tuple:
    """A literal keeps its own type."""
    if isinstance(value, bool) or isinstance(value, list | dict):
        return _JSON
    return ("NUMBER", 18, 0) if isinstance(value, int) else ("BINARY_DOUBLE", None, None) if isinstance(value, float) else _TEXT
