"""Equality of values across types: null equals null, numbers and decimal texts compare by value."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A plain decimal: no exponent, no inf or nan.
DECIMAL_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"
_WIDE = T.DecimalType(38, 18)


def as_number(value: Any) -> Decimal | None:
    """The number that a literal stands for, if it is one or spells one."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int | Decimal):
        return Decimal(value)
    if isinstance(value, float):
        value = repr(value)
    return Decimal(value.strip()) if isinstance(value, str) and re.match(DECIMAL_TEXT, value) else None


def equals(column: Column, kind: T.DataType, value: Any) -> Column:
    """column = value by the rules above, for a column of this type; never null."""
    if value is None:
        return column.isNull()
    number = as_number(value)
    if isinstance(kind, T.BooleanType):
        return column.eqNullSafe(F.lit(value)) if isinstance(value, bool) else F.lit(False)
    if isinstance(kind, T.StringType):
        same = column.eqNullSafe(F.lit(value)) if isinstance(value, str) else F.lit(False)
        if number is None:
            return same
        spelled = F.when(column.rlike(DECIMAL_TEXT), F.trim(column)).try_cast(_WIDE)
        return same | F.coalesce(spelled == F.lit(number).cast(_WIDE), F.lit(False))
    if isinstance(kind, T.DecimalType | T.IntegralType):
        if number is None:
            return F.lit(False)
        places = max(0, -number.as_tuple().exponent)
        target = T.DecimalType(38, min(38, max(places, getattr(kind, "scale", 0))))
        return F.coalesce(column.try_cast(target) == F.lit(str(number)).try_cast(target), F.lit(False))
    if isinstance(kind, T.FractionalType):
        return F.coalesce(column == F.lit(float(number)), F.lit(False)) if number is not None else F.lit(False)
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.coalesce(F.to_json(column) == F.lit(json.dumps(value, separators=(",", ":"))), F.lit(False))
    return column.cast("string").eqNullSafe(F.lit(str(value)))


def key_pair(left: Column, left_kind: T.DataType, right: Column, right_kind: T.DataType) -> tuple[Column, Column]:
    """Both sides of a join on values, as columns whose null-safe equality is the equality above; an equi-join stays one."""
    if left_kind == right_kind and not isinstance(left_kind, T.StringType):
        return left, right
    if isinstance(left_kind, T.IntegralType) and isinstance(right_kind, T.IntegralType):
        return left.cast("long"), right.cast("long")
    if isinstance(left_kind, T.NumericType) and isinstance(right_kind, T.NumericType):
        return left.cast(_WIDE), right.cast(_WIDE)
    return _text_key(left, left_kind), _text_key(right, right_kind)


def _text_key(column: Column, kind: T.DataType) -> Column:
    """Numbers and texts that spell one, in one spelling; any other text as it is, with a mark before it."""
    if isinstance(kind, T.NumericType):
        return F.concat(F.lit("n:"), column.cast(_WIDE).cast("string"))
    if isinstance(kind, T.StringType):
        number = F.when(column.rlike(DECIMAL_TEXT), F.trim(column)).try_cast(_WIDE).cast("string")
        return F.coalesce(F.concat(F.lit("n:"), number), F.concat(F.lit("t:"), column))
    return F.concat(F.lit("t:"), column.cast("string"))


def literal(value: Any) -> Column:
    """A constant column for a literal of a definition: lists as arrays, maps as structs."""
    if isinstance(value, list):
        return F.array(*map(literal, value)) if value else F.array().cast("array<string>")
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()]) if value else F.expr("named_struct()")
    return F.lit(value)
