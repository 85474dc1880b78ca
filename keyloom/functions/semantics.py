"""The exactness rules: what a null is, two-valued predicates, tie-breaks, literals.

A null behaves as its type's default (0, False, year 1, the empty binary) in predicates and orderings; a null string stays
below every string and equals only null. Predicates have two values, so NOT is pushed down to the leaves, where each
comparison has an exact opposite. Every leaf is a plain comparison, which Parquet readers can use, and only where a null
satisfies it an IS NULL beside it.
"""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import uuid
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EQUAL, AT_LEAST, GREATER, AT_MOST, LESS, BETWEEN, PREFIX = "eq", "gte", "gt", "lte", "lt", "between", "prefix"
OPS = (EQUAL, AT_LEAST, GREATER, AT_MOST, LESS, BETWEEN, PREFIX)

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_RANGES = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def default_of(kind: T.DataType) -> Any:
    """What null stands for; None where it stands for itself (strings and nested types)."""
    if isinstance(kind, T.BooleanType):
        return False
    if isinstance(kind, _INTEGRAL):
        return 0
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return 0.0
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(0)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return dt.datetime(1, 1, 1)
    if isinstance(kind, T.DateType):
        return dt.date(1, 1, 1)
    if isinstance(kind, T.DayTimeIntervalType):
        return dt.timedelta(0)
    if isinstance(kind, T.BinaryType):
        return b""
    return None


def coerce(value: Any, kind: T.DataType) -> Any:
    """A literal as the field's type; ValueError where it cannot be one."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else "true" if value is True else "false" if value is False else str(value)
        if isinstance(kind, T.BooleanType):
            if isinstance(value, str):
                return {"true": True, "false": False}[value.strip().lower()]
            return bool(value)
        if isinstance(kind, _INTEGRAL):
            number = int(value.strip()) if isinstance(value, str) else int(value)
            if isinstance(value, float) and value != number:
                raise ValueError
            bits = _RANGES[type(kind)]
            if not -(1 << bits - 1) <= number < 1 << bits - 1:
                raise ValueError
            return number
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(str(value))
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            value = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
            return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(value) if isinstance(value, str) else value
        if isinstance(kind, T.BinaryType):
            return base64.b64decode(value, validate=True) if isinstance(value, str) else bytes(value)
        if isinstance(kind, T.DayTimeIntervalType):
            return value if isinstance(value, dt.timedelta) else dt.timedelta(seconds=float(value))
    except (ValueError, KeyError, TypeError, decimal.InvalidOperation, AttributeError):
        raise ValueError(f"{value!r} is not a {kind.simpleString()}") from None
    return str(value) if isinstance(value, uuid.UUID) else value


def literal(value: Any, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType) and value is not None:
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f").rjust(26, "0")).cast(kind)
    return F.lit(value).cast(kind)


def _holds(op: str, x: Any, low: Any, high: Any, low_in: bool, high_in: bool) -> bool:
    """A comparison of plain values; None is below everything."""

    def order(a, b):
        if a is None or b is None:
            return (a is not None) - (b is not None)
        return (a > b) - (a < b)

    if op == PREFIX:
        return x is not None and str(x).startswith(low or "")
    c = order(x, low)
    if op == BETWEEN:
        d = order(x, high)
        return (c > 0 or low_in and c == 0) and (d < 0 or high_in and d == 0)
    return {EQUAL: c == 0, AT_LEAST: c >= 0, GREATER: c > 0, AT_MOST: c <= 0, LESS: c < 0}[op]


def comparison(column: Column, kind: T.DataType, op: str, low: Any, high: Any = None, low_in: bool = True, high_in: bool = True, negate: bool = False) -> Column:
    """A leaf, or its opposite: true where it holds, false or null elsewhere."""
    default = default_of(kind)
    if op == PREFIX:
        if not isinstance(kind, T.StringType):
            return F.lit(negate)
        hit = column.startswith(low or "") if low else column.isNotNull()
        return (~hit | column.isNull()) if negate else hit
    low = default if low is None else low
    high = default if high is None else high
    null_holds = _holds(op, default, low, high, low_in, high_in) != negate
    if low is None and op != BETWEEN or op == BETWEEN and (low is None or high is None):
        base = _against_null_string(column, kind, op, low, high, low_in, high_in, negate)
    else:
        a = literal(low, kind)
        if op == BETWEEN:
            b = literal(high, kind)
            if negate:
                base = (column < a if low_in else column <= a) | (column > b if high_in else column >= b)
            else:
                base = (column >= a if low_in else column > a) & (column <= b if high_in else column < b)
        else:
            plain = {EQUAL: column == a, AT_LEAST: column >= a, GREATER: column > a, AT_MOST: column <= a, LESS: column < a}
            opposite = {EQUAL: column != a, AT_LEAST: column < a, GREATER: column <= a, AT_MOST: column > a, LESS: column >= a}
            base = (opposite if negate else plain)[op]
    return base | column.isNull() if null_holds else base


def _against_null_string(column, kind, op, low, high, low_in, high_in, negate) -> Column:
    """Non-null strings compared with null, which is below them all."""
    if op == BETWEEN and low is None and high is not None:
        hit = column <= literal(high, kind) if high_in else column < literal(high, kind)
        return ~hit if negate else hit
    above = op in (AT_LEAST, GREATER)
    return column.isNotNull() if above != negate else F.lit(False)


def ordering(column: Column, kind: T.DataType, descending: bool) -> Column:
    """Nulls in their place: strings below all others, other types at their default."""
    default = default_of(kind)
    if default is not None:
        column = F.coalesce(column, literal(default, kind))
    return column.desc_nulls_last() if descending else column.asc_nulls_first()
