"""Lowers the intermediate form to DataFrame expressions; Catalyst does the rest."""

from __future__ import annotations

import functools
import operator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import semantics as S
from keyloom.plans.ir import And, Node, Not, Or, Predicate, Query, Sort


def field_type(schema: T.StructType, name: str) -> T.DataType:
    if name not in schema.names:
        raise ValueError(f"unknown field {name!r}")
    kind = schema[name].dataType
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        raise ValueError(f"field {name!r} is nested and can be neither filtered nor ordered")
    return kind


def condition(node: Node | None, schema: T.StructType, negate: bool = False) -> Column:
    """A Column that is true exactly where the node holds (or, negated, does not)."""
    if node is None:
        return F.lit(not negate)
    if isinstance(node, Predicate):
        kind = field_type(schema, node.member)
        low, high = (S.coerce(v, kind) if node.op != S.PREFIX else v for v in (node.value, node.value2))
        return S.comparison(F.col(f"`{node.member}`"), kind, node.op, low, high, node.from_incl, node.to_incl, negate)
    if isinstance(node, Not):
        return condition(node.child, schema, not negate)
    both = isinstance(node, And) != negate
    parts = [condition(c, schema, negate) for c in node.children]
    return functools.reduce(operator.and_ if both else operator.or_, parts) if parts else F.lit(both)


def key_bound(keys: list[str], schema: T.StructType, value: Any, op: str) -> Column:
    """A comparison with a key value; composite keys compare member by member, and the first member alone as well, which
    readers can use to skip row groups."""
    values = [value] if len(keys) == 1 else list(value) if isinstance(value, (list, tuple)) else []
    if len(values) != len(keys):
        raise ValueError(f"a key has {len(keys)} members: {keys}")
    kinds = [field_type(schema, k) for k in keys]
    literals = [S.literal(S.coerce(v, t), t) for v, t in zip(values, kinds, strict=True)]
    columns = [F.col(f"`{k}`") for k in keys]
    compare = {S.EQUAL: operator.eq, S.AT_LEAST: operator.ge, S.GREATER: operator.gt, S.AT_MOST: operator.le, S.LESS: operator.lt}[op]
    if len(keys) == 1:
        return compare(columns[0], literals[0])
    if op == S.EQUAL:
        return functools.reduce(operator.and_, [c == v for c, v in zip(columns, literals, strict=True)])
    last = compare(columns[-1], literals[-1])
    strict = operator.gt if op in (S.AT_LEAST, S.GREATER) else operator.lt
    for c, v in reversed(list(zip(columns[:-1], literals[:-1], strict=True))):
        last = strict(c, v) | ((c == v) & last)
    loose = operator.ge if strict is operator.gt else operator.le
    return loose(columns[0], literals[0]) & last


def key_condition(q: Query, keys: list[str], schema: T.StructType) -> Column | None:
    out = None
    for there, value, incl, ops in ((q.has_from, q.key_from, q.key_from_incl, (S.AT_LEAST, S.GREATER)), (q.has_to, q.key_to, q.key_to_incl, (S.AT_MOST, S.LESS))):
        if there:
            c = key_bound(keys, schema, value, ops[not incl])
            out = c if out is None else out & c
    return out


def orderings(sorts: tuple[Sort, ...], keys: list[str], schema: T.StructType) -> list[Column]:
    """The sort keys and, in the direction of the first, the primary key, so that the order is total."""
    out, keyed = [], False
    for s in sorts:
        if s.member is None:
            out += [F.col(f"`{k}`").desc() if s.descending else F.col(f"`{k}`").asc() for k in keys]
            keyed = True
        else:
            out.append(S.ordering(F.col(f"`{s.member}`"), field_type(schema, s.member), s.descending))
    if not keyed:
        down = bool(sorts) and sorts[0].descending
        out += [F.col(f"`{k}`").desc() if down else F.col(f"`{k}`").asc() for k in keys]
    return out


def matching(df: DataFrame, keys: list[str], q: Query) -> DataFrame:
    out = df
    if (k := key_condition(q, keys, df.schema)) is not None:
        out = out.filter(k)
    if q.filter is not None:
        out = out.filter(condition(q.filter, df.schema))
    return out


def lower(df: DataFrame, keys: list[str], q: Query) -> DataFrame:
    """The rows of a query. With skip or take and no order, in key order, so that pages are deterministic."""
    if q.skip < 0:
        raise ValueError("skip is negative")
    out = matching(df, keys, q)
    if q.take is not None and q.take <= 0:
        return out.limit(0)
    if q.sorts or q.skip or q.take is not None:
        out = out.orderBy(*orderings(q.sorts, keys, df.schema))
    if q.skip:
        out = out.offset(q.skip)
    return out if q.take is None else out.limit(q.take)


def count(df: DataFrame, keys: list[str], q: Query) -> DataFrame:
    """One row, count: the matches after skip and take. Order plays no part, so nothing is sorted."""
    n = F.greatest(F.count(F.lit(1)) - q.skip, F.lit(0).cast("long"))
    n = n if q.take is None else F.least(n, F.lit(max(0, q.take)).cast("long"))
    return matching(df, keys, q).agg(n.alias("count"))


def exists(df: DataFrame, keys: list[str], q: Query) -> DataFrame:
    """One row, exists. One row is enough to tell, so no more are read than needed."""
    if q.take is not None and q.take <= 0:
        return df.sparkSession.range(1).select(F.lit(False).alias("exists"))
    return matching(df, keys, q).select(F.lit(1)).limit(q.skip + 1).agg((F.count(F.lit(1)) > q.skip).alias("exists"))
