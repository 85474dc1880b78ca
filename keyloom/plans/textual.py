"""Queries as a query string or as JSON, bound to a table's types."""

from __future__ import annotations

from typing import Any
from urllib.parse import parse_qsl

from pyspark.sql import types as T

from keyloom.functions import semantics as S
from keyloom.plans import lower as L
from keyloom.plans.ir import And, Node, Not, Or, Predicate, Query, Sort

# Operator tokens (any case) and the names in a query string that are not fields.
OPERATORS = {
    "eq": S.EQUAL, "=": S.EQUAL, "gte": S.AT_LEAST, "ge": S.AT_LEAST, ">=": S.AT_LEAST, "gt": S.GREATER, ">": S.GREATER,
    "lte": S.AT_MOST, "le": S.AT_MOST, "<=": S.AT_MOST, "lt": S.LESS, "<": S.LESS, "between": S.BETWEEN, "btw": S.BETWEEN,
    "prefix": S.PREFIX, "startswith": S.PREFIX, "sw": S.PREFIX,
}
RESERVED = {
    "order", "orderby", "sort", "limit", "offset", "skip", "take", "count", "or", "fromkey", "tokey", "direction",
    "frominclusive", "toinclusive", "fromexclusive", "toexclusive",
}
KEY_NAMES = {"$key", "key", ""}
DEFAULT_PAGE, MAX_PAGE = 50, 1000


def operator_of(token: str) -> str:
    op = OPERATORS.get(token.strip().lower())
    if op is None:
        raise ValueError(f"unknown operator {token!r}")
    return op


def bind(value: Any, kind: T.DataType) -> Any:
    """A value of a query string or JSON as the field's type. On a string field JSON that is no string is its text."""
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        import json

        return json.dumps(value)
    return S.coerce(value, kind)


def _predicate(schema: T.StructType, field: str, op: str, value: Any, value2: Any = None, from_incl: bool = True, to_incl: bool = True, absent: bool = False) -> Predicate:
    kind = L.field_type(schema, field)
    if op == S.PREFIX:
        return Predicate(field, op, None if absent else value if isinstance(value, str) else bind(value, T.StringType()))
    low = None if absent else bind(value, kind)
    return Predicate(field, op, low, bind(value2, kind) if op == S.BETWEEN else None, from_incl, to_incl)


def _from_operand(schema: T.StructType, field: str, op: str, operand: str) -> Predicate:
    if op == S.BETWEEN:
        low, colon, high = operand.partition(":")
        if not colon:
            raise ValueError(f"between on {field!r} needs two values, low:high")
        return _predicate(schema, field, op, low, high)
    return _predicate(schema, field, op, operand)


def _top_level(text: str) -> list[str]:
    """Split at commas outside parentheses."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _sort(term: str, schema: T.StructType) -> Sort:
    descending, name = term.startswith("-"), term.removeprefix("-")
    name, colon, direction = name.partition(":")
    if colon:  # said outright: overrides the dash
        descending = direction.strip().lower() == "desc"
    return _sort_of(name.strip(), descending, schema)


def _sort_of(name: str, descending: bool, schema: T.StructType) -> Sort:
    if name in KEY_NAMES:
        return Sort(None, descending)
    L.field_type(schema, name)
    return Sort(name, descending)


def _truth(text: str | None) -> bool:
    return (text or "").lower() in ("1", "true")


def _number(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def page(take: int | None, skip: int | None) -> tuple[int, int]:
    """Take within 1 to MAX_PAGE, DEFAULT_PAGE if not said, and skip not negative."""
    return min(max(DEFAULT_PAGE if take is None else take, 1), MAX_PAGE), max(0, skip or 0)


def _key(text: Any, keys: list[str], schema: T.StructType) -> Any:
    if len(keys) > 1:
        values = text if isinstance(text, (list, tuple)) else str(text).split(",")
        if len(values) != len(keys):
            raise ValueError(f"a key has {len(keys)} members: {keys}")
        return tuple(bind(v, L.field_type(schema, k)) for v, k in zip(values, keys, strict=True))
    return bind(text, L.field_type(schema, keys[0]))


def _whole(nodes: list[Node]) -> Node | None:
    return None if not nodes else nodes[0] if len(nodes) == 1 else And(tuple(nodes))


def from_query_string(text: str, schema: T.StructType, keys: list[str]) -> Query:
    """field=value, field=op:value, or=(field:op:value,...), order=field:desc,-field,$key, limit, offset, count, fromKey,
    toKey (and fromExclusive, toExclusive), direction=backward. Repeated fields are ANDed, the or group with them."""
    pairs = parse_qsl(text.lstrip("?"), keep_blank_values=True)
    said: dict[str, str] = {}
    for name, value in pairs:
        if name.lower() in RESERVED and value:
            said.setdefault(name.lower(), value)
    nodes: list[Node] = []
    for name, value in pairs:
        if name.lower() in RESERVED:
            continue
        head, colon, rest = value.partition(":")
        if colon and head and head.strip().lower() in OPERATORS:
            nodes.append(_from_operand(schema, name, operator_of(head), rest))
        else:
            nodes.append(_predicate(schema, name, S.EQUAL, value))
    if body := said.get("or", "").strip():
        body = body[1:-1] if body.startswith("(") and body.endswith(")") else body
        terms = []
        for term in _top_level(body):
            parts = term.split(":", 2)
            if len(parts) < 2:
                raise ValueError(f"{term!r} is not field:op:value")
            terms.append(_from_operand(schema, parts[0].strip(), operator_of(parts[1]), parts[2] if len(parts) > 2 else ""))
        nodes.append(terms[0] if len(terms) == 1 else Or(tuple(terms)))
    order = next((said[n] for n in ("order", "orderby", "sort") if n in said), "")
    sorts = tuple(_sort(t.strip(), schema) for t in order.split(",") if t.strip())
    if not sorts and said.get("direction", "").lower() == "backward":
        sorts = (Sort(None, True),)
    low, high = said.get("fromkey"), said.get("tokey")
    return Query(
        _whole(nodes), sorts, _number(said.get("offset") or said.get("skip")) or 0, _number(said.get("limit") or said.get("take")),
        _key(low, keys, schema) if low else None, not _truth(said.get("fromexclusive")),
        _key(high, keys, schema) if high else None, not _truth(said.get("toexclusive")),
        bool(low), bool(high), {"count": _truth(said.get("count"))},
    )


def browse(text: str, schema: T.StructType, keys: list[str]) -> Query:
    """fromKey, toKey, direction, limit and offset only: a page in key order. A bound that is no key is as good as none."""
    said = {name.lower(): value for name, value in parse_qsl(text.lstrip("?"))}

    def bound(name):
        try:
            return _key(said[name], keys, schema) if said.get(name) else None
        except (TypeError, ValueError, ArithmeticError):
            return None

    low, high = bound("fromkey"), bound("tokey")
    take, skip = page(_number(said.get("limit")), _number(said.get("offset")))
    backward = said.get("direction", "").lower() == "backward"
    return Query(None, (Sort(None, backward),), skip, take, low, True, high, True, low is not None, high is not None, {})


def _json_node(node: dict, schema: T.StructType) -> Node | None:
    for name, kind in (("and", And), ("or", Or)):
        if name in node:
            children = [c for c in (_json_node(x, schema) for x in node[name]) if c is not None]
            return children[0] if len(children) == 1 else kind(tuple(children))
    if "not" in node:
        child = _json_node(node["not"], schema)
        return None if child is None else Not(child)
    if "field" not in node:
        raise ValueError(f"{node!r} is neither a group nor a predicate")
    op = operator_of(node.get("op", "eq"))
    if op == S.BETWEEN and not {"value", "value2"} <= node.keys():
        raise ValueError(f"between on {node['field']!r} needs value and value2")
    return _predicate(schema, node["field"], op, node.get("value"), node.get("value2"), node.get("fromInclusive", True), node.get("toInclusive", True), "value" not in node)


def from_json(body: dict, schema: T.StructType, keys: list[str]) -> Query:
    """{filter, order, skip/take or offset/limit, keyFrom, keyTo, keyFromInclusive, keyToInclusive, count}."""
    said = body.get("order") or body.get("orderBy") or []
    if isinstance(said, str):
        sorts = tuple(_sort(t.strip(), schema) for t in said.split(",") if t.strip())
    else:
        sorts = tuple(_sort(x, schema) if isinstance(x, str) else _sort_of(x.get("field") or "", bool(x.get("desc") or x.get("descending")), schema) for x in said)
    low, high = body.get("keyFrom"), body.get("keyTo")
    take, skip = body.get("limit", body.get("take")), body.get("offset", body.get("skip")) or 0
    return Query(
        _json_node(body["filter"], schema) if body.get("filter") else None, sorts, skip, take,
        None if low is None else _key(low, keys, schema), body.get("keyFromInclusive", True),
        None if high is None else _key(high, keys, schema), body.get("keyToInclusive", True),
        low is not None, high is not None, {"count": bool(body.get("count"))},
    )
