"""The intermediate form that builder, query string and JSON share."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Predicate:
    member: str
    op: str
    value: Any = None
    value2: Any = None
    from_incl: bool = True
    to_incl: bool = True


@dataclass(frozen=True)
class And:
    children: tuple = ()


@dataclass(frozen=True)
class Or:
    children: tuple = ()


@dataclass(frozen=True)
class Not:
    child: Any = None


Node = Predicate | And | Or | Not


@dataclass(frozen=True)
class Sort:
    member: str | None  # None: the primary key
    descending: bool = False


@dataclass(frozen=True)
class Query:
    filter: Node | None = None
    sorts: tuple[Sort, ...] = ()
    skip: int = 0
    take: int | None = None
    key_from: Any = None
    key_from_incl: bool = True
    key_to: Any = None
    key_to_incl: bool = True
    has_from: bool = False
    has_to: bool = False
    extra: dict = field(default_factory=dict, compare=False)
