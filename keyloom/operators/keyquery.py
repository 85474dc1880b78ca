"""Primary-key ranges."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import semantics as S
from keyloom.plans import lower as L


@dataclass(frozen=True)
class KeyQuery:
    low: Any = None
    high: Any = None
    low_in: bool = True
    high_in: bool = True
    has_low: bool = False
    has_high: bool = False
    prefix: str | None = None
    where: Column | Callable | None = None

    @classmethod
    def all(cls) -> KeyQuery:
        return cls()

    @classmethod
    def at_least(cls, key) -> KeyQuery:
        return cls(low=key, has_low=True)

    @classmethod
    def greater_than(cls, key) -> KeyQuery:
        return cls(low=key, low_in=False, has_low=True)

    @classmethod
    def at_most(cls, key) -> KeyQuery:
        return cls(high=key, has_high=True)

    @classmethod
    def less_than(cls, key) -> KeyQuery:
        return cls(high=key, high_in=False, has_high=True)

    @classmethod
    def between(cls, low, high, low_in: bool = True, high_in: bool = True) -> KeyQuery:
        return cls(low, high, low_in, high_in, True, True)

    @classmethod
    def starts_with(cls, prefix: str) -> KeyQuery:
        """Keys that begin with a prefix; the empty one is all keys. Reaches Parquet as StringStartsWith."""
        return cls(prefix=prefix) if prefix else cls()

    def with_filter(self, where: Column | Callable) -> KeyQuery:
        """Also a condition on the key: a Column, or a function of the key for which no Column will do; that runs as a
        vectorised UDF, batch by batch."""
        return replace(self, where=where)

    def after(self, key) -> KeyQuery:
        """From behind a cursor; the upper bound stays."""
        return replace(self, low=key, low_in=False, has_low=True)

    def condition(self, keys: list[str], schema: T.StructType) -> Column:
        parts: list[Column] = []
        if self.has_low:
            parts.append(L.key_bound(keys, schema, self.low, S.AT_LEAST if self.low_in else S.GREATER))
        if self.has_high:
            parts.append(L.key_bound(keys, schema, self.high, S.AT_MOST if self.high_in else S.LESS))
        if self.prefix is not None:
            parts.append(F.col(f"`{keys[0]}`").startswith(self.prefix))
        if isinstance(self.where, Column):
            parts.append(self.where)
        elif self.where is not None:
            test = self.where

            @F.pandas_udf(T.BooleanType())
            def opaque(key):
                return key.map(lambda k: bool(test(k)))

            parts.append(opaque(F.col(f"`{keys[0]}`") if len(keys) == 1 else F.struct(*keys)))
        return functools.reduce(operator.and_, parts) if parts else F.lit(True)
