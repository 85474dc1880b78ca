"""The fluent builder. Predicates fold from left to right: each joins what came before by AND, or by OR after or_();
there is no precedence, a OR b AND c is (a OR b) AND c. group() nests."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from keyloom.functions import semantics as S
from keyloom.plans import lower as L
from keyloom.plans.ir import And, Node, Not, Or, Predicate, Query, Sort

if TYPE_CHECKING:
    from collections.abc import Callable

    from keyloom.operators.table import Table


class _Filters:
    """Predicates of the query, or of one group."""

    def __init__(self, table: Table, field: str | None = None):
        self._table, self._field, self._node, self._or = table, field, None, False
        if field is not None:
            self._select(field)

    def _select(self, field: str):
        L.field_type(self._table.df.schema, field)
        self._field = field
        return self

    def query(self, field: str):
        return self._select(field)

    def and_(self, field: str | None = None):
        self._or = False
        return self if field is None else self._select(field)

    def or_(self, field: str | None = None):
        self._or = True
        return self if field is None else self._select(field)

    def _combine(self, node: Node):
        if self._node is None:
            self._node = node
        else:
            self._node = (Or if self._or else And)((self._node, node))
        self._or = False
        return self

    def _predicate(self, op: str, value: Any, value2: Any = None, from_incl: bool = True, to_incl: bool = True, negate: bool = False):
        if self._field is None:
            raise ValueError("choose a field first")
        kind = L.field_type(self._table.df.schema, self._field)
        if op != S.PREFIX:
            value, value2 = S.coerce(value, kind), S.coerce(value2, kind)
        node = Predicate(self._field, op, value, value2, from_incl, to_incl)
        return self._combine(Not(node) if negate else node)

    def equal(self, value):
        return self._predicate(S.EQUAL, value)

    def at_least(self, value):
        return self._predicate(S.AT_LEAST, value)

    def greater_than(self, value):
        return self._predicate(S.GREATER, value)

    def at_most(self, value):
        return self._predicate(S.AT_MOST, value)

    def less_than(self, value):
        return self._predicate(S.LESS, value)

    def between(self, low, high, from_incl: bool = True, to_incl: bool = True):
        return self._predicate(S.BETWEEN, low, high, from_incl, to_incl)

    def starts_with(self, prefix: str | None):
        return self._predicate(S.PREFIX, prefix)

    def not_equal(self, value):
        return self._predicate(S.EQUAL, value, negate=True)

    def not_at_least(self, value):
        return self._predicate(S.AT_LEAST, value, negate=True)

    def not_greater_than(self, value):
        return self._predicate(S.GREATER, value, negate=True)

    def not_at_most(self, value):
        return self._predicate(S.AT_MOST, value, negate=True)

    def not_less_than(self, value):
        return self._predicate(S.LESS, value, negate=True)

    def not_between(self, low, high, from_incl: bool = True, to_incl: bool = True):
        return self._predicate(S.BETWEEN, low, high, from_incl, to_incl, negate=True)

    def group(self, build: Callable[[_Filters], Any]):
        """What the group says, as one predicate; an empty group adds nothing."""
        inner = _Filters(self._table)
        build(inner)
        return self if inner._node is None else self._combine(inner._node)


class QueryBuilder(_Filters):
    def __init__(self, table: Table, field: str | None = None):
        super().__init__(table, field)
        self._query = Query()

    @property
    def ir(self) -> Query:
        return replace(self._query, filter=self._node)

    def _set(self, **changes):
        self._query = replace(self._query, **changes)
        return self

    # Key range: later calls overwrite earlier ones.
    def key_equal(self, value):
        return self._set(key_from=value, key_to=value, key_from_incl=True, key_to_incl=True, has_from=True, has_to=True)

    def key_at_least(self, value):
        return self._set(key_from=value, key_from_incl=True, has_from=True)

    def key_greater_than(self, value):
        return self._set(key_from=value, key_from_incl=False, has_from=True)

    def key_at_most(self, value):
        return self._set(key_to=value, key_to_incl=True, has_to=True)

    def key_less_than(self, value):
        return self._set(key_to=value, key_to_incl=False, has_to=True)

    def key_between(self, low, high, from_incl: bool = True, to_incl: bool = True):
        return self._set(key_from=low, key_to=high, key_from_incl=from_incl, key_to_incl=to_incl, has_from=True, has_to=True)

    def _sort(self, member: str | None, descending: bool):
        if member is not None:
            L.field_type(self._table.df.schema, member)
        return self._set(sorts=(*self._query.sorts, Sort(member, descending)))

    def order_by(self, field: str):
        return self._sort(field, False)

    def order_by_descending(self, field: str):
        return self._sort(field, True)

    def order_by_key(self):
        return self._sort(None, False)

    def order_by_key_descending(self):
        return self._sort(None, True)

    then_by, then_by_descending, then_by_key, then_by_key_descending = order_by, order_by_descending, order_by_key, order_by_key_descending

    def skip(self, n: int):
        return self._set(skip=max(0, n))

    def take(self, n: int | None):
        return self._set(take=n)

    def df(self) -> DataFrame:
        return L.lower(self._table.df, self._table.keys, self.ir)

    def count_df(self) -> DataFrame:
        return L.count(self._table.df, self._table.keys, self.ir)

    def count(self) -> int:
        return self.count_df().first()["count"]

    def exists_df(self) -> DataFrame:
        return L.exists(self._table.df, self._table.keys, self.ir)

    def exists(self) -> bool:
        return self.exists_df().first()["exists"]

    def explain(self, spark_plan: bool = False) -> str:
        """The access path and, if asked for, Spark's plan."""
        path = self._table.planner.plan(self.ir).explain()
        if not spark_plan:
            return path
        return f"{path}\n\n{self.df()._jdf.queryExecution().explainString(self._table.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}"
