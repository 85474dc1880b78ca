"""A keyed table: a DataFrame, its key columns and its indexes."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from keyloom.functions import semantics as S
from keyloom.operators.keyquery import KeyQuery
from keyloom.plans import lower as L
from keyloom.plans.builder import QueryBuilder
from keyloom.plans.ir import And, Or, Predicate, Query, Sort
from keyloom.plans.planner import Index, Planner


class Table:
    """An ordered map from key to record. Order is made only where it is asked for."""

    def __init__(self, df: DataFrame, keys: str | list[str], indexes: Iterable[Index] = (), name: str = "table"):
        self.df, self.keys, self.name = df, [keys] if isinstance(keys, str) else list(keys), name
        self.indexes: dict[str, Index] = {}
        for k in self.keys:
            L.field_type(df.schema, k)
        for i in indexes:
            self.create_index(i.name, *i.members, unique=i.unique, check=False)

    @property
    def record(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    @property
    def planner(self) -> Planner:
        return Planner(list(self.indexes.values()))

    def with_df(self, df: DataFrame) -> Table:
        return Table(df, self.keys, self.indexes.values(), self.name)

    def validate_keys(self) -> None:
        """ValueError if a key is null or comes twice."""
        null = F.max(F.greatest(*[F.col(f"`{k}`").isNull().cast("int") for k in [self.keys[0], *self.keys]]))
        bad = self.df.groupBy(*[f"`{k}`" for k in self.keys]).agg(F.count(F.lit(1)).alias("_n"), null.alias("_z")).where("_n > 1 or _z = 1").head(1)
        if bad:
            raise ValueError(f"{self.name}: key {[bad[0][i] for i in range(len(self.keys))]} is null or not unique")

    # Scans

    def _order(self, descending: bool = False) -> list[Column]:
        return [F.col(f"`{k}`").desc() if descending else F.col(f"`{k}`").asc() for k in self.keys]

    def forward(self, low: Any = None, high: Any = None) -> DataFrame:
        """In key order, both bounds included; ValueError if they are the wrong way round."""
        return self._bounded(low, high).orderBy(*self._order())

    def backward(self, high: Any = None, low: Any = None) -> DataFrame:
        return self._bounded(low, high).orderBy(*self._order(True))

    def _bounded(self, low: Any, high: Any) -> DataFrame:
        if low is not None and high is not None and low > high:
            raise ValueError("low > high")
        q = KeyQuery(low, high, has_low=low is not None, has_high=high is not None)
        return self.matching(q)

    def matching(self, q: KeyQuery) -> DataFrame:
        return self.df.filter(q.condition(self.keys, self.df.schema))

    def scan(self, q: KeyQuery | None = None) -> DataFrame:
        return self.matching(q or KeyQuery()).orderBy(*self._order())

    def scan_backward(self, q: KeyQuery | None = None) -> DataFrame:
        return self.matching(q or KeyQuery()).orderBy(*self._order(True))

    def scan_take(self, q: KeyQuery, take: int) -> DataFrame:
        return self.scan(q).limit(max(0, take))

    def scan_backward_take(self, q: KeyQuery, take: int) -> DataFrame:
        return self.scan_backward(q).limit(max(0, take))

    query_take, query_backward, query_backward_take = scan_take, scan_backward, scan_backward_take

    def page_after(self, q: KeyQuery, take: int, after: Any = None) -> DataFrame:
        """A page behind a cursor: a range scan at any depth."""
        return self.scan_take(q if after is None else q.after(after), take)

    def page(self, q: KeyQuery, skip: int, take: int) -> DataFrame:
        if skip < 0 or take < 0:
            raise ValueError("skip and take must not be negative")
        return self.scan(q).offset(skip).limit(take)

    def count_df(self, q: KeyQuery | None = None) -> DataFrame:
        return (self.df if q is None else self.matching(q)).agg(F.count(F.lit(1)).alias("count"))

    def count(self, q: KeyQuery | None = None) -> int:
        """Rows in a key range; 0 for bounds the wrong way round."""
        return self.count_df(q).first()["count"]

    # Points and neighbours

    def _at(self, key: Any) -> DataFrame:
        return self.df.filter(L.key_bound(self.keys, self.df.schema, key, S.EQUAL))

    def find(self, key: Any) -> Row | None:
        rows = self._at(key).head(1)
        return rows[0] if rows else None

    def __getitem__(self, key: Any) -> Row:
        row = self.find(key)
        if row is None:
            raise KeyError(key)
        return row

    def try_get(self, key: Any) -> tuple[bool, Row | None]:
        row = self.find(key)
        return row is not None, row

    def get_or_default(self, key: Any, default: Any = None) -> Any:
        row = self.find(key)
        return default if row is None else row

    def exists(self, key: Any) -> bool:
        return not self._at(key).isEmpty()

    def _edge(self, q: KeyQuery, last: bool) -> DataFrame:
        return self.scan_backward_take(q, 1) if last else self.scan_take(q, 1)

    @staticmethod
    def _one(df: DataFrame) -> Row | None:
        rows = df.collect()
        return rows[0] if rows else None

    def first_row_df(self) -> DataFrame:
        return self._edge(KeyQuery(), False)

    def last_row_df(self) -> DataFrame:
        return self._edge(KeyQuery(), True)

    def first_row(self) -> Row | None:
        return self._one(self.first_row_df())

    def last_row(self) -> Row | None:
        return self._one(self.last_row_df())

    def find_next(self, key: Any) -> Row | None:
        return self._one(self._edge(KeyQuery.at_least(key), False))

    def find_after(self, key: Any) -> Row | None:
        return self._one(self._edge(KeyQuery.greater_than(key), False))

    def find_prev(self, key: Any) -> Row | None:
        return self._one(self._edge(KeyQuery.at_most(key), True))

    def find_before(self, key: Any) -> Row | None:
        return self._one(self._edge(KeyQuery.less_than(key), True))

    def fetch(self, pks: DataFrame) -> DataFrame:
        """The records of a set of keys; missing keys are skipped. The join is broadcast only if Spark finds it small."""
        return self.df.join(pks.select(*self.keys).distinct(), self.keys, "left_semi")

    # Queries

    def query(self, field: str | None = None) -> QueryBuilder:
        return QueryBuilder(self, field)

    def group(self, build) -> QueryBuilder:
        return QueryBuilder(self).group(build)

    def run(self, q: Query) -> DataFrame:
        return L.lower(self.df, self.keys, q)

    # Indexes

    def create_index(self, name: str, *members: str, unique: bool = False, check: bool = True) -> Index:
        """Again with the same definition it does nothing, with another it fails; a unique index fails on duplicates."""
        if not members:
            raise ValueError("an index has members")
        for m in members:
            L.field_type(self.df.schema, m)
        index = Index(name, tuple(members), unique)
        if name in self.indexes:
            if self.indexes[name] != index:
                raise ValueError(f"index {name!r} exists with another definition")
            return index
        if unique and check and (bad := unique_violations(self.df, list(members)).head(1)):
            raise UniqueViolation(name, [bad[0][m] for m in members])
        self.indexes[name] = index
        return index

    def drop_index(self, name: str) -> bool:
        return self.indexes.pop(name, None) is not None

    def get_index(self, name: str) -> Index:
        if name not in self.indexes:
            raise KeyError(f"no index {name!r}")
        return self.indexes[name]

    def list_indexes(self) -> list[Index]:
        return list(self.indexes.values())

    def index_projection(self, name: str) -> DataFrame:
        """What an index holds, its fields and the key, range-partitioned and sorted: written as Parquet its row-group
        statistics are the index."""
        fields = [*self.get_index(name).members, *self.keys]
        names = list(dict.fromkeys(fields))
        return self.df.select(*names).repartitionByRange(*names).sortWithinPartitions(*names)

    def _index_query(self, name: str, values: list, range_: tuple | None = None) -> Query:
        index = self.get_index(name)
        nodes = [Predicate(m, S.EQUAL, S.coerce(v, L.field_type(self.df.schema, m))) for m, v in zip(index.members, values, strict=False)]
        if range_ is not None:
            member = index.members[0]
            low, high, low_in, high_in = range_
            kind = L.field_type(self.df.schema, member)
            if low is not None:
                nodes.append(Predicate(member, S.AT_LEAST if low_in else S.GREATER, S.coerce(low, kind)))
            if high is not None:
                nodes.append(Predicate(member, S.AT_MOST if high_in else S.LESS, S.coerce(high, kind)))
        return Query(And(tuple(nodes)))

    def find_by_index(self, name: str, *values) -> DataFrame:
        if len(values) != len(self.get_index(name).members):
            raise ValueError("a value for each member of the index, please")
        return L.lower(self.df, self.keys, self._index_query(name, list(values)))

    def find_keys_by_index(self, name: str, *values) -> DataFrame:
        return self.find_by_index(name, *values).select(*self.keys)

    def find_by_index_range(self, name: str, low=None, high=None, low_in=True, high_in=True, backward=False) -> DataFrame:
        members = self.get_index(name).members
        q = self._index_query(name, [], (low, high, low_in, high_in))
        return L.lower(self.df, self.keys, Query(q.filter, tuple(Sort(m, backward) for m in members)))

    def find_by_index_prefix(self, name: str, *values, backward: bool = False) -> DataFrame:
        members = self.get_index(name).members
        if len(members) < 2 or not 0 < len(values) < len(members):
            raise ValueError("a prefix has fewer values than a composite index has members, and one at least")
        q = self._index_query(name, list(values))
        return L.lower(self.df, self.keys, Query(q.filter, tuple(Sort(m, backward) for m in members[len(values) :])))

    def exists_in_index(self, name: str, *values) -> bool:
        return not self.find_by_index(name, *values).isEmpty()

    def count_by_index(self, name: str, *values) -> int:
        return self.find_by_index(name, *values).count()

    def find_by_all(self, *looks: tuple) -> DataFrame:
        """Rows that several lookups (index name, values ...) all find: one filter, one scan."""
        return L.lower(self.df, self.keys, Query(And(tuple(self._index_query(name, list(values)).filter for name, *values in looks))))

    def find_by_any(self, *looks: tuple) -> DataFrame:
        """Rows that one of several lookups (index name, values ...) finds: one filter, one scan."""
        return L.lower(self.df, self.keys, Query(Or(tuple(self._index_query(name, list(values)).filter for name, *values in looks))))

    def intersect_keys(self, *parts: DataFrame) -> DataFrame:
        """Keys that are in all of several sets."""
        out = parts[0].select(*self.keys).distinct()
        for p in parts[1:]:
            out = out.join(p.select(*self.keys).distinct(), self.keys, "left_semi")
        return out

    def union_keys(self, *parts: DataFrame) -> DataFrame:
        out = parts[0].select(*self.keys)
        for p in parts[1:]:
            out = out.union(p.select(*self.keys))
        return out.distinct()


class UniqueViolation(ValueError):
    def __init__(self, index: str, values: list):
        super().__init__(f"unique index {index!r} would hold {values!r} twice")
        self.index, self.values = index, values


def unique_violations(df: DataFrame, members: list[str]) -> DataFrame:
    """members, count: values that more than one row has; null counts as its type's default."""
    columns = []
    for m in members:
        kind = L.field_type(df.schema, m)
        default = S.default_of(kind)
        columns.append((F.col(f"`{m}`") if default is None else F.coalesce(F.col(f"`{m}`"), S.literal(default, kind))).alias(m))
    return df.select(*columns).groupBy(*members).agg(F.count(F.lit(1)).alias("count")).where("count > 1")
