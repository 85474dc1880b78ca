"""The data service: browse, query and change rows with dicts and query strings, as an HTTP front end would."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
from dataclasses import replace
from typing import Any

from pyspark.sql import Row
from pyspark.sql import types as T

from keyloom.operators import mutations
from keyloom.operators.table import Table, UniqueViolation, unique_violations
from keyloom.plans import lower as L
from keyloom.plans import textual
from keyloom.plans.ir import Query
from keyloom.sources.database import Database
from keyloom.sources.schema import from_json_schema, to_json_schema

#: Where a row stands in a request: of rows with one key the order decides.
ROW = "__row"


def to_json(value: Any) -> Any:
    if isinstance(value, Row):
        return {k: to_json(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [to_json(v) for v in value]
    if isinstance(value, dict):
        return {str(k): to_json(v) for k, v in value.items()}
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (decimal.Decimal, dt.timedelta)):
        return str(value)
    return value


class Service:
    """Errors: KeyError for what is not there (404), ValueError for what cannot be (400)."""

    def __init__(self, database: Database, name: str = "db"):
        self.database, self.name = database, name

    def _rows(self, table: Table, rows: list[Row]) -> list[dict]:
        out = []
        for r in rows:
            d = r.asDict()
            key = {k: to_json(d[k]) for k in table.keys}
            out.append({"key": key[table.keys[0]] if len(table.keys) == 1 else key, "value": {c: to_json(d[c]) for c in table.record}})
        return out

    def _schema(self, table: Table, names: list[str]) -> dict:
        fields = [table.df.schema[n] for n in names]
        return to_json_schema(fields[0].dataType) if len(fields) == 1 and names == table.keys else to_json_schema(T.StructType(fields))

    def run(self, table_name: str, q: Query) -> dict:
        """A page of a query in an envelope; total counts all matches, whatever the page."""
        table = self.database.open_table(table_name)
        take, skip = textual.page(q.take, q.skip)
        rows = L.lower(table.df, table.keys, replace(q, take=take, skip=skip)).collect()  # a page: MAX_PAGE rows at most
        total = L.count(table.df, table.keys, replace(q, take=None, skip=0)).first()["count"] if q.extra.get("count") else None
        return {
            "database": self.name, "table": table_name, "keySchema": self._schema(table, table.keys), "valueSchema": self._schema(table, table.record),
            "skip": skip, "take": take, "count": len(rows), "total": total, "rows": self._rows(table, rows),
        }

    def get(self, table_name: str, query_string: str = "") -> dict:
        table = self.database.open_table(table_name)
        return self.run(table_name, textual.from_query_string(query_string, table.df.schema, table.keys))

    def post_query(self, table_name: str, body: dict) -> dict:
        table = self.database.open_table(table_name)
        return self.run(table_name, textual.from_json(body, table.df.schema, table.keys))

    def explain(self, table_name: str, query_string: str = "") -> str:
        table = self.database.open_table(table_name)
        return table.planner.plan(textual.from_query_string(query_string, table.df.schema, table.keys)).explain()

    def get_row(self, table_name: str, key: Any) -> dict:
        table = self.database.open_table(table_name)
        return self._rows(table, [table[self._key(table, key)]])[0]

    def _key(self, table: Table, key: Any) -> Any:
        return textual._key([key[k] for k in table.keys] if isinstance(key, dict) else key, table.keys, table.df.schema)

    def _frame(self, table: Table, rows: list[dict]):
        data = []
        for r in rows:
            key = self._key(table, r["key"])
            values = dict(zip(table.keys, key if len(table.keys) > 1 else [key], strict=True)) | r.get("value", {})
            unknown = [c for c in values if c not in table.df.columns]
            if unknown:
                raise ValueError(f"unknown fields {unknown}")
            flat = (T.StructType, T.ArrayType, T.MapType)
            data.append(tuple(values.get(f.name) if isinstance(f.dataType, flat) or values.get(f.name) is None else textual.bind(values[f.name], f.dataType) for f in table.df.schema.fields))
        rows = [(*row, i) for i, row in enumerate(data)]
        return self.database.spark.createDataFrame(rows, T.StructType([*table.df.schema.fields, T.StructField(ROW, T.LongType())]))

    def insert(self, table_name: str, rows: list[dict]) -> None:
        table = self.database.open_table(table_name)
        self.database.put(table_name, mutations.insert_or_ignore(table, self._frame(table, rows), ROW))

    def put(self, table_name: str, rows: list[dict]) -> None:
        table = self.database.open_table(table_name)
        self.database.put(table_name, mutations.upsert(table, self._frame(table, rows), ROW))

    def delete(self, table_name: str, keys: list[Any]) -> None:
        table = self.database.open_table(table_name)
        self.database.put(table_name, mutations.delete(table, self._frame(table, [{"key": k} for k in keys])))

    def create_table(self, table_name: str, key_schema: dict, value_schema: dict) -> None:
        key, value = from_json_schema(key_schema), from_json_schema(value_schema)
        keys = key.fields if isinstance(key, T.StructType) else [T.StructField("key", key)]
        fields = value.fields if isinstance(value, T.StructType) else [T.StructField("value", value)]
        self.database.open_table(table_name, [k.name for k in keys], T.StructType([*keys, *fields]))

    def create_index(self, table_name: str, index: str, members: list[str], unique: bool = False) -> None:
        table = self.database.open_table(table_name)
        table.create_index(index, *members, unique=unique)
        self.database.put(table_name, table)

    def drop_index(self, table_name: str, index: str) -> bool:
        table = self.database.open_table(table_name)
        found = table.drop_index(index)
        self.database.put(table_name, table)
        return found

    def rebuild_index(self, table_name: str, index: str) -> None:
        """Checks a unique index anew; other indexes are projections made when they are read. The index stays whatever the
        check finds."""
        table = self.database.open_table(table_name)
        found = table.get_index(index)
        if found.unique and (bad := unique_violations(table.df, list(found.members)).head(1)):
            raise UniqueViolation(index, [bad[0][m] for m in found.members])

    def rebuild_indexes(self, table_name: str) -> None:
        for index in self.database.open_table(table_name).list_indexes():
            self.rebuild_index(table_name, index.name)
