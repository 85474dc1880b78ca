"""The driver's contract, and the engine's queries against DuckDB."""

import os

import duckdb
import pytest

from keyloom import queries as engine

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(rows):
    return sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_queries_equal_sql(spark, duck, name):
    df = engine.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    sql = duck.sql(engine.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    assert plain(got) == plain(sql.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
