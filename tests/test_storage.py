"""Mutations, migration, databases, files, the service and streams."""

import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.cli import parser, run
from keyloom.operators import mutations, navigation
from keyloom.operators.blob import BLOCK, SCHEMA, BlobFile, assemble
from keyloom.operators.migration import migrate
from keyloom.operators.table import Table, UniqueViolation
from keyloom.sources import connection
from keyloom.sources.database import CommitConflict, Database
from keyloom.sources.schema import from_json_schema, to_json_schema
from keyloom.sources.service import Service
from keyloom.streaming.ingest import ingest

OPS = ["REPLACE", "INSERT_OR_IGNORE", "DELETE", "DELETE_RANGE", "CLEAR"]


def sequentially(base, ops):
    rows = dict(base)
    for _, op, k, to, v in sorted(ops):
        if op == "REPLACE":
            rows[k] = v
        elif op == "INSERT_OR_IGNORE":
            rows.setdefault(k, v)
        elif op == "DELETE":
            rows.pop(k, None)
        elif op == "DELETE_RANGE":
            rows = {x: y for x, y in rows.items() if not k <= x <= to}
        else:
            rows = {}
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_logs_equal_sequential_application(spark, seed):
    rng = random.Random(seed)
    base = [(k, f"b{k}") for k in range(0, 30, 2)]
    ops = []
    for s in range(60):
        op = rng.choices(OPS, [5, 5, 3, 2, 0.15 if seed % 2 else 0])[0]
        k = rng.randrange(32)
        ops.append((s, op, k, k + rng.randrange(-1, 5), None if op == "REPLACE" and rng.random() < 0.1 else f"v{s}"))
    got = mutations.resolve(spark.createDataFrame(base, "k int, v string"), spark.createDataFrame(ops, "seq long, op string, k int, key_to int, v string").repartition(3), ["k"])
    assert {r["k"]: r["v"] for r in got.collect()} == sequentially(base, ops)


@pytest.mark.parametrize("seed", range(2))
def test_composite_logs_equal_sequential_application(spark, seed):
    rng = random.Random(seed)
    pair = lambda: (rng.randrange(5), rng.choice("abcd"))
    base = [(i, c, f"b{i}{c}") for i in range(5) for c in "abcd" if rng.random() < 0.6]
    ops = [(s, rng.choices(OPS[:4], [5, 5, 3, 4])[0], pair(), pair(), f"v{s}") for s in range(40)]
    want = sequentially([((i, c), v) for i, c, v in base], ops)
    flat = [(s, op, *k, *to, v) for s, op, k, to, v in ops] + [(99, "DELETE_RANGE", None, "a", 9, "z", None)]
    log = spark.createDataFrame(flat, "seq long, op string, i int, c string, i_to int, c_to string, v string")
    got = mutations.resolve(spark.createDataFrame(base, "i int, c string, v string"), log.repartition(3), ["i", "c"])
    assert {(r["i"], r["c"]): r["v"] for r in got.collect()} == want
    with pytest.raises(ValueError, match="far end"):
        mutations.resolve(spark.createDataFrame(base, "i int, c string, v string"), log.drop("i_to", "c_to"), ["i", "c"])


def test_many_range_deletes(spark):
    n = 120_000
    log = spark.range(n).select(F.col("id").alias("seq"), F.lit("DELETE_RANGE").alias("op"), (F.col("id") * 4).alias("k"), (F.col("id") * 4 + F.col("id") % 2).alias("key_to"), F.lit("").alias("v"))
    got = mutations.resolve(spark.range(4 * n).select(F.col("id").alias("k"), F.lit("x").alias("v")), log, ["k"])
    assert got.agg(F.count(F.lit(1)), F.sum("k")).first() == (4 * n - n - n // 2, sum(range(4 * n)) - sum(4 * i + (4 * i + 1) * (i % 2) for i in range(n)))


def test_repeated_keys_need_an_order(spark):
    t = Table(spark.createDataFrame([(1, "a")], "k int, v string"), "k")
    new = spark.createDataFrame([(2, "second", 2), (2, "first", 1), (1, "new", 1)], "k int, v string, at int")
    assert dict(mutations.upsert(t, new, "at").df.collect()) == {1: "new", 2: "second"}
    assert dict(mutations.insert_or_ignore(t, new, "at").df.collect()) == {1: "a", 2: "first"}
    for change in (mutations.upsert, mutations.insert_or_ignore):
        with pytest.raises(ValueError, match="twice"):
            change(t, new)


@pytest.mark.parametrize("ranges", [1, 7, 30])
def test_positions_and_neighbours_over_ranges(spark, ranges):
    rng = random.Random(ranges)
    keys = rng.sample(range(200), 90)
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(3)
    assert sorted(map(tuple, navigation.positions(df, F.col("k"), ranges=ranges).collect())) == [(k, i) for i, k in enumerate(sorted(keys))]
    probes = [None] + [rng.choice([50, rng.randrange(-5, 205)]) for _ in range(60)]
    found = navigation.find_prev(spark.createDataFrame([(p, i) for i, p in enumerate(probes)], "p int, i int"), "p", df.union(df.sparkSession.createDataFrame([(None,)], "k int")), "k", ranges=ranges)
    assert {r["i"]: r["found_key"] for r in found.collect()} == {i: None if p is None else max((k for k in keys if k <= p), default=None) for i, p in enumerate(probes)}


def test_unknown_operation(spark):
    with pytest.raises(Exception, match="unknown operation"):
        mutations.resolve(spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "MERGE", 1, "x")], "seq long, op string, k int, v string"), ["k"]).collect()


def test_table_mutations(spark):
    t = Table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    t.create_index("u", "v", unique=True)
    new = spark.createDataFrame([(2, "x"), (3, "c")], t.df.schema)
    rows = lambda x: dict(x.df.collect())
    assert rows(mutations.upsert(t, new)) == {1: "a", 2: "x", 3: "c"}
    assert rows(mutations.insert_or_ignore(t, new)) == {1: "a", 2: "b", 3: "c"}
    assert rows(mutations.delete(t, new)) == {1: "a"} and rows(mutations.delete_range(t, 0, 1)) == {2: "b"} and rows(mutations.clear(t)) == {}
    with pytest.raises(UniqueViolation):
        mutations.upsert(t, spark.createDataFrame([(9, "a")], t.df.schema))
    assert rows(mutations.upsert(t, spark.createDataFrame([(1, "a")], t.df.schema))) == {1: "a", 2: "b"}


@pytest.mark.parametrize("seed", range(3))
def test_bulk_neighbours(spark, seed):
    rng = random.Random(seed)
    keys = sorted(rng.sample(range(200), 25)) if seed else []
    probes = [rng.randrange(-5, 210) for _ in range(80)] + [None, 7, 7]
    table, ask = spark.createDataFrame([(k,) for k in keys], "key int"), spark.createDataFrame([(p,) for p in probes], "p int").repartition(3)
    for find, pick in (
        (navigation.find_prev, lambda p: max((k for k in keys if k <= p), default=None)),
        (navigation.find_before, lambda p: max((k for k in keys if k < p), default=None)),
        (navigation.find_next, lambda p: min((k for k in keys if k >= p), default=None)),
        (navigation.find_after, lambda p: min((k for k in keys if k > p), default=None)),
    ):
        got = sorted(((r["p"], r["found_key"]) for r in find(ask, "p", table, "key", ranges=5).collect()), key=repr)
        assert got == sorted(((p, None if p is None else pick(p)) for p in probes), key=repr)


def test_migration(spark):
    df = spark.createDataFrame([(1, "a", 5)], "k int, Name string, Age int")
    to = lambda s: migrate(df, spark.createDataFrame([], s).schema, ["k"]).collect()[0].asDict()
    assert to("k int, Age int, City string, Active boolean, At timestamp_ntz") == {"k": 1, "Age": 5, "City": "", "Active": False, "At": dt.datetime(1, 1, 1)}
    with pytest.raises(ValueError):
        to("k int, Age string")
    with pytest.raises(ValueError):
        to("k long, Age int")
    assert migrate(df, spark.createDataFrame([], "k int, A string").schema, ["k"], positional=True).collect()[0].asDict() == {"k": 1, "A": "a"}


def test_database(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Database(spark, path)
    t = db.open_table("people", "id", spark.createDataFrame([], "id long, Name string").schema)
    db.put("people", mutations.upsert(t, spark.createDataFrame([(1, "a"), (2, "b")], t.df.schema)))
    db.commit()
    db.put("people", mutations.clear(db.open_table("people")))
    db.close()
    assert dict(db.open_table("people").df.collect()) == {1: "a", 2: "b"}
    other = Database(spark, path)
    assert other.tables() == ["people"] and other.descriptor("people")["keys"] == ["id"]
    log = spark.createDataFrame([(1, "REPLACE", 3, "c"), (2, "DELETE", 1, None)], "seq long, op string, id long, Name string")
    other.apply("people", log)
    other.commit()
    assert dict(Database(spark, path).open_table("people").df.collect()) == {2: "b", 3: "c"}
    wide = other.open_table("people", "id", spark.createDataFrame([], "id long, Name string, Age int").schema)
    assert sorted(map(tuple, wide.df.collect())) == [(2, "b", 0), (3, "c", 0)]
    assert other.rename("people", "folk") and not other.rename("people", "x") and other.exists("folk") and other.drop("folk") and not other.drop("folk")
    for bad in ("__x", "", "a/b"):
        with pytest.raises(ValueError):
            other.open_table(bad, "id", wide.df.schema)
    with pytest.raises(KeyError):
        other.open_table("missing")


def test_files(spark):
    rng = random.Random(3)
    table, model = spark.createDataFrame([("other", 0, bytearray(b"x"))], SCHEMA), io.BytesIO()
    f = BlobFile(table, "f")
    for _ in range(8):
        at, data = rng.randrange(3 * BLOCK), bytes(rng.randrange(256) for _ in range(rng.randrange(1, 2 * BLOCK)))
        for x in (f, model):
            x.seek(at)
            x.write(data)
    f.truncate(2 * BLOCK + 7)
    model.truncate(2 * BLOCK + 7)
    f = BlobFile(f.table(), "f")
    f.seek(-5, io.SEEK_END)
    assert f.read() == model.getvalue()[-5:] and f.seek(0) == 0 and f.read() == model.getvalue()
    f.truncate(3 * BLOCK)
    f.seek(4 * BLOCK)
    f.write(b"end")
    f.seek(0)
    whole = model.getvalue().ljust(4 * BLOCK, b"\0") + b"end"
    assert f.read() == whole
    assert {r["file"]: bytes(r["content"]) for r in assemble(f.table()).collect()} == {"other": b"x", "f": whole}


def test_connection_strings():
    c = connection.parse('Provider=File;Data Source="/a;b"; Compression=true')
    assert (c.provider, c.path, c.settings["compression"]) == ("file", "/a;b", "true")
    assert connection.parse("path=/x").provider == "file" and connection.parse("Host=h").provider == "network" and connection.parse("").provider == "memory"
    for bad in ("Provider=Cloud", "x", "a='b"):
        with pytest.raises(ValueError):
            connection.parse(bad)
    with pytest.raises(ValueError):
        _ = connection.parse("Provider=File").path


def test_json_schema():
    schema = {"type": "object", "required": ["b"], "properties": {"a": {"type": "integer", "format": "int32"}, "b": {"type": "string"}, "c": {"type": "array", "items": {"type": "number"}}, "d": {"type": "string", "format": "date-time"}}}
    kind = from_json_schema(schema)
    assert kind.simpleString() == "struct<b:string,a:int,c:array<double>,d:timestamp_ntz>"
    assert from_json_schema(to_json_schema(kind)) == kind
    for bad in ({}, {"type": "any"}, {"type": "object"}, {"type": "array"}, {"type": "object", "required": ["x"], "properties": {"a": {"type": "string"}}}):
        with pytest.raises(ValueError):
            from_json_schema(bad)
    with pytest.raises(ValueError):
        to_json_schema(T.MapType(T.StringType(), T.StringType()))


def test_service_and_cli(spark, tmp_path):
    s = Service(Database(spark))
    s.create_table("p", {"type": "integer"}, {"type": "object", "properties": {"City": {"type": "string"}, "Age": {"type": "integer"}}})
    s.put("p", [{"key": i, "value": {"City": ["nyc", "la"][i % 2], "Age": i % 7}} for i in range(60)])
    s.insert("p", [{"key": 1, "value": {"City": "no"}}, {"key": 60, "value": {"City": "rome"}}])
    out = s.get("p", "City=nyc&limit=5&count=true")
    assert (out["total"], out["count"], out["take"]) == (30, 5, 5) and out["rows"][0] == {"key": 0, "value": {"City": "nyc", "Age": 0}}
    assert s.get("p", "fromKey=3&limit=2&offset=1")["rows"][0]["key"] == 4 and s.get("p")["count"] == 50
    assert s.get_row("p", "60")["value"] == {"City": "rome", "Age": None}
    s.delete("p", [60])
    with pytest.raises(KeyError):
        s.get_row("p", 60)
    s.create_index("p", "city", ["City"])
    assert s.explain("p", "City=nyc") == "Fetch\n  IndexEqualSeek(City == ?, idx=city)"
    s.rebuild_index("p", "city")
    assert s.drop_index("p", "city")
    with pytest.raises(ValueError):
        s.put("p", [{"key": 1, "value": {"Nope": 1}}])
    call = lambda *a: run(spark, parser().parse_args(["--db", str(tmp_path / "cli"), *a]))
    call("table-create", "t", '{"type": "integer"}', '{"type": "object", "properties": {"n": {"type": "string"}}}')
    call("row-put", "t", "5", '{"n": "five"}')
    assert call("row-get", "t", "5") == {"key": 5, "value": {"n": "five"}} and call("table-list") == ["t"]
    assert call("row-query", "t", '{"filter": {"field": "n", "value": "five"}}')["count"] == 1
    assert call("row-browse", "t", "--from-key", "6")["count"] == 0


def test_writers_do_not_lose_each_others_commits(spark, tmp_path):
    path = str(tmp_path / "db")
    schema = spark.createDataFrame([], "id long, Name string").schema
    a = Database(spark, path)
    a.open_table("t", "id", schema)
    a.commit()
    b = Database(spark, path)
    for db, name in ((a, "a"), (b, "b")):
        db.put("t", mutations.upsert(db.open_table("t"), spark.createDataFrame([(1, name)], schema)))
    a.commit()
    with pytest.raises(CommitConflict):
        b.commit()
    assert dict(Database(spark, path).open_table("t").df.collect()) == {1: "a"}
    b._versions = lambda: [b.version]  # as if the other commit came in between the check and the rename
    with pytest.raises(CommitConflict):
        b.commit()
    assert a.vacuum() == 2 and dict(Database(spark, path).open_table("t").df.collect()) == {1: "a"}


def test_rebuilding_keeps_the_index(spark):
    s = Service(Database(spark))
    s.create_table("p", {"type": "integer"}, {"type": "object", "properties": {"City": {"type": "string"}}})
    s.put("p", [{"key": 1, "value": {"City": "x"}}, {"key": 2, "value": {"City": "y"}}])
    s.create_index("p", "city", ["City"], unique=True)
    t = s.database.open_table("p")
    s.database.put("p", t.with_df(t.df.withColumn("City", F.lit("same"))))
    with pytest.raises(UniqueViolation):
        s.rebuild_indexes("p")
    assert [i.name for i in s.database.open_table("p").list_indexes()] == ["city"]


def test_two_streams_feed_one_table(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.open_table("t", "id", spark.createDataFrame([], "id long, Name string").schema)
    db.commit()
    kind = "seq long, op string, id long, Name string"
    for i in (1, 2):
        source = str(tmp_path / f"log{i}")
        spark.createDataFrame([(i, "REPLACE", i, "x")], kind).coalesce(1).write.parquet(source)
        for _ in range(2):  # the second run has nothing new
            ingest(spark.readStream.schema(kind).parquet(source), db, "t", str(tmp_path / f"checkpoint{i}"), available_now=True).awaitTermination()
    assert Database(spark, str(tmp_path / "db")).open_table("t").count() == 2


def test_stream(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    schema = spark.createDataFrame([], "id long, Name string").schema
    db.open_table("t", "id", schema)
    db.commit()
    source = str(tmp_path / "log")
    for rows in ([(1, "REPLACE", 1, "a"), (2, "REPLACE", 2, "b")], [(3, "DELETE", 1, None), (4, "INSERT_OR_IGNORE", 2, "z")]):
        spark.createDataFrame(rows, "seq long, op string, id long, Name string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("seq long, op string, id long, Name string").parquet(source)
        ingest(stream, db, "t", str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert dict(Database(spark, str(tmp_path / "db")).open_table("t").df.collect()) == {2: "b"}
