"""Filters, orders, counts and access paths against plain Python over the same rows."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import types as T

from keyloom.operators.keyquery import KeyQuery
from keyloom.operators.table import Table, UniqueViolation
from keyloom.plans import lower as L
from keyloom.plans import textual
from keyloom.plans.ir import And, Not, Or, Predicate, Query, Sort
from keyloom.plans.planner import Index, Planner

CITIES = ["berlin", "london", "nyc", "paris"]
ROWS = [(i, CITIES[i % 4], i % 20, f"n{i % 5}") for i in range(120)]


@pytest.fixture(scope="module")
def people(spark):
    return Table(spark.createDataFrame(ROWS, "id int, City string, Age int, Name string").repartition(3), "id", [Index("City", ("City",)), Index("Age", ("Age",))])


def ids(df):
    return [r["id"] for r in df.collect()]


def want(test):
    return sorted(r[0] for r in ROWS if test(r))


@pytest.mark.parametrize(
    ("build", "test"),
    [
        (lambda t: t.query("City").equal("nyc"), lambda r: r[1] == "nyc"),
        (lambda t: t.query("Age").at_least(5).at_most(9), lambda r: 5 <= r[2] <= 9),
        (lambda t: t.query("Age").greater_than(5).less_than("9"), lambda r: 5 < r[2] < 9),
        (lambda t: t.query("Age").between(5, 9, False, True), lambda r: 5 < r[2] <= 9),
        (lambda t: t.query("City").starts_with("l"), lambda r: r[1].startswith("l")),
        (lambda t: t.query("City").not_equal("nyc").and_("Age").not_between(3, 17), lambda r: r[1] != "nyc" and not 3 <= r[2] <= 17),
        (lambda t: t.query("City").equal("nyc").or_("Age").equal(1).and_("Name").equal("n1"), lambda r: (r[1] == "nyc" or r[2] == 1) and r[3] == "n1"),
        (lambda t: t.query("Age").less_than(3).group(lambda g: g.query("City").equal("nyc").or_("City").equal("paris")), lambda r: r[2] < 3 and r[1] in ("nyc", "paris")),
        (lambda t: t.query("Age").less_than(3).or_().group(lambda g: g.query("City").equal("nyc").and_("Name").equal("n2")), lambda r: r[2] < 3 or r[1] == "nyc" and r[3] == "n2"),
        (lambda t: t.query("Age").less_than(3).group(lambda g: None), lambda r: r[2] < 3),
        (lambda t: t.query("Age").not_at_least(4).not_at_most(1), lambda r: 1 < r[2] < 4),
        (lambda t: t.query("Age").not_less_than(4).not_greater_than(6), lambda r: 4 <= r[2] <= 6),
        (lambda t: t.query("Age").between(9, 5), lambda r: False),
        (lambda t: t.query("City").equal("nyc").key_between(10, 60, False, False), lambda r: r[1] == "nyc" and 10 < r[0] < 60),
        (lambda t: t.query().key_at_least(10).key_greater_than(100), lambda r: r[0] > 100),
    ],
)
def test_filters_and_counts(people, build, test):
    q = build(people)
    assert sorted(ids(q.df())) == want(test)
    assert q.count() == len(want(test))
    assert q.exists() == bool(want(test))
    assert q.skip(2).take(3).count() == min(max(0, len(want(test)) - 2), 3)


def test_builder_errors(people):
    for bad in (lambda: people.query().equal(1), lambda: people.query("Nope"), lambda: people.query("Age").equal("x"), lambda: people.query("Age").equal(1.5), lambda: people.query().order_by("Nope")):
        with pytest.raises(ValueError):
            bad()


def test_random_trees(people):
    rng = random.Random(1)

    def tree(depth):
        kind = rng.choice(["p", "p", "and", "or", "not"]) if depth else "p"
        if kind == "p":
            op = rng.choice(["eq", "gte", "gt", "lte", "lt"])
            return Predicate("Age", op, rng.randrange(20)) if rng.random() < 0.5 else Predicate("City", rng.choice([op, "prefix"]), rng.choice(CITIES))
        if kind == "not":
            return Not(tree(depth - 1))
        return (And if kind == "and" else Or)(tuple(tree(depth - 1) for _ in range(rng.randrange(3))))

    def holds(n, r):
        if isinstance(n, Predicate):
            x = r[{"Age": 2, "City": 1}[n.member]]
            return {"eq": x == n.value, "gte": x >= n.value, "gt": x > n.value, "lte": x <= n.value, "lt": x < n.value}.get(n.op) if n.op != "prefix" else x.startswith(n.value)
        if isinstance(n, Not):
            return not holds(n.child, r)
        return (all if isinstance(n, And) else any)(holds(c, r) for c in n.children)

    for _ in range(12):
        n = tree(3)
        assert sorted(ids(people.run(Query(n)))) == want(lambda r, n=n: holds(n, r)), n


@pytest.mark.parametrize("sorts", [(("Age", False),), (("Age", True),), (("City", True), ("Age", False)), (("City", False), ("Age", True)), ((None, True),), (("Age", False), (None, True))])
def test_order_ties_and_pages(people, sorts):
    place = {"Age": 2, "City": 1, None: 0}
    rows = sorted(ROWS, key=lambda r: r[0], reverse=sorts[0][1])
    for member, down in reversed(sorts):
        rows.sort(key=lambda r: r[place[member]], reverse=down)
    q = Query(sorts=tuple(Sort(m, d) for m, d in sorts))
    assert ids(people.run(q)) == [r[0] for r in rows]
    assert ids(people.run(Query(sorts=q.sorts, skip=7, take=5))) == [r[0] for r in rows[7:12]]
    pages = list(itertools.chain(*[ids(people.run(Query(sorts=q.sorts, skip=s, take=50))) for s in (0, 50, 100)]))
    assert pages == [r[0] for r in rows]


def test_take_without_order_is_by_key(people):
    assert ids(people.query("City").equal("nyc").skip(1).take(2).df()) == want(lambda r: r[1] == "nyc")[1:3]
    assert ids(people.query().take(0).df()) == []


def test_nulls_are_defaults(spark):
    schema = "id int, At timestamp_ntz, Age int, Name string, Ok boolean"
    t = Table(spark.createDataFrame([(1, dt.datetime(2020, 1, 1), 5, "b", True), (2, dt.datetime(2021, 1, 1), None, None, None), (3, None, 0, "", False), (4, dt.datetime(1, 1, 1), -1, "a", None)], schema), "id")
    assert sorted(ids(t.query("At").equal(None).df())) == [3, 4]
    assert sorted(ids(t.query("At").equal(dt.datetime(1, 1, 1)).df())) == [3, 4]
    assert sorted(ids(t.query("At").not_equal(None).df())) == [1, 2]
    assert ids(t.query().order_by("At").df()) == [3, 4, 1, 2]
    assert sorted(ids(t.query("Age").equal(0).df())) == [2, 3]
    assert sorted(ids(t.query("Age").not_equal(5).df())) == [2, 3, 4]
    assert sorted(ids(t.query("Age").not_at_least(0).df())) == [4]
    assert sorted(ids(t.query("Age").between(-1, 0).df())) == [2, 3, 4]
    assert sorted(ids(t.query("Age").not_between(-1, 0).df())) == [1]
    assert sorted(ids(t.query("Ok").equal(False).df())) == [2, 3, 4]
    assert sorted(ids(t.query("Name").equal(None).df())) == [2]
    assert sorted(ids(t.query("Name").less_than("a").df())) == [2, 3]
    assert sorted(ids(t.query("Name").not_less_than("a").df())) == [1, 4]
    assert sorted(ids(t.query("Name").greater_than(None).df())) == [1, 3, 4]
    assert sorted(ids(t.query("Name").at_least(None).df())) == [1, 2, 3, 4]
    assert sorted(ids(t.query("Name").not_at_least(None).df())) == []
    assert sorted(ids(t.query("Name").between(None, "a").df())) == [2, 3, 4]
    assert sorted(ids(t.query("Name").starts_with(None).df())) == [1, 3, 4]
    assert ids(t.query().order_by("Name").df()) == [2, 3, 4, 1]
    assert ids(t.query().order_by_descending("Name").df()) == [1, 4, 3, 2]


def test_filters_reach_parquet(spark, people, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the list is cut short
    people.df.write.parquet(str(tmp_path / "p"))
    t = Table(spark.read.parquet(str(tmp_path / "p")), "id")
    plan = t.query("City").not_equal("nyc").and_("Age").at_least(3).key_at_least(5).df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(Age,3)" in plan and "GreaterThanOrEqual(id,5)" in plan and "Not(EqualTo(City,nyc))" in plan
    assert "TakeOrderedAndProject" in t.query().order_by("Age").take(3).df()._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(City,l)" in t.query("City").starts_with("l").df()._jdf.queryExecution().executedPlan().toString()


def path(indexes, q):
    return Planner(indexes).plan(q).explain()


def test_access_paths():
    city, age, both, name = Index("City", ("City",)), Index("Age", ("Age",)), Index("CityAge", ("City", "Age")), Index("Mail", ("Mail",), True)
    eq, low = Predicate("City", "eq", "x"), Predicate("Age", "gte", 3)
    assert path([city], Query(eq)) == "Fetch\n  IndexEqualSeek(City == ?, idx=City)"
    assert path([], Query(eq)) == "Filter\n  TableScan"
    assert path([city, age], Query(And((low, eq)))) == "Fetch\n  Intersect (AND)\n    IndexEqualSeek(City == ?, idx=City)\n    IndexRangeSeek(Age, idx=Age)"
    assert path([city, name], Query(And((eq, Predicate("Mail", "eq", "m"))))).splitlines()[2].strip() == "IndexEqualSeek(Mail == ?, idx=Mail)"
    assert path([city, age], Query(Or((eq, low)))) == "Fetch\n  Union (OR)\n    IndexEqualSeek(City == ?, idx=City)\n    IndexRangeSeek(Age, idx=Age)"
    assert path([city], Query(Or((eq, low)))) == "Filter\n  TableScan"
    assert path([city], Query(Not(eq))) == "Filter\n  TableScan"
    assert path([city], Query(And((eq, Predicate("City", "prefix", "x"))))) == "Filter\n  Fetch\n    IndexEqualSeek(City == ?, idx=City)"
    assert path([city, both], Query(eq, (Sort("Age", True),), take=5)) == "Limit(skip=0, take=5)\n  Fetch\n    IndexPrefixSeek(City == ?, idx=CityAge, backward)"
    assert path([city, both], Query(eq, (Sort("City"),))) == "Sort\n  Fetch\n    IndexEqualSeek(City == ?, idx=City)"
    assert path([both], Query(None, (Sort("City"), Sort("Age")), 2, 3)) == "Limit(skip=2, take=3)\n  Fetch\n    IndexOrderedScan(idx=CityAge)"
    assert path([both], Query(None, (Sort("City"), Sort("Age", True)), 2, 3)) == "Sort (Top-5)\n  TableScan"
    assert path([both], Query(Not(eq), (Sort("City"), Sort("Age")))) == "Filter\n  Fetch\n    IndexOrderedScan(idx=CityAge)"
    assert path([], Query(None, (Sort(None, True),), take=4)) == "Limit(skip=0, take=4)\n  TableScan (backward)"
    assert path([], Query(eq, (Sort(None, True),))) == "Sort\n  Filter\n    TableScan"
    assert path([], Query(key_from=1, has_from=True)) == "Filter\n  KeyRangeScan"
    assert path([city], Query(And(()))) == "TableScan" and path([city], Query(Or((And(()), eq)))) == "Filter\n  TableScan"


def test_indexes(spark, people):
    t = Table(people.df, "id")
    t.create_index("ca", "City", "Age")
    t.create_index("ca", "City", "Age")
    with pytest.raises(ValueError):
        t.create_index("ca", "Age")
    with pytest.raises(UniqueViolation):
        t.create_index("u", "City", unique=True)
    assert sorted(ids(t.find_by_index("ca", "nyc", 2))) == want(lambda r: r[1] == "nyc" and r[2] == 2)
    assert t.count_by_index("ca", "nyc", 2) == len(want(lambda r: r[1] == "nyc" and r[2] == 2)) and not t.exists_in_index("ca", "nyc", 3)
    got = [(r["Age"], r["id"]) for r in t.find_by_index_prefix("ca", "nyc", backward=True).collect()]
    assert got == sorted(((r[2], r[0]) for r in ROWS if r[1] == "nyc"), reverse=True)
    with pytest.raises(ValueError):
        t.find_by_index_prefix("ca", "nyc", 2)
    assert t.index_projection("ca").columns == ["City", "Age", "id"]
    assert t.drop_index("ca") and not t.drop_index("ca")


def test_text_queries_agree(people):
    schema, keys = people.df.schema, people.keys
    q = textual.from_query_string("City=nyc&Age=gte:3&or=(Name:eq:n1,Age:lt:9)&order=Age:desc,-City,$key&limit=7&offset=2&count=true", schema, keys)
    j = textual.from_json({"filter": {"and": [{"field": "City", "value": "nyc"}, {"field": "Age", "op": "GTE", "value": 3}, {"or": [{"field": "Name", "value": "n1"}, {"field": "Age", "op": "<", "value": 9}]}]}, "order": [{"field": "Age", "desc": True}, "-City", {}], "limit": 7, "offset": 2, "take": 1, "count": True}, schema, keys)
    assert q == j and q.extra == j.extra
    s = textual.from_query_string
    assert s("Name=John:Doe", schema, keys).filter == Predicate("Name", "eq", "John:Doe")
    assert s("order=-Age:asc", schema, keys).sorts == (Sort("Age", False),)
    assert s("direction=backward", schema, keys).sorts == (Sort(None, True),)
    assert s("direction=backward&order=Age", schema, keys).sorts == (Sort("Age"),)
    assert s("LIMIT=x&Order=Age", schema, keys) == Query(sorts=(Sort("Age"),))
    k = s("fromKey=3&toKey=9&toExclusive=1", schema, keys)
    assert (k.key_from, k.key_from_incl, k.key_to, k.key_to_incl) == (3, True, 9, False)
    for bad in ("Age=between:1", "or=(Age)", "or=(Age:like:1)", "Age=gt:x", "Nope=1", "order=Nope"):
        with pytest.raises(ValueError):
            s(bad, schema, keys)
    assert textual.from_json({"filter": {"field": "Name", "value": None}}, schema, keys).filter.value == "null"
    assert textual.from_json({"filter": {"field": "Name"}}, schema, keys).filter.value is None
    assert textual.page(None, -3) == (50, 0) and textual.page(5000, 2) == (1000, 2) and textual.page(0, 0) == (1, 0)


def test_key_scans(spark):
    t = Table(spark.createDataFrame([(i, str(i)) for i in range(1, 11)], "key int, value string"), "key")
    keys = lambda df: [r["key"] for r in df.collect()]
    assert keys(t.scan(KeyQuery.between(3, 6, False, True))) == [4, 5, 6]
    assert keys(t.scan_backward(KeyQuery.at_most(3))) == [3, 2, 1]
    assert keys(t.scan_take(KeyQuery.greater_than(4), 2)) == [5, 6] and keys(t.scan_take(KeyQuery.all(), 0)) == []
    assert keys(t.page_after(KeyQuery.at_most(7), 3, 5)) == [6, 7] and keys(t.page(KeyQuery.all(), 8, 5)) == [9, 10]
    assert t.count(KeyQuery.between(6, 3)) == 0 and t.count(KeyQuery.between(3, 3, True, False)) == 0 and t.count() == 10
    assert keys(t.scan(KeyQuery.all().with_filter(lambda k: k % 4 == 0))) == [4, 8]
    with pytest.raises(ValueError):
        t.forward(6, 3)
    with pytest.raises(ValueError):
        t.page(KeyQuery.all(), -1, 3)
    s = Table(spark.createDataFrame([(w, w.upper()) for w in ("apple", "apricot", "avocado", "banana")], "key string, value string"), "key")
    assert keys(s.scan(KeyQuery.starts_with("ap"))) == ["apple", "apricot"] and s.count(KeyQuery.starts_with("")) == 4
    seen, cursor = [], None
    while page := keys(t.page_after(KeyQuery.all(), 3, cursor)):
        seen, cursor = seen + page, page[-1]
    assert seen == list(range(1, 11))


def test_points_and_neighbours(spark):
    t = Table(spark.createDataFrame([(k, f"v{k}") for k in (30, 10, 50, 40, 20)], "key int, value string"), "key")
    at = lambda r: r and r["key"]
    assert [at(t.find_next(25)), at(t.find_next(30)), at(t.find_next(51))] == [30, 30, None]
    assert [at(t.find_after(30)), at(t.find_after(50))] == [40, None]
    assert [at(t.find_prev(25)), at(t.find_prev(30)), at(t.find_prev(5))] == [20, 30, None]
    assert [at(t.find_before(30)), at(t.find_before(10))] == [20, None]
    assert (at(t.first_row()), at(t.last_row()), t[10]["value"], t.exists(11), t.get_or_default(11, "d"), t.try_get(20)[0]) == (10, 50, "v10", False, "d", True)
    with pytest.raises(KeyError):
        t[11]
    empty = t.with_df(t.df.limit(0))
    assert empty.first_row() is None and empty.find_next(1) is None
    t.validate_keys()
    with pytest.raises(ValueError):
        t.with_df(t.df.union(t.df)).validate_keys()


def test_composite_keys(spark):
    rows = [(a, b, i) for i, (a, b) in enumerate(itertools.product(range(5), "xyz"))]
    t = Table(spark.createDataFrame(rows, "a int, b string, n int"), ["a", "b"])
    got = [(r["a"], r["b"]) for r in t.scan(KeyQuery.between((1, "y"), (3, "x"), False, True)).collect()]
    assert got == [(a, b) for a, b, _ in rows if (1, "y") < (a, b) <= (3, "x")]
    assert t[(2, "z")]["n"] == 8 and t.find_before((2, "x"))["n"] == 5
    with pytest.raises(ValueError):
        t.scan(KeyQuery.at_least(3))


def test_unknown_types_are_refused():
    schema = T.StructType([T.StructField("a", T.ArrayType(T.IntegerType()))])
    with pytest.raises(ValueError):
        L.field_type(schema, "a")
