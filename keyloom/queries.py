"""The engine's query catalogue: each query as the library runs it, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators import migration, mutations, navigation
from keyloom.operators.keyquery import KeyQuery
from keyloom.operators.table import Table, unique_violations
from keyloom.plans import textual
from keyloom.plans.planner import Index

Query = Callable[[SparkSession, str], DataFrame]

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id", "conversations": ["conv_id", "turn"], "documents": "doc_id", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}
ORDER_INDEXES = (
    Index("by_status", ("o_orderstatus",)),
    Index("by_priority", ("o_orderpriority",)),
    Index("by_status_price", ("o_orderstatus", "o_totalprice")),
)

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, keys=None) -> Table:
    return Table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), keys or KEYS[name], ORDER_INDEXES if name == "orders" else (), name)


def _add(name: str, source: str, run: Callable[[Table], DataFrame], sql: str, keys=None) -> None:
    _queries[name] = lambda spark, sf_dir: run(table(spark, sf_dir, source, keys))
    _sql[name] = sql


def _positions(df: DataFrame, order: list) -> DataFrame:
    """Rows of a top-k with their places, so that a comparison that ignores order still sees it."""
    return df.withColumn("pos", F.row_number().over(W.orderBy(*order)).cast("long"))


# Key ranges and scans

_add("key_range_scan", "orders", lambda t: t.scan(KeyQuery.between(100, 5000)), "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
_add("key_forward", "orders", lambda t: t.forward(100, 900), "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 900")
_add("key_backward", "orders", lambda t: t.backward(900, 100), "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 900")
_add("key_greater_than", "orders", lambda t: t.scan(KeyQuery.greater_than(9000)), "SELECT * FROM orders WHERE o_orderkey > 9000")
_add("key_at_most", "orders", lambda t: t.scan(KeyQuery.at_most(700)), "SELECT * FROM orders WHERE o_orderkey <= 700")
_add("key_between_exclusive", "orders", lambda t: t.scan(KeyQuery.between(100, 5000, False, False)), "SELECT * FROM orders WHERE o_orderkey > 100 AND o_orderkey < 5000")
_add("key_prefix_scan", "customer", lambda t: t.scan(KeyQuery.starts_with("Customer#00000001")), "SELECT * FROM customer WHERE starts_with(c_name, 'Customer#00000001')", "c_name")
_add("key_filter_even", "orders", lambda t: t.scan(KeyQuery.between(1, 4000).with_filter(F.col("o_orderkey") % 2 == 0)), "SELECT * FROM orders WHERE o_orderkey BETWEEN 1 AND 4000 AND o_orderkey % 2 = 0")
_add("scan_take", "events", lambda t: t.scan_take(KeyQuery.at_least(500), 25), "SELECT * FROM events WHERE event_id >= 500 ORDER BY event_id LIMIT 25")
_add("scan_backward_take", "events", lambda t: t.scan_backward_take(KeyQuery.less_than(5000), 25), "SELECT * FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 25")
_add("cursor_page", "events", lambda t: t.page_after(KeyQuery.at_most(9000), 20, 4321), "SELECT * FROM events WHERE event_id > 4321 AND event_id <= 9000 ORDER BY event_id LIMIT 20")
_add("offset_page", "events", lambda t: t.page(KeyQuery.all(), 100, 20), "SELECT * FROM events ORDER BY event_id LIMIT 20 OFFSET 100")
_add("composite_key_range", "conversations", lambda t: t.scan(KeyQuery.between((3, 1), (7, 2))), "SELECT * FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn >= 1)) AND (conv_id < 7 OR (conv_id = 7 AND turn <= 2))")

_add("scan_all", "region", lambda t: t.scan(), "SELECT * FROM region")
_add("scan_query_spelling", "events", lambda t: t.query_backward_take(KeyQuery.at_most(700), 12), "SELECT * FROM events WHERE event_id <= 700 ORDER BY event_id DESC LIMIT 12")

# Points and neighbours

_add("find_missing", "customer", lambda t: t._at(-1), "SELECT * FROM customer WHERE c_custkey = -1")
_add("find_composite", "conversations", lambda t: t._at((5, 1)), "SELECT * FROM conversations WHERE conv_id = 5 AND turn = 1")
_add("exists_key", "customer", lambda t: t._at(42).agg((F.count(F.lit(1)) > 0).alias("exists")), "SELECT count(*) > 0 AS exists FROM customer WHERE c_custkey = 42")
_add("point_get", "customer", lambda t: t._at(42), "SELECT * FROM customer WHERE c_custkey = 42")
_add("first_row", "events", lambda t: t.first_row_df(), "SELECT * FROM events ORDER BY event_id LIMIT 1")
_add("last_row", "events", lambda t: t.last_row_df(), "SELECT * FROM events ORDER BY event_id DESC LIMIT 1")
_add("last_rows_backward", "events", lambda t: t.scan_backward_take(KeyQuery.all(), 500), "SELECT * FROM events ORDER BY event_id DESC LIMIT 500")


def _bulk(find) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sparse = table(spark, sf_dir, "orders").query("o_orderstatus").equal("F").df()
        return find(table(spark, sf_dir, "events").df.select("event_id"), "event_id", sparse, "o_orderkey")

    return run


for _name, _find, _op in (("find_prev", navigation.find_prev, ">="), ("find_before", navigation.find_before, ">"), ("find_next", navigation.find_next, "<="), ("find_after", navigation.find_after, "<")):
    _queries[f"{_name}_bulk"] = _bulk(_find)
    _sql[f"{_name}_bulk"] = f"SELECT e.event_id, f.o_orderkey AS found_key FROM events e ASOF LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') f ON e.event_id {_op} f.o_orderkey"


def _fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pks = table(spark, sf_dir, "events").df.select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").fetch(pks)


_queries["fetch_by_keys"] = _fetch
_sql["fetch_by_keys"] = "SELECT * FROM customer WHERE c_custkey IN (SELECT user_id FROM events)"

# Filters

_add("filter_eq", "customer", lambda t: t.query("c_mktsegment").equal("BUILDING").df(), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("filter_gte", "customer", lambda t: t.query("c_acctbal").at_least(5000).df(), "SELECT * FROM customer WHERE c_acctbal >= 5000")
_add("filter_gt", "customer", lambda t: t.query("c_nationkey").greater_than(20).df(), "SELECT * FROM customer WHERE c_nationkey > 20")
_add("filter_lte", "customer", lambda t: t.query("c_nationkey").at_most(3).df(), "SELECT * FROM customer WHERE c_nationkey <= 3")
_add("filter_lt", "customer", lambda t: t.query("c_acctbal").less_than(0).df(), "SELECT * FROM customer WHERE c_acctbal < 0")
_add("filter_between", "part", lambda t: t.query("p_size").between(10, 20).df(), "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20")
_add("filter_between_exclusive", "part", lambda t: t.query("p_size").between(10, 20, False, False).df(), "SELECT * FROM part WHERE p_size > 10 AND p_size < 20")
_add("filter_prefix", "part", lambda t: t.query("p_brand").starts_with("Brand#1").df(), "SELECT * FROM part WHERE starts_with(p_brand, 'Brand#1')")
_add("filter_and", "customer", lambda t: t.query("c_mktsegment").equal("BUILDING").and_("c_acctbal").at_least(1000).df(), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000")
_add("filter_or", "customer", lambda t: t.query("c_mktsegment").equal("BUILDING").or_("c_nationkey").less_than(3).df(), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey < 3")
_add("filter_not", "customer", lambda t: t.query("c_mktsegment").not_equal("BUILDING").and_("c_nationkey").not_at_least(10).df(), "SELECT * FROM customer WHERE NOT c_mktsegment = 'BUILDING' AND NOT c_nationkey >= 10")
_add("filter_not_between", "customer", lambda t: t.query("c_nationkey").not_between(5, 20, True, False).df(), "SELECT * FROM customer WHERE NOT (c_nationkey >= 5 AND c_nationkey < 20)")
_add("filter_grouped_or_and", "customer", lambda t: t.query("c_acctbal").at_least(0).group(lambda g: g.query("c_mktsegment").equal("MACHINERY").or_("c_nationkey").equal(7)).df(), "SELECT * FROM customer WHERE c_acctbal >= 0 AND (c_mktsegment = 'MACHINERY' OR c_nationkey = 7)")
_add("filter_left_fold", "customer", lambda t: t.query("c_nationkey").equal(1).or_("c_nationkey").equal(2).and_("c_acctbal").at_least(3000).df(), "SELECT * FROM customer WHERE (c_nationkey = 1 OR c_nationkey = 2) AND c_acctbal >= 3000")
_add("filter_same_field_range", "customer", lambda t: t.query("c_acctbal").at_least(100).at_most(900).df(), "SELECT * FROM customer WHERE c_acctbal >= 100 AND c_acctbal <= 900")
_add("key_range_plus_filter", "orders", lambda t: t.query("o_orderstatus").equal("O").key_between(1000, 9000, True, False).df(), "SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderkey >= 1000 AND o_orderkey < 9000")

# Indexes

_add("index_eq", "orders", lambda t: t.find_by_index("by_status", "F"), "SELECT * FROM orders WHERE o_orderstatus = 'F'")
_add("index_range", "orders", lambda t: t.find_by_index_range("by_priority", "2", "4", True, False), "SELECT * FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'")
_add("index_prefix_ordered", "orders", lambda t: _positions(t.find_by_index_prefix("by_status_price", "P").limit(50), ["o_totalprice", "o_orderkey"]), "SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 50)")
_add("index_ordered_scan", "orders", lambda t: _positions(t.query().order_by("o_orderstatus").then_by("o_totalprice").take(40).df(), ["o_orderstatus", "o_totalprice", "o_orderkey"]), "SELECT *, row_number() OVER (ORDER BY o_orderstatus, o_totalprice, o_orderkey) AS pos FROM (SELECT * FROM orders ORDER BY o_orderstatus, o_totalprice, o_orderkey LIMIT 40)")
_add("index_intersect", "orders", lambda t: t.find_by_all(("by_status", "F"), ("by_priority", "1-URGENT")), "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_add("index_union", "orders", lambda t: t.find_by_any(("by_status", "P"), ("by_priority", "1-URGENT")), "SELECT * FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'")
_add("index_keys_only", "orders", lambda t: t.find_keys_by_index("by_status", "P"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
_add("index_count", "orders", lambda t: t.find_keys_by_index("by_priority", "5-LOW").agg(F.count(F.lit(1)).alias("count")), "SELECT count(*) AS count FROM orders WHERE o_orderpriority = '5-LOW'")
_add("index_exists", "orders", lambda t: t.query("o_orderstatus").equal("no such").exists_df(), "SELECT count(*) > 0 AS exists FROM orders WHERE o_orderstatus = 'no such'")

# Order

_add("order_by_field", "customer", lambda t: navigation.positions(t.df, F.struct("c_mktsegment", "c_custkey")).withColumn("pos", F.col("pos") + 1), "SELECT *, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS pos FROM customer")
_add("order_by_desc_tiebreak", "customer", lambda t: _positions(t.query().order_by_descending("c_nationkey").take(60).df(), [F.desc("c_nationkey"), F.desc("c_custkey")]), "SELECT *, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey DESC) AS pos FROM (SELECT * FROM customer ORDER BY c_nationkey DESC, c_custkey DESC LIMIT 60)")
_add("order_by_mixed", "customer", lambda t: _positions(t.query().order_by("c_nationkey").then_by_descending("c_mktsegment").take(80).df(), [F.asc("c_nationkey"), F.desc("c_mktsegment"), F.asc("c_custkey")]), "SELECT *, row_number() OVER (ORDER BY c_nationkey, c_mktsegment DESC, c_custkey) AS pos FROM (SELECT * FROM customer ORDER BY c_nationkey, c_mktsegment DESC, c_custkey LIMIT 80)")
_add("order_by_key_desc", "customer", lambda t: _positions(t.query("c_acctbal").greater_than(0).order_by_key_descending().take(30).df(), [F.desc("c_custkey")]), "SELECT *, row_number() OVER (ORDER BY c_custkey DESC) AS pos FROM (SELECT * FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey DESC LIMIT 30)")
_add("top_k", "customer", lambda t: t.query("c_mktsegment").equal("BUILDING").and_("c_acctbal").at_least(5000).order_by_descending("c_acctbal").take(20).df(), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 5000 ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20")
_add("top_k_skip", "customer", lambda t: t.query().order_by("c_acctbal").skip(15).take(10).df(), "SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 15")
_add("skip_only", "nation", lambda t: t.query().skip(20).df(), "SELECT * FROM nation ORDER BY n_nationkey OFFSET 20")
_add("range_ordered_same_field", "orders", lambda t: t.query("o_totalprice").between(1000, 2000).order_by_descending("o_totalprice").take(256).df(), "SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 2000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 256")

# Counts

_add("count_all", "orders", lambda t: t.count_df(), "SELECT count(*) AS count FROM orders")
_add("count_range", "orders", lambda t: t.count_df(KeyQuery.between(100, 5000)), "SELECT count(*) AS count FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
_add("count_range_reversed", "orders", lambda t: t.count_df(KeyQuery.between(5000, 100)), "SELECT count(*) AS count FROM orders WHERE o_orderkey BETWEEN 5000 AND 100")
_add("count_filter_skip_take", "customer", lambda t: t.query("c_nationkey").at_most(10).skip(5).take(100).count_df(), "SELECT least(greatest(count(*) - 5, 0), 100) AS count FROM customer WHERE c_nationkey <= 10")
_add("exists_flag", "customer", lambda t: t.query("c_acctbal").greater_than(9000).exists_df(), "SELECT count(*) > 0 AS exists FROM customer WHERE c_acctbal > 9000")
_add("count_per_priority", "orders", lambda t: t.df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("count")), "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority")

# Query strings and JSON


def _string(text: str) -> Callable[[Table], DataFrame]:
    return lambda t: t.run(textual.from_query_string(text, t.df.schema, t.keys))


def _json(body: dict) -> Callable[[Table], DataFrame]:
    return lambda t: t.run(textual.from_json(body, t.df.schema, t.keys))


_add("qs_bare_eq", "customer", _string("c_mktsegment=BUILDING"), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("qs_and_or_order", "customer", _string("c_acctbal=gte:100&or=(c_mktsegment:eq:BUILDING,c_nationkey:lt:3)&order=c_nationkey:desc,-c_acctbal&limit=40&offset=5"), "SELECT * FROM customer WHERE c_acctbal >= 100 AND (c_mktsegment = 'BUILDING' OR c_nationkey < 3) ORDER BY c_nationkey DESC, c_acctbal DESC, c_custkey DESC LIMIT 40 OFFSET 5")
_add("qs_key_range", "orders", _string("fromKey=100&toKey=900&toExclusive=true&direction=backward&limit=30"), "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 ORDER BY o_orderkey DESC LIMIT 30")
_add("qs_between_prefix", "part", _string("p_size=between:5:15&p_brand=prefix:Brand%232"), "SELECT * FROM part WHERE p_size BETWEEN 5 AND 15 AND starts_with(p_brand, 'Brand#2')")
_add("json_not", "customer", _json({"filter": {"not": {"field": "c_mktsegment", "op": "eq", "value": "BUILDING"}}}), "SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'")
_add("json_nested", "customer", _json({"filter": {"or": [{"and": [{"field": "c_nationkey", "op": ">=", "value": 5}, {"field": "c_nationkey", "op": "<", "value": 8}]}, {"not": {"field": "c_acctbal", "op": "between", "value": -500, "value2": 9000, "toInclusive": False}}]}, "order": [{"field": "c_acctbal", "desc": True}], "take": 70}), "SELECT * FROM customer WHERE (c_nationkey >= 5 AND c_nationkey < 8) OR NOT (c_acctbal >= -500 AND c_acctbal < 9000) ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 70")
_add("json_key_range", "orders", _json({"keyFrom": 50, "keyTo": 400, "keyFromInclusive": False, "order": "-$key", "limit": 25}), "SELECT * FROM orders WHERE o_orderkey > 50 AND o_orderkey <= 400 ORDER BY o_orderkey DESC LIMIT 25")

_add("qs_page_clamp", "events", lambda t: t.run(textual.browse("limit=100000&offset=-5", t.df.schema, t.keys)), f"SELECT * FROM events ORDER BY event_id LIMIT {textual.MAX_PAGE}")
_add("qs_browse_bad_bound", "orders", lambda t: t.run(textual.browse("fromKey=abc&toKey=90&limit=20", t.df.schema, t.keys)), "SELECT * FROM orders WHERE o_orderkey <= 90 ORDER BY o_orderkey LIMIT 20")
_add("qs_literals", "orders", _string("o_orderdate=gte:1996-01-01&o_totalprice=lt:1e5&o_custkey=lte:500"), "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice < 1e5 AND o_custkey <= 500")

# Mutations: logs made from events, key user_id, against customers

_ROWS = "SELECT c_custkey AS k, c_acctbal AS v FROM customer"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").df.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


def _log(spark: SparkSession, sf_dir: str, ops: dict[str, str]) -> DataFrame:
    e = table(spark, sf_dir, "events").df.where(F.col("event_type").isin(list(ops)))
    op = F.element_at(F.create_map(*[F.lit(x) for pair in ops.items() for x in pair]), F.col("event_type"))
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("k"), F.col("value").alias("v"), (F.col("user_id") + 3).alias("key_to"))


def _resolved(ops: dict[str, str], clear_at: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = _log(spark, sf_dir, ops)
        if clear_at is not None:
            log = log.withColumn("op", F.when(F.col("seq") == clear_at, mutations.CLEAR).otherwise(F.col("op")))
        return mutations.resolve(_base(spark, sf_dir), log, ["k"])

    return run


def _resolved_sql(ops: dict[str, str], clear_at: int | None = None) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{op}'" for e, op in ops.items())
    op = f"CASE event_type {cases} END"
    if clear_at is not None:
        op = f"CASE WHEN event_id = {clear_at} THEN 'CLEAR' ELSE {op} END"
    kinds = ", ".join(f"'{e}'" for e in ops)
    return f"""
    WITH base AS ({_ROWS}),
    log AS (SELECT event_id AS seq, {op} AS op, user_id AS k, value AS v, user_id + 3 AS key_to FROM events WHERE event_type IN ({kinds})),
    every AS (SELECT k FROM base UNION SELECT k FROM log WHERE op IN ('REPLACE', 'INSERT_OR_IGNORE', 'DELETE')),
    resets AS (
      SELECT every.k, max(seq) AS reset FROM every LEFT JOIN log
        ON (log.op = 'DELETE' AND log.k = every.k) OR (log.op = 'DELETE_RANGE' AND every.k BETWEEN log.k AND log.key_to) OR log.op = 'CLEAR' GROUP BY every.k),
    live AS (SELECT log.*, reset FROM log JOIN resets USING (k) WHERE reset IS NULL OR seq > reset),
    last AS (SELECT k, arg_max(v, seq) AS v FROM live WHERE op = 'REPLACE' GROUP BY k),
    firsts AS (SELECT k, arg_min(v, seq) AS v FROM live WHERE op = 'INSERT_OR_IGNORE' GROUP BY k)
    SELECT resets.k, CASE WHEN last.k IS NOT NULL THEN last.v WHEN base.k IS NOT NULL AND reset IS NULL THEN base.v ELSE firsts.v END AS v
    FROM resets LEFT JOIN last USING (k) LEFT JOIN base ON base.k = resets.k LEFT JOIN firsts ON firsts.k = resets.k
    WHERE last.k IS NOT NULL OR (base.k IS NOT NULL AND reset IS NULL) OR firsts.k IS NOT NULL"""


for _name, _ops, _clear in (
    ("upsert_resolution", {"view": "REPLACE"}, None),
    ("insert_or_ignore", {"click": "INSERT_OR_IGNORE"}, None),
    ("delete_points", {"error": "DELETE"}, None),
    ("delete_range", {"error": "DELETE_RANGE"}, None),
    ("clear_then_insert", {"view": "REPLACE", "click": "INSERT_OR_IGNORE"}, 600),
    ("mixed_log", {"view": "REPLACE", "click": "INSERT_OR_IGNORE", "error": "DELETE", "signup": "DELETE_RANGE"}, None),
):
    _queries[_name] = _resolved(_ops, _clear)
    _sql[_name] = _resolved_sql(_ops, _clear)



def _range_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys: every tenth conversation from its turn 1 to turn 0 of the next but one."""
    t = table(spark, sf_dir, "conversations").df
    first = t.where("turn = 1 and conv_id % 10 = 0")
    log = first.select(F.col("conv_id").alias("seq"), F.lit(mutations.DELETE_RANGE).alias("op"), "conv_id", "turn", "role", "text", (F.col("conv_id") + 2).alias("conv_id_to"), F.lit(0).cast("long").alias("turn_to"))
    return mutations.resolve(t, log, ["conv_id", "turn"])


_queries["delete_range_composite"] = _range_deleted
_sql["delete_range_composite"] = """
    SELECT * FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations f WHERE f.turn = 1 AND f.conv_id % 10 = 0
      AND (c.conv_id > f.conv_id OR (c.conv_id = f.conv_id AND c.turn >= 1)) AND (c.conv_id < f.conv_id + 2 OR (c.conv_id = f.conv_id + 2 AND c.turn <= 0)))"""

_add("unique_violations", "customer", lambda t: unique_violations(t.df, ["c_nationkey"]), "SELECT c_nationkey, count(*) AS count FROM customer GROUP BY c_nationkey HAVING count(*) > 1")


def _migrated(t: Table) -> DataFrame:
    target = T.StructType([f for f in t.df.schema.fields if f.name != "p_type"]).add("active", T.BooleanType())
    return migration.migrate(t.df, target, t.keys)


_add("migrate_add_drop", "part", _migrated, "SELECT * EXCLUDE (p_type), false AS active FROM part")


def _snapshot(t: Table) -> DataFrame:
    """The last 2,000 rows of a stream summed up: an application of a backward scan, not an operator of its own."""
    recent = t.scan_backward_take(KeyQuery.all(), 2000)
    return recent.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("value", "event_id").alias("last"), F.count(F.lit(1)).alias("count"))


_add("tick_snapshot", "events", _snapshot, "SELECT min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, arg_max(value, event_id) AS last, count(*) AS count FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 2000)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["top_k"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


