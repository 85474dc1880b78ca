"""Keyed mutations as one relational query over a log.

The log has seq (unique, ascending), op, the key columns, the far end of range deletes, and the record. Per key the last
delete that reaches it (its own, a range's or a clear) resets it; what remains is the last replace, or the row of the
base if no delete reached it, or the first insert-or-ignore. That equals applying the log in order.

Range deletes are a tree over the places of their ends: a range covers a few nodes a level, every place between ends has
one ancestor a level, so the last range over a place is an equality join and a maximum. Keys find their place among the
ends as floor keys do. Nothing of it is gathered, whatever the number of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.navigation import find_prev, positions
from keyloom.operators.table import Table, UniqueViolation, unique_violations

REPLACE, INSERT_OR_IGNORE, DELETE, DELETE_RANGE, CLEAR = "REPLACE", "INSERT_OR_IGNORE", "DELETE", "DELETE_RANGE", "CLEAR"
#: Levels of the tree with fewer nodes than two to this power are broadcast: all places meet in few of them.
TOP_LEVELS = 13


def _key(keys: list[str], suffix: str = "") -> Column:
    """The key as one value: compared column by column."""
    return F.col(f"`{keys[0]}{suffix}`") if len(keys) == 1 else F.struct(*[F.col(f"`{k}{suffix}`").alias(k) for k in keys])


def _far_end(ops: DataFrame, keys: list[str]) -> Column:
    """The column key_to (of a single key, or a struct), or columns named as the key's with _to."""
    if "key_to" in ops.columns:
        return F.col("key_to") if len(keys) == 1 else F.struct(*[F.col("key_to").getField(k).alias(k) for k in keys])
    return _key(keys, "_to")


def _shifted(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def _range_resets(every: DataFrame, keys: list[str], ops: DataFrame) -> DataFrame | None:
    """The key columns, _range: the last range delete that covers each key; None if there is none at all. Ranges with a
    null in an end, or whose ends are the wrong way round, cover nothing."""
    ranges = ops.where(F.col("op") == DELETE_RANGE)
    if "key_to" not in ops.columns and not all(f"{k}_to" in ops.columns for k in keys):
        if not ranges.isEmpty():
            raise ValueError("range deletes need their far end: key_to, or the key columns with _to")
        return None
    ranges = ranges.select(_key(keys).alias("lo"), _far_end(ops, keys).alias("hi"), "seq")
    parts = [F.col(f"{end}.`{k}`") if len(keys) > 1 else F.col(end) for end in ("lo", "hi") for k in keys]
    for part in parts:
        ranges = ranges.where(part.isNotNull())
    ranges = ranges.where("lo <= hi")
    ends = positions(ranges.select(F.explode(F.array("lo", "hi")).alias("e")).distinct(), F.col("e"), "at")
    count = ends.count()
    if not count:
        return None

    # Place 2 i is the end numbered i, place 2 i + 1 what lies behind it.
    levels = (2 * count - 1).bit_length()
    low, high = (ends.select(F.col("e").alias(f"e_{x}"), F.col("at").alias(x)) for x in ("a", "b"))
    spans = ranges.join(low, F.col("lo") == F.col("e_a")).join(high, F.col("hi") == F.col("e_b"))
    spans = spans.select((F.col("a") * 2).alias("a"), (F.col("b") * 2 + 1).alias("b"), "seq", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))
    spans = spans.select("k", "seq", _shifted(F.col("a") + width - 1, F.col("k")).alias("a"), _shifted(F.col("b"), F.col("k")).alias("b")).where("a < b")
    nodes = spans.select("k", "seq", F.explode(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1))).alias("node"))
    nodes = nodes.where("node is not null").groupBy("k", "node").agg(F.max("seq").alias("seq"))
    top = max(0, levels - TOP_LEVELS)
    places = every.sparkSession.range(2 * count).select(F.col("id").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k"))
    places = places.withColumn("node", _shifted(F.col("place"), F.col("k")))
    over = places.where(F.col("k") >= top).join(F.broadcast(nodes.where(F.col("k") >= top)), ["k", "node"])
    if top:
        over = over.unionByName(places.where(F.col("k") < top).join(nodes.where(F.col("k") < top), ["k", "node"]))
    last = over.groupBy("place").agg(F.max("seq").alias("_range"))

    found = find_prev(every.select(*keys, _key(keys).alias("_key")), "_key", ends, "e", "_floor")
    found = found.join(ends, F.col("_floor") == F.col("e")).withColumn("place", F.col("at") * 2 + F.when(F.col("_key") == F.col("e"), 0).otherwise(1))
    return found.join(last, "place").select(*keys, "_range")


def resolve(base: DataFrame, ops: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The table after a log: the columns of base. ops has seq, op, the columns of base and, if it deletes ranges, their
    far ends: key_to (a struct for composite keys), or the key columns with _to. Both ends are included. An unknown op is
    an error at run time, a log that deletes ranges without far ends one at once; null keys take no part."""
    record = [c for c in base.columns if c not in keys]
    ops = ops.withColumnRenamed(seq, "seq")
    known = F.col("op").isin(REPLACE, INSERT_OR_IGNORE, DELETE, DELETE_RANGE, CLEAR)
    ops = ops.withColumn("op", F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null"))))))
    cleared = ops.where(F.col("op") == CLEAR).agg(F.max("seq")).first()[0]
    points = ops.where(F.col("op").isin(REPLACE, INSERT_OR_IGNORE, DELETE)).dropna(subset=keys)

    def of(op):
        return F.col("op") == op

    row = F.struct(*[f"`{c}`" for c in record]) if record else F.struct(F.lit(1).alias("one"))
    per_key = points.groupBy(*keys).agg(
        F.max(F.when(of(DELETE), F.col("seq"))).alias("_delete"),
        F.max(F.when(of(REPLACE), F.col("seq"))).alias("_replace"),
        F.max_by(row, F.when(of(REPLACE), F.col("seq"))).alias("_replaced"),
    )
    every = base.select(*keys, row.alias("_base")).join(per_key, keys, "full_outer")
    resets = [F.col("_delete"), F.lit(cleared).cast("long")]
    ranges = _range_resets(every.select(*keys).dropna(), keys, ops)
    if ranges is not None:
        every = every.join(ranges, keys, "left")
        resets.append(F.col("_range"))
    every = every.withColumn("_reset", F.greatest(*resets))  # greatest() passes over nulls
    inserts = points.where(of(INSERT_OR_IGNORE)).join(every.select(*keys, "_reset"), keys).where("_reset is null or seq > _reset")
    first = inserts.groupBy(*keys).agg(F.min_by(row, "seq").alias("_inserted"))
    every = every.join(first, keys, "left")
    replaced = F.col("_replace").isNotNull() & (F.col("_reset").isNull() | (F.col("_replace") > F.col("_reset")))
    based = F.col("_reset").isNull() & F.col("_base").isNotNull()
    final = F.when(replaced, F.col("_replaced")).when(based, F.col("_base")).otherwise(F.col("_inserted"))
    out = every.select(*keys, final.alias("_row")).where("_row is not null")
    return out.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`") for c in base.columns])


def apply(table: Table, ops: DataFrame) -> Table:
    """The table after a log; unique indexes are checked on the result, so that a log that breaks one changes nothing."""
    after = resolve(table.df, ops, table.keys)
    check_unique(table, after)
    return table.with_df(after)


def check_unique(table: Table, df: DataFrame) -> None:
    for index in table.indexes.values():
        if index.unique and (bad := unique_violations(df, list(index.members)).head(1)):
            raise UniqueViolation(index.name, [bad[0][m] for m in index.members])


def _one_a_key(table: Table, rows: DataFrame, seq: str | None, last: bool) -> DataFrame:
    """Of rows with one key the last or the first by seq; without seq a repeated key is an error."""
    record = F.struct(*[f"`{c}`" for c in table.df.columns])
    if seq is None:
        if twice := rows.groupBy(*table.keys).count().where("count > 1").head(1):
            raise ValueError(f"key {[twice[0][k] for k in table.keys]!r} comes twice: say in which order with seq")
        return rows.select(*table.df.columns)
    return rows.groupBy(*table.keys).agg((F.max_by if last else F.min_by)(record, F.col(f"`{seq}`")).alias("_row")).select("_row.*")


def upsert(table: Table, rows: DataFrame, seq: str | None = None) -> Table:
    """Rows replace those of the same key; of rows with one key the last by seq."""
    after = table.df.join(rows.select(*table.keys), table.keys, "left_anti").unionByName(_one_a_key(table, rows, seq, last=True))
    check_unique(table, after)
    return table.with_df(after)


def insert_or_ignore(table: Table, rows: DataFrame, seq: str | None = None) -> Table:
    """Rows whose key is not there yet; of rows with one key the first by seq."""
    after = table.df.unionByName(_one_a_key(table, rows, seq, last=False).join(table.df.select(*table.keys), table.keys, "left_anti"))
    check_unique(table, after)
    return table.with_df(after)


def delete(table: Table, pks: DataFrame) -> Table:
    """Without the rows of a set of keys; absent ones are no error."""
    return table.with_df(table.df.join(pks.select(*table.keys), table.keys, "left_anti"))


def delete_range(table: Table, low, high) -> Table:
    from keyloom.operators.keyquery import KeyQuery

    if low > high:
        raise ValueError("low > high")
    return table.with_df(table.df.filter(~KeyQuery.between(low, high).condition(table.keys, table.df.schema)))


def clear(table: Table) -> Table:
    return table.with_df(table.df.limit(0))
