"""Floor, ceiling, lower and higher for many probes at once: as-of joins without a single ordered partition.

Both sides are dealt into key ranges, as many as their rows need, placed by a sample of both. Within a range a window
carries the last key of the table along; what precedes a range is one row a range. So no task sees more than a range, and
the only global order is over the ranges' ends. Probes with one key are one probe on the way, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows a range is to hold, the most ranges (their ends are literals of the plan), and keys sampled for each to place it.
RANGE_ROWS = 1_000_000
MAX_RANGES = 4096
SAMPLE = 16


def _literal(value) -> Column:
    return F.struct(*[_literal(v).alias(n) for n, v in value.asDict(recursive=False).items()]) if hasattr(value, "asDict") else F.lit(value)


def _splits(keys: DataFrame, name: str, ranges: int | None = None) -> list:
    """Keys that cut the rows into ranges of about the same size, from a sample by hash. Null keys are passed over."""
    keys = keys.where(F.col(name).isNotNull())
    if ranges is None:
        ranges = min(MAX_RANGES, 1 + keys.count() // RANGE_ROWS)
    if ranges < 2:
        return []
    rows = keys.orderBy(F.xxhash64(name), name).limit(SAMPLE * ranges).collect()
    values = sorted(r[0] for r in rows)
    return sorted({values[i * len(values) // ranges] for i in range(1, ranges)}) if values else []


def _range(value: Column, splits: list) -> Column:
    """How many splits are at or below a value, by two looks of about the square root of their number."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    blocks = [splits[i : i + step] for i in range(0, len(splits), step)]
    firsts = F.array(*[_literal(b[0]) for b in blocks])
    inner = F.array(*[F.array(*[_literal(x) for x in b]) for b in blocks])
    block = F.size(F.filter(firsts, lambda x: x <= value))
    within = F.size(F.filter(F.get(inner, block - 1), lambda x: x <= value))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + within)


def positions(rows: DataFrame, order: Column, out: str = "pos", ranges: int | None = None) -> DataFrame:
    """rows with their places, from 0, in an order without nulls (a struct for several columns, which tells every row
    apart): numbered within key ranges, to which the counts of the ranges before are added."""
    keyed = rows.withColumn("_k", order)
    keyed = keyed.withColumn("_r", _range(F.col("_k"), _splits(keyed.select("_k"), "_k", ranges)))
    counts = keyed.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row a range
    numbered = keyed.withColumn("_i", F.row_number().over(W.partitionBy("_r").orderBy("_k")) - 1)
    return numbered.join(F.broadcast(offsets), "_r").withColumn(out, F.col("_before") + F.col("_i")).select(*[f"`{c}`" for c in rows.columns], out)


def nearest(probes: DataFrame, probe: str, table: DataFrame, key: str, direction: str, strict: bool, out: str = "found_key", ranges: int | None = None) -> DataFrame:
    """probes with the table's nearest key at or `direction` ("prev" or "next") of the probe, null if there is none;
    strictly before or behind it if `strict`. Every probe row comes back, null probes without a key."""
    keys = table.select(F.col(f"`{key}`").alias("_k")).where("_k is not null")
    asked = probes.select(F.col(f"`{probe}`").alias("_k")).where("_k is not null").distinct()
    splits = _splits(keys.union(asked), "_k", ranges)
    down = direction == "prev"
    # At equal keys the table's row counts for the probe unless strict, so it has to come first on the way.
    left = asked.select("_k", F.lit(0 if strict else 1).alias("_o"), F.lit(True).alias("_p"))
    right = keys.select("_k", F.lit(1 if strict else 0).alias("_o"), F.lit(False).alias("_p"))
    both = left.union(right).withColumn("_r", _range(F.col("_k"), splits))
    along = W.partitionBy("_r").orderBy(F.col("_k").asc() if down else F.col("_k").desc(), F.col("_o")).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = F.last(F.when(~F.col("_p"), F.col("_k")), ignorenulls=True).over(along)
    ends = right.withColumn("_r", _range(F.col("_k"), splits)).groupBy("_r").agg((F.max if down else F.min)("_k").alias("_e"))
    every = probes.sparkSession.range(len(splits) + 1).select(F.col("id").cast("int").alias("_r")).join(ends, "_r", "left")
    before = W.orderBy(F.col("_r").asc() if down else F.col("_r").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = every.select("_r", (F.max if down else F.min)("_e").over(before).alias("_c"))  # one row a range
    found = both.withColumn("_n", near).where("_p").join(F.broadcast(carried), "_r").select("_k", F.coalesce("_n", "_c").alias("_f"))
    joined = probes.alias("p").join(found.alias("f"), F.col(f"p.`{probe}`") == F.col("f._k"), "left")
    return joined.select(*[F.col(f"p.`{n}`") for n in probes.columns], F.col("f._f").alias(out))


def find_prev(probes, probe, table, key, out="found_key", ranges=None):
    """Floor: the largest key at or below."""
    return nearest(probes, probe, table, key, "prev", False, out, ranges)


def find_before(probes, probe, table, key, out="found_key", ranges=None):
    """Lower: the largest key below."""
    return nearest(probes, probe, table, key, "prev", True, out, ranges)


def find_next(probes, probe, table, key, out="found_key", ranges=None):
    """Ceiling: the smallest key at or above."""
    return nearest(probes, probe, table, key, "next", False, out, ranges)


def find_after(probes, probe, table, key, out="found_key", ranges=None):
    """Higher: the smallest key above."""
    return nearest(probes, probe, table, key, "next", True, out, ranges)
