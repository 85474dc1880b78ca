"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only.

Every document gets the key -ln(u) / w: u is uniform in (0, 1], a hash of its id and a seed, and w its quality weight.
Taking the documents of a source in ascending key order is weighted sampling without replacement. A source whose
target exceeds its size is taken whole as often as fits (complete epochs) before the rest is drawn by key.

The running sums of a source never need its documents in one task: keys fall into ordered buckets, the sizes of the
buckets are summed, and only those documents that share a bucket with the budget's end are ordered row by row. The
bucket count follows the row count, so that last bucket stays small whatever the size of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.llm.common import count_of, cut, words_sql

#: Rows that one bucket is to hold, and the most times a source may be repeated.
BUCKET_ROWS = 2_000
MAX_EPOCHS = 3
#: Quality weights for which the buckets are even.
KEY_SCALES = (1.0, 0.25, 0.0625)
SEED = "mix-1"


def text_size(text: Column) -> Column:
    return F.size(words_sql(text)).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """A sampling weight in (0, 1]: a text with s symbols (#*$%&|<>) a word weighs 1 / (1 + s)."""
    symbols = count_of(F.coalesce(text, F.lit("")), "[#*$%&|<>]")
    return F.lit(1.0) / (F.lit(1.0) + symbols / F.greatest(size, F.lit(1)))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in (0, 1], from the first 13 hex digits (52 bits) of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 1.0) / float(2**52)


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target.

    Sources by code point, null last, weigh 1, 2, 3 and so on again. They share all words by weight; a target stops
    at max_epochs times its source's size and what is over goes to the others by weight. The water level is found
    exactly: sources are capped in ascending order of cap / weight, so one running sum finds the first uncapped one.
    One row a source goes through one task; documents never do.
    """
    n = len(weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    caps = sizes.select("source", "source_size", pick.cast("long").alias("weight")).withColumn("cap", F.col("source_size") * max_epochs)
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = caps.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("rest"),
    ).withColumn("free", (F.col("total") - F.col("capped")) * F.col("weight") <= F.col("cap") * F.col("rest"))
    # Once a source is free all later ones are; they share what the capped ones leave.
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("capped"), F.col("rest")))).over(whole)
    level = level.withColumn("at", first).withColumn("is_free", F.max(F.col("free").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) == 1)
    share = (F.col("at.capped") * -1 + F.col("total")).cast("double") * F.col("weight") / F.col("at.rest")
    return level.select("source", "source_size", F.when(F.col("is_free"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED, keep: Column | None = None) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, taken, copies, sample_key, kept.

    `keep` is an expression over docs whose value comes back as kept, for telling rows apart (null without one).

    Null texts have size 0; a null source is a source of its own, ordered last; a null id hashes as the empty string.
    Rows that repeat an id are separate rows with the same key, ordered by size; equal rows are interchangeable. An
    empty table gives an empty result. Other columns of docs are ignored, whatever their names. A document is drawn
    when the budget reaches its middle, so a source misses its target by at most half a document.
    """
    size = text_size(F.col("_t"))
    mark = F.lit(None).cast("long") if keep is None else keep
    slim = docs.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text").alias("_t"), mark.alias("_m"))
    slim = slim.select("_d", "_s", "_m", size.alias("_n"), "_t").withColumn("_w", text_quality(F.col("_t"), F.col("_n")))
    slim = slim.select("_d", "_s", "_m", "_n", (-F.log(uniform(F.col("_d"), seed)) / F.col("_w")).alias("_k"))
    slim = cut(slim, "mix")
    rows = slim.count()
    buckets = max(16, -(-rows // BUCKET_ROWS))
    # Each term spreads the keys of documents of about that weight evenly; the mean is monotone, so it keeps their order.
    spread = sum((F.lit(1.0) - F.exp(-F.col("_k") * c) for c in KEY_SCALES[1:]), F.lit(1.0) - F.exp(-F.col("_k") * KEY_SCALES[0])) / len(KEY_SCALES)
    slim = slim.withColumn("_b", F.floor(spread * buckets))

    sums = slim.groupBy("_s", "_b").agg(F.sum("_n").alias("_n"))
    running = sums.withColumn("_before", F.sum("_n").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    running = running.select("_s", "_b", F.col("_n").alias("_bn"), F.coalesce("_before", F.lit(0)).alias("_before"))
    targets = source_targets(sums.groupBy("_s").agg(F.sum("_n").alias("source_size")).withColumnRenamed("_s", "source"), max_epochs)
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    buckets_plan = running.join(plan.withColumnRenamed("source", "_p"), F.col("_s").eqNullSafe(F.col("_p"))).select(
        F.col("_s").alias("_ps"), F.col("_b").alias("_pb"), "_bn", "_before", "source_size", "target", "epochs", "budget"
    )
    # One row a bucket: joined by both columns, so that a large source is spread over its buckets.
    full = slim.join(buckets_plan, F.col("_s").eqNullSafe(F.col("_ps")) & (F.col("_b") == F.col("_pb")))
    # Buckets before the budget's end are taken whole, those behind it not at all: only the one it ends in is ordered.
    open_bucket = (F.col("_before") < F.col("budget")) & (F.col("_before") + F.col("_bn") > F.col("budget"))
    inside = W.partitionBy("_s", "_b").orderBy("_k", "_d", "_n", "_m").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ordered = full.where(open_bucket).withColumn("_drawn", at * 2 + F.col("_n") <= F.col("budget") * 2)
    whole = full.where(~open_bucket).withColumn("_drawn", F.col("_before") + F.col("_bn") <= F.col("budget"))
    full, drawn = whole.unionByName(ordered), F.col("_drawn")
    return full.select(
        F.col("_d").alias("doc_id"),
        F.col("_s").alias("source"),
        F.col("_n").alias("size"),
        "source_size",
        "target",
        ((F.col("epochs") + drawn.cast("long")) * F.col("_n")).alias("taken"),
        (F.col("epochs") + drawn.cast("long")).alias("copies"),
        F.col("_k").alias("sample_key"),
        F.col("_m").alias("kept"),
    )


def mixed_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents that the mix takes, with all their columns and source_size, target, taken and copies (those names
    are replaced). Rows equal in id, text and source come once, with the copies of all of them."""
    new = ["size", "source_size", "target", "taken", "copies"]
    plan = mix(docs, max_epochs, seed, keep=F.xxhash64("text"))
    plan = plan.groupBy("doc_id", "kept", "source").agg(*[(F.sum if c in ("taken", "copies") else F.first)(c).alias(c) for c in new], F.count(F.lit(1)).alias("_rows"))
    plan = cut(plan.where("copies > 0").withColumnsRenamed({"doc_id": "_pd", "source": "_ps", "kept": "_pt"}), "mix-plan")
    state = plan.agg(F.count(F.lit(1)).alias("n"), F.max("_rows").alias("most")).first()
    if (state["most"] or 0) > 1:
        docs = docs.dropDuplicates(["doc_id", "text", "source"])
    if state["n"] <= broadcast_rows:  # a few numbers a row
        plan = F.broadcast(plan)
    same = F.col("d.doc_id").eqNullSafe(F.col("_pd")) & F.col("d.source").eqNullSafe(F.col("_ps")) & (F.xxhash64(F.col("d.text")) == F.col("_pt"))
    kept = [F.col(f"d.`{c}`") for c in docs.columns if c not in new]
    return docs.alias("d").join(plan.alias("p"), same).select(*kept, *[F.col(f"p.{c}") for c in new])
