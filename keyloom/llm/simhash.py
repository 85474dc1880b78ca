"""SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint of b bits is cut into k // 2 + 1 segments. If two fingerprints differ in k bits or fewer, one segment
differs in one bit at most: either some segment is equal, or some segment differs in one bit. Each segment is indexed
by its value, and by its value with one bit wild for every bit; the side on which that bit is 0 is joined with the side
on which it is 1, so that equal segments meet once and not once a bit. If no segment is equal, at least 2m - k of the m
segments differ in exactly one bit, so k - m + 1 of them need wild variants.

The joins are equality joins over distinct fingerprints and compare the whole fingerprints in the join condition: only
true links leave them. A fingerprint has a bounded number of others within k bits, so links grow with the fingerprints.
Equal fingerprints are one node; copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.llm.common import cut, ship
from keyloom.llm.components import components

BITS = 64
#: Shingles that are turned into bits at a time; texts of any length are taken whole.
BLOCK = 1 << 15


def shingle_hashes(text: bytes | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased (A-Z) text, repeats included."""
    from xxhash import xxh64_intdigest as xxh

    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) < words:
        return np.array([xxh(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(found) - words] + 1)).tolist()
    return np.fromiter((xxh(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without hashes. As a signed 64-bit number."""
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK]
        count += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, fp. Null and blank texts have fingerprint 0; other columns are ignored."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def cuts(bits: int, most: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments, from the lowest bits on."""
    m = most // 2 + 1
    edges = [i * bits // m for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """distinct(fp) without repeats -> a, b with a < b: all pairs that differ in 1 to most bits."""
    segments = cuts(BITS, most)
    m = len(segments)
    close = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= most
    fp = F.col("fp")

    # Equal segments. The rest differs in most bits or fewer, so one of most + 1 parts of it is equal too: a second
    # key that keeps a segment value shared by very many fingerprints from becoming one group.
    keys = []
    for i, (shift, width) in enumerate(segments):
        others = [(s, w) for j, (s, w) in enumerate(segments) if j != i]
        parts: list[list[tuple[int, int]]] = []
        if others:
            flat = [s + x for s, w in others for x in range(w)]
            bounds = [j * len(flat) // (most + 1) for j in range(most + 2)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                part = flat[lo:hi]
                runs = [[part[0], 1]]
                for bit in part[1:]:
                    if bit == runs[-1][0] + runs[-1][1]:
                        runs[-1][1] += 1
                    else:
                        runs.append([bit, 1])
                parts.append([tuple(r) for r in runs])
        for p, runs in enumerate(parts or [[]]):
            rest = F.lit(0).cast("long")
            for s, w in runs:
                rest = F.shiftleft(rest, w).bitwiseOR(_segment(fp, s, w))
            keys.append(F.struct(F.lit(i * (most + 1) + p).alias("k"), _segment(fp, shift, width).alias("v"), rest.alias("r")))
    equal = distinct.select(fp, F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.v", "key.r")
    left, right = (equal.select(F.col("fp").alias(f"f{x}"), *[F.col(c).alias(f"{c}{x}") for c in "kvr"]) for x in "ab")
    same = left.join(right, (F.col("ka") == F.col("kb")) & (F.col("va") == F.col("vb")) & (F.col("ra") == F.col("rb")) & (F.col("fa") < F.col("fb")) & close)

    # One wild bit, where no segment need be equal.
    variants = []
    for i, (shift, width) in enumerate(segments[: max(0, most - m + 1)]):
        for bit in range(width):
            masked = _segment(fp, shift, width).bitwiseAND(F.lit(~(1 << bit)).cast("long"))
            variants.append(F.struct(F.lit(i * BITS + bit).alias("k"), masked.alias("v"), _segment(fp, shift + bit, 1).alias("one")))
    found = same.select("fa", "fb")
    if variants:
        wild = distinct.select(fp, F.explode(F.array(*variants)).alias("key")).select("fp", "key.k", "key.v", "key.one")
        zero = wild.where("one = 0").select(F.col("fp").alias("fa"), F.col("k").alias("ka"), F.col("v").alias("va"))
        one = wild.where("one = 1").select(F.col("fp").alias("fb"), F.col("k").alias("kb"), F.col("v").alias("vb"))
        found = found.union(zero.join(one, (F.col("ka") == F.col("kb")) & (F.col("va") == F.col("vb")) & close).select("fa", "fb"))
    return found.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 2, seed: int = 42) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, fp, component_id: the smallest doc_id reachable over links.

    Documents link if their fingerprints differ in `most` bits or fewer. Every row counts, repeats of an id too; a null
    id takes part but names no class (a class of nothing but null ids has component_id null). Null and blank texts have
    fingerprint 0 and link like any others. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, words, seed), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    linked = components(links(nodes.select("fp"), most))
    # A class of fingerprints is named by its smallest fingerprint; its smallest document comes from the nodes.
    of = nodes.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = of.join(named, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


# Groups of near copies among documents, for dropping all but one.
#
# Two texts of which 5-word shingles agree to four fifths differ in some ten bits of a fingerprint of shingles, too many
# for any index; of a fingerprint of their distinct words they differ in about four. So candidates come from several
# fingerprints of words, and a candidate counts if the shingles' exact Jaccard similarity is high enough.

#
# Candidates are found in two steps: neighbours under each signature are linked first, and then all pairs of candidates
# that this has left in different classes. The classes are those of all pairs, but a class of very many copies is not
# compared with itself.

TABLES = 3
#: Texts that may share a signature before their shingles' bitmaps go with them into the join.
CROWD = 64
#: 64-bit words of a bitmap of shingles; the bits of a class's number that are its own.
PARITIES = 8
BITMAP = [f"m{i}" for i in range(PARITIES)]
CLASS_BITS = 57
CLASS = (1 << CLASS_BITS) - 1
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def word_fingerprints(text: bytes | None, tables: int = TABLES) -> list[int]:
    """Fingerprints of a text's distinct lower-cased words under several hashes."""
    from xxhash import xxh64_intdigest as xxh

    words = {*(text or b"").lower().split()}
    h = np.fromiter(map(xxh, words), np.uint64, len(words))
    out = []
    for t in range(tables):
        x = (h ^ np.uint64(_SPREAD[t % 4])) * np.uint64(_SPREAD[(t + 1) % 4] + 2 * (t // 4))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_SPREAD[(t + 2) % 4])
        out.append(fingerprint(x ^ (x >> np.uint64(29))))
    return out


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes, 32 bits each, in order."""
    return np.unique((shingle_hashes(text, words, 0) >> np.uint64(32)).astype(np.uint32))


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each value of the low bits of the hashes, whether an odd number of them has it, as PARITIES 64-bit numbers."""
    odd = np.bincount(shingles % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _signed(nodes: DataFrame, most: int, wild: bool, more: list[str] | None = None) -> DataFrame:
    """nodes(t, c, fps, more) -> t, c, more, fp, k: a row for every signature of every text's fingerprints. The number of a
    signature (see _first_signature) is in bits 32 to 39 of k, the table above them, the value of the segment below."""
    segments = cuts(BITS, most)
    fp, values = F.col("fp"), [_segment(F.col("fp"), shift, width) for shift, width in segments]
    if wild:
        for shift, width in segments[: max(0, most - len(segments) + 1)]:
            values += [_segment(fp, shift, width).bitwiseAND(F.lit(~(1 << bit)).cast("long")) for bit in range(width)]
    keys = [(F.col("table").cast("long") * 256 + i) * (1 << 32) + v for i, v in enumerate(values)]
    kept = ["t", "c", *(more or [])]
    return nodes.select(*kept, F.posexplode("fps").alias("table", "fp")).select(*kept, "fp", F.explode(F.array(*keys)).alias("k"))


def _first_signature(x: Column, most: int) -> Column:
    """The number of the first signature that two fingerprints share, of their exclusive or: a segment that is equal, or
    after all those a segment and its one bit that differs."""
    segments = cuts(BITS, most)
    found, at = [], len(segments)
    for i, (shift, width) in enumerate(segments):
        found.append(F.when(_segment(x, shift, width) == 0, F.lit(i)))
    for shift, width in segments[: max(0, most - len(segments) + 1)]:
        value = _segment(x, shift, width)
        found.append(F.when(F.bit_count(value) == 1, F.lit(at) + F.bit_count(value - 1)))
        at += width
    return F.coalesce(*found)


def chain_links(nodes: DataFrame, most: int = 4) -> DataFrame:
    """nodes(t, c, fps) -> a, b: of the texts with an equal segment, neighbours within `most` bits in the order of
    fingerprints. A group of n similar texts gives n links a signature and not n squared; not all pairs are among them."""
    # Texts with the same fingerprint in a table are chained by their ids in the same order.
    order = W.partitionBy("k").orderBy("fp", "t")
    chained = _signed(nodes, most, wild=False).select("t", "fp", F.lag("t").over(order).alias("t0"), F.lag("fp").over(order).alias("fp0"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp0"))) <= most
    return chained.where(near & (F.col("t0") != F.col("t"))).select(F.least("t", "t0").alias("a"), F.greatest("t", "t0").alias("b")).distinct()


def candidate_links(rows: DataFrame, nodes: DataFrame, words: int, similarity: float, most: int = 4, crowd: int = CROWD) -> DataFrame:
    """rows(t, x), nodes(t, c, fps) -> a, b with a < b: of the texts of different classes c (null: a class of its own), all
    pairs with fingerprints within `most` bits (2 or more) in some table, but for some whose shingle sets cannot have that
    Jaccard similarity.

    Under each signature the class that sorts last, a large one as classes number by size, is compared with the other
    texts but not within itself. A pair leaves the join only under the first signature it shares. Where more than `crowd`
    texts share a signature (a family of texts alike in their words), the join also compares sizes and parity bitmaps of
    the shingle sets, so that of such a family too only pairs that may be similar leave it.
    """
    nodes = nodes.withColumn("c", F.coalesce("c", F.col("t").bitwiseAND(F.lit(CLASS).cast("long"))))

    def shared(of: DataFrame, more: list[str]) -> DataFrame:
        by = W.partitionBy("k")
        signed = _signed(of, most, True, more).select("*", F.min("c").over(by).alias("least"), F.max("c").over(by).alias("last"), F.count(F.lit(1)).over(by).alias("size"))
        return signed.where(F.col("least") < F.col("last"))

    def met(signed: DataFrame, more: list[str], also: Column) -> DataFrame:
        left, right = (signed.select(*[F.col(c).alias(f"{c}{x}") for c in ("t", "c", "fp", "k", "last", *more)]) for x in "ab")
        x = F.col("fpa").bitwiseXOR(F.col("fpb"))
        first = F.shiftright("ka", 32).bitwiseAND(F.lit(255).cast("long")) == _first_signature(x, most)
        once = (F.col("cb") == F.col("lasta")) | (F.col("ta") < F.col("tb"))
        found = left.where("ca < lasta").join(right, (F.col("ka") == F.col("kb")) & (F.bit_count(x) <= most) & (F.col("ca") != F.col("cb")) & once & first & also)
        return found.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()

    # One pass gives the pairs under the other signatures and the texts under crowded ones (b null).
    signed, crowded = shared(nodes, []), F.col("size") > crowd
    found = met(signed.where(~crowded), [], F.lit(True)).union(signed.where(crowded).select("t", F.lit(None).cast("long")).distinct())
    found = cut(found, "copy-met")
    pairs, dense = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("t"))
    if dense.isEmpty():
        return pairs
    more = ["n", *BITMAP]
    dense = nodes.join(_shingles(rows, dense, words).select("t", *more), "t")
    return pairs.union(met(shared(dense, more).where(crowded), more, able(similarity))).distinct()


def _numbered(linked: DataFrame) -> DataFrame:
    """components() -> t, c: every text of a class of two or more with the class's number, which grows with the class's
    size (its power of two in the bits above CLASS)."""
    sizes = linked.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("n"))
    number = F.shiftleft(F.floor(F.log2("n")).cast("long"), CLASS_BITS).bitwiseOR(F.col("component").bitwiseAND(F.lit(CLASS).cast("long")))
    sizes = sizes.select("component", number.alias("c"))
    return linked.join(sizes, "component").select(F.col("node").alias("t"), "c").union(sizes.select(F.col("component").alias("t"), "c"))


def _shingles(rows: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """rows(t, x), ids(t) -> t, s (the hashes of the text's distinct shingles), n (their number) and their parity bitmap."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            maps = np.array([parities(s) for s in found], np.int64).reshape(-1, PARITIES)
            columns = [batch.column(0), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(maps[:, i]) for i in range(PARITIES)], ["t", "s", "n", *BITMAP])

    ids = F.broadcast(ids) if ids.count() <= 1_000_000 else ids
    schema = "t long, s binary, n long, " + ", ".join(f"{m} long" for m in BITMAP)
    found = rows.select("t", "x").join(ids, "t", "left_semi").mapInArrow(sets, schema)
    return cut(found.groupBy("t").agg(*[F.first(c).alias(c) for c in ("s", "n", *BITMAP)]), "copy-shingles")


def able(similarity: float) -> Column:
    """Whether the sets of na and nb shingles with bitmaps m0a, m0b ... can have that Jaccard similarity.

    Sets that similar differ in at most (1 - s) / (1 + s) of their summed sizes, and by at least as many shingles as bits
    of their parity bitmaps differ.
    """
    differ = F.lit(0)
    for m in BITMAP:
        differ = differ + F.bit_count(F.col(f"{m}a").bitwiseXOR(F.col(f"{m}b")))
    sizes = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6
    return sizes & (differ <= (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def similar_links(rows: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """rows(t, x), pairs(a, b) -> a, b: the pairs whose texts' shingle sets have that Jaccard similarity. Sizes and parity
    bitmaps rule most other pairs out before the sets are fetched."""
    shingles = _shingles(rows, cut(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct(), "copy-ids"), words)
    ma, mb = (shingles.select(F.col("t").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", *BITMAP)]) for x in "ab")
    may = cut(pairs.join(ma, "a").join(mb, "b").where(able(similarity)).select("a", "b"), "copy-able")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    sa, sb = (shingles.select(F.col("t").alias(n), F.col("s").alias(f"s{n}")) for n in "ab")
    return cut(may.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long"), "copy-links")


def surplus_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, most: int = 4, tables: int = TABLES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, t (hash of the text), kept_id: the documents to drop, with the one that stays.

    Groups are what links of `similarity` (Jaccard of distinct shingles of `words` words; fewer words are one shingle)
    reach, equal texts included; the smallest doc_id of a group stays (null last, then by the text's hash). All null
    texts are one text, and all texts without words equal in it.
    """
    ship(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [word_fingerprints(t.as_py(), tables) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "t", "fps"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("x"))
    table = cut(rows.mapInArrow(prints, f"doc_id {kind}, t long, fps array<long>"), "copies")
    nodes = table.groupBy("t").agg(F.first("fps").alias("fps"))
    nodes = cut(nodes, "copy-nodes")
    verified = similar_links(rows, cut(chain_links(nodes.select("t", F.lit(None).cast("long").alias("c"), "fps"), most), "copy-pairs"), words, similarity)
    linked = components(verified)
    classed = nodes.join(_numbered(linked), "t", "left")
    more = similar_links(rows, cut(candidate_links(rows, classed, words, similarity, most), "copy-pairs"), words, similarity)
    # The classes found so far are stars already: only what joins them is new.
    linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t")
    per_text = table.groupBy("t").agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("n"))
    per_text = per_text.join(linked.withColumnRenamed("node", "t"), "t", "left").withColumn("class", F.coalesce("component", "t"))
    named = per_text.groupBy("class").agg(F.min("f").alias("f"), F.sum("n").alias("n")).where("n > 1")
    of = per_text.select("t", "class").join(named.select("class", "f"), "class").select("t", "f")
    member = table.select("doc_id", "t").join(of, "t")
    stays = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t") == F.col("f.t"))
    return member.where(~stays).select("doc_id", "t", F.col("f.doc_id").alias("kept_id")).distinct()


def drop_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without all but one document of each group of near copies, with all their columns. Rows equal in id and text
    are copies too."""
    gone = cut(surplus_copies(docs, words, similarity).select(F.col("doc_id").alias("_gd"), F.col("t").alias("_gt")), "copy-gone")
    twice = docs.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").limit(1).count()
    if twice:
        docs = docs.dropDuplicates(["doc_id", "text"])
    if gone.count() <= broadcast_rows:  # two numbers a row
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gd"]) & (F.xxhash64(docs["text"]) == gone["_gt"]), "left_anti")
