"""Benchmark decontamination: finds short test items inside long documents.

Containment is the share of an item's distinct word shingles that a document has. Jaccard MinHash cannot find it, as a
long document's own shingles swamp the few of an item. Here only items are sketched: an item keeps the smallest hashes
of its shingles, and a document is probed with all of its own. Items are partitioned by size, and a partition's sketch
has one hash more than an item of its largest size may lack at the threshold, so by the pigeonhole principle a contained
item always shares a sketch hash with the document: candidates are complete. They are verified by the exact containment
of the shingles themselves.

The benchmark is taken in blocks of bounded size, each sent to all executors; the documents stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import ship

WORDS = 5
THRESHOLD = 0.8
#: Characters of items in a block: what is sent to executors at once.
BLOCK_CHARS = 8 << 20
#: Distinct words whose hashes a worker remembers.
CACHE = 100_000
#: Rows that go back to Spark at a time; what it sends are up to 10,000 whole texts.
STEP = 256
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def as_bytes(column: pa.Array) -> pa.Array:
    """A column of strings as their bytes, which need not be valid UTF-8; nothing is copied."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHE:
            self.clear()
        h = xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingle_hashes(ids: np.ndarray, words: int) -> np.ndarray:
    """A hash of every run of `words` words, from the words' hashes."""
    n = len(ids) - words + 1
    h = np.zeros(n, np.uint64)
    for i in range(words):
        h = (h ^ ids[i : i + n]) * np.uint64(_FACTORS[i % len(_FACTORS)])
        h ^= h >> np.uint64(31)
    return h


def sketch_size(size: int, threshold: float) -> int:
    """Of the partition that holds items of this size, up to a power of two: one more than its largest may lack."""
    largest = 1 << max(3, (size - 1).bit_length())
    return min(size, largest - math.ceil(threshold * largest - 1e-9) + 1)


class Index:
    """Sketches of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], words: int = WORDS, threshold: float = THRESHOLD):
        self.words, self.threshold = words, threshold
        known = _Hashes()
        self.items: list[tuple[int | None, int, set[bytes]]] = []  # id, shingle width, shingles
        self.hashes: list[np.ndarray] = []
        sketches: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            found = words_of(text)
            width = min(words, len(found))
            if not width:
                continue
            shingles = {b" ".join(found[i : i + width]) for i in range(len(found) - width + 1)}
            hashes = np.unique(shingle_hashes(np.array([known[w] for w in found], np.uint64), width))
            at = len(self.items)
            self.items.append((item_id, width, shingles))
            self.hashes.append(hashes)
            sketches.setdefault(width, []).extend((int(h), at) for h in hashes[: sketch_size(len(hashes), threshold)])
        self.sketches = {}
        for width, pairs in sketches.items():
            pairs.sort()
            keys = np.array([p[0] for p in pairs], np.uint64)
            gate = np.zeros(1 << 20, bool)
            gate[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.sketches[width] = (keys, np.array([p[1] for p in pairs], np.int64), gate)

    def matches(self, text: bytes | None, known: _Hashes) -> list[tuple[int | None, int, int]]:
        """(item, its shingles, those that the text has) of every item contained in a text."""
        found = words_of(text)
        out: list[tuple[int | None, int, int]] = []
        if not found:
            return out
        ids = None
        for width, (keys, owner, gate) in self.sketches.items():
            if len(found) < width:
                continue
            if ids is None:
                ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
            hashes = shingle_hashes(ids, width)
            near = hashes[gate[(hashes >> np.uint64(44)).astype(np.int64)]]
            if not len(near):
                continue
            lo, hi = np.searchsorted(keys, near, "left"), np.searchsorted(keys, near, "right")
            candidates = {int(i) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True) for i in owner[a:b]}
            if not candidates:
                continue
            own = np.unique(hashes)
            shingles: set[bytes] | None = None
            for i in sorted(candidates):
                need = self.threshold * len(self.hashes[i]) - 1e-9
                at = np.minimum(np.searchsorted(own, self.hashes[i]), len(own) - 1)
                if (own[at] == self.hashes[i]).sum() < need:
                    continue
                if shingles is None:
                    shingles = {b" ".join(found[j : j + width]) for j in range(len(found) - width + 1)}
                item_id, _, theirs = self.items[i]
                shared = len(theirs & shingles)
                if shared >= self.threshold * len(theirs) - 1e-9:
                    out.append((item_id, len(theirs), shared))
        return out


def _blocks(benchmark: DataFrame, words: int, threshold: float) -> Iterator[Index]:
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).select("i", F.col("t").cast("binary").alias("t")).collect()
        yield Index(sorted(((r.i, bytes(r.t)) for r in rows), key=repr), words, threshold)


def contained(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> doc_id, item_id, n_shingles, n_shared, containment: one
    row for every document and item of which it has `threshold` or more.

    Words are lower-cased (A-Z) and split at white space. An item of fewer than `words` words is one shingle; one without
    words is found nowhere. Null and empty texts contain nothing. Rows that repeat, on either side, match row by row;
    null ids are kept as null. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, n_shingles int, n_shared int, containment double"
    out = None
    for index in _blocks(benchmark, words, threshold):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = _Hashes()
            for batch in batches:
                rows = [(i, m) for i, t in enumerate(batch.column(1)) for m in held.value.matches(t.as_py(), known)]
                items, sizes, shared = ([m[k] for _, m in rows] for k in range(3))
                ids = batch.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
                ratio = [s / n for n, s in zip(sizes, shared, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(items, pa.int64()), pa.array(sizes, pa.int32()), pa.array(shared, pa.int32()), pa.array(ratio, pa.float64())], ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        found = docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def clean_rows(batches: Iterator[pa.RecordBatch], index: Index, at: int) -> Iterator[pa.RecordBatch]:
    """The rows whose text, column `at`, contains no item of the index, STEP rows at a time."""
    known = _Hashes()
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            rows = batch.slice(lo, STEP)
            clean = [not index.matches(t.as_py(), known) for t in as_bytes(rows.column(at))]
            yield rows.filter(pa.array(clean, pa.bool_()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    schema = docs.schema
    at = [c.lower() for c in docs.columns].index("text")
    for index in _blocks(benchmark, words, threshold):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            return clean_rows(batches, held.value, at)

        docs = docs.mapInArrow(run, schema)
    return docs
