"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity has ordered grades 0 (none) to 3. One weight vector serves all thresholds: P(grade > k) is the logistic function
of w.x - t_k with t_0 < t_1 < t_2, so grades share what they learn; a grade's probability is the difference of two of
them, and its likelihood is what is maximised. The expected severity is the sum of the three probabilities. Features are the distinct words of a text and their beginnings, hashed; a linear model over them is
a sum over words, so that scoring looks each word up once.

The labels say toxic or not. Among toxic training texts the grade comes from how much of the text consists of features
that mark the toxic class: under 2 in 100 distinct words 1, under 5 2, else 3.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, ship

#: The most labelled documents that a model is fitted on, drawn by a hash of their ids.
SAMPLE = 20_000
DIMENSIONS = 1 << 20
PREFIXES = range(4, 9)
GRADES = 3
EPOCHS, RATE, SHRINK = 30, 0.3, 2e-5
#: A text is toxic from this probability of a grade above 0 on.
TOXIC_FROM = 0.3
#: A feature is used from this log ratio of its rates on, where so many toxic training texts, and such a share, have it.
MIN_LIFT, MIN_SEEN, MIN_SHARE = 0.5, 4, 0.01
CACHE = 400_000


def word_features(word: bytes) -> list[int]:
    """Hashes of a word, lower-cased and without marks around it, and of its beginnings."""
    text = word.decode("utf-8", "replace").lower().strip("#*$%&|<>!.,;:?\"'()[]-_")
    if not text:
        return []
    marks = [f"{text}$", *{text[:k] for k in PREFIXES if k <= len(text)}]
    return [zlib.crc32(m.encode()) % DIMENSIONS for m in marks]


def text_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Features, in how many distinct words of the text each occurs, and the number of distinct words."""
    words = {w.lower() for w in (text or b"").split()}
    found = np.array([f for w in words for f in word_features(w)], np.int64)
    ids, counts = np.unique(found, return_counts=True)
    return ids.astype(np.int32), counts.astype(np.int32), len(words)


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[bytes, float] = {}

    def word(self, word: bytes) -> float:
        s = self.known.get(word)
        if s is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            s = float(self.weights[word_features(word)].sum())
            if len(word) <= 64:
                self.known[word] = s
        return s

    def linear(self, text: bytes | None) -> float:
        words = {w.lower() for w in (text or b"").split()}
        return sum(sorted(map(self.word, words)))

    def probabilities(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(linear, float)[:, None], -60, 60)))


def grades(rows: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray, strong: set[int]) -> np.ndarray:
    """0 for texts that are not toxic, else 1 to 3 by the strong features in 100 distinct words."""
    out = np.zeros(len(rows), np.int64)
    for i in np.flatnonzero(toxic):
        ids, counts, distinct = rows[i]
        share = 100 * sum(int(n) for f, n in zip(ids, counts, strict=True) if int(f) in strong) / max(1, distinct)
        out[i] = 1 + (share >= 2) + (share >= 5)
    return out


def likelihood(linear: np.ndarray, t: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The negative log-likelihood of each text's grade under P(grade > k) = logistic(linear - t_k), and its derivatives by
    linear and by the thresholds (a row a text)."""
    at = np.arange(len(grade))
    above = np.ones((len(grade), len(t) + 2))  # P(grade > -1) = 1, P(grade > 0), ..., P(grade > last) = 0
    above[:, 1:-1] = 1 / (1 + np.exp(np.clip(t[None, :] - linear[:, None], -60, 60)))
    above[:, -1] = 0
    a, b = above[at, grade], above[at, grade + 1]
    p = np.maximum(a - b, 1e-12)
    by_t = np.zeros((len(grade), len(t) + 2))
    by_t[at, grade] = a * (1 - a) / p
    by_t[at, grade + 1] = -b * (1 - b) / p
    return -np.log(p), a + b - 1, by_t[:, 1:-1]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grade: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adagrad on the cumulative-link likelihood over mini-batches in a fixed order, with a soft threshold that keeps the
    weights sparse. Thresholds are the first and the logarithms of the steps between them, so that they stay in order."""
    w, gw = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    counts = np.bincount(grade, minlength=GRADES + 1)
    above = np.clip((counts[::-1].cumsum()[::-1][1:] + 0.5) / (len(grade) + 1), 1e-4, 1 - 1e-4)
    t = np.log(1 - above) - np.log(above)
    u = np.append(t[:1], np.log(np.maximum(np.diff(t), 0.1)))
    gu = np.full(GRADES, 1e-8)
    order = np.random.default_rng(7).permutation(len(rows))
    size = 64
    for _ in range(epochs):
        for lo in range(0, len(order), size):
            batch = order[lo : lo + size]
            ids = np.concatenate([rows[i][0] for i in batch])
            own = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            x = np.concatenate([rows[i][1] for i in batch]).astype(float)
            linear = np.bincount(own, weights=w[ids] * x, minlength=len(batch))
            _, by_linear, by_t = likelihood(linear, thresholds(u), grade[batch])
            uniq, inv = np.unique(ids, return_inverse=True)
            g = np.bincount(inv, weights=by_linear[own] * x, minlength=len(uniq)) / len(batch)
            gw[uniq] += g * g
            step = RATE / np.sqrt(gw[uniq])
            new = w[uniq] - step * g
            w[uniq] = np.sign(new) * np.maximum(np.abs(new) - step * SHRINK, 0)
            # Every threshold moves with the steps below it.
            du = by_t.mean(axis=0)[::-1].cumsum()[::-1]
            du[1:] *= np.exp(u[1:])
            gu += du * du
            u = u - RATE / np.sqrt(gu) * du
            u[1:] = np.clip(u[1:], -5, 5)
    return Model(w.astype(np.float32), thresholds(u))


def thresholds(u: np.ndarray) -> np.ndarray:
    return np.cumsum(np.append(u[:1], np.exp(u[1:])))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` labelled documents, none of them with crc32(doc_id as text) mod 5 = 0; None without
    labels of both kinds.

    A model may use only telling features, those that a share of the toxic texts have and that are rarer in the others;
    without that the many words that mark neither class would drown the few that do in a long text. They are counted
    and chosen on the executors, and of each text only they come to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    doc_id = F.col("doc_id")
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & doc_id.isNotNull())
    marked = marked.where(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "toxic", F.col("text").cast("binary").alias("t"))
    texts = cut(texts, "toxicity")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMENSIONS, np.int32)
        for batch in batches:
            for t in batch.column(2):
                seen[text_features(t.as_py())[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["f", "n1"])

    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    rare = texts.where("toxic = 1").mapInArrow(tally, "f int, n1 int").groupBy("f").agg(F.sum("n1").alias("n1")).where(F.col("n1") >= max(MIN_SEEN, n[1] * MIN_SHARE))
    possible = {r["f"]: r["n1"] for r in rare.collect()}
    allowed = spark.sparkContext.broadcast(np.array(sorted(possible), np.int32))  # DIMENSIONS numbers at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(2):
                ids, counts, distinct = text_features(t.as_py())
                keep = np.isin(ids, allowed.value)
                rows.append((ids[keep], counts[keep], distinct))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int32())],
                ["doc_id", "toxic", "ids", "counts", "n"],
            )

    slim = cut(texts.mapInArrow(extract, f"doc_id {kind}, toxic int, ids array<int>, counts array<int>, n int"), "toxicity-features")
    clean = {r["f"]: r["n"] for r in slim.where("toxic = 0").select(F.explode("ids").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    lift = {f: np.log((k + 0.5) / (n[1] + 1)) - np.log((clean.get(f, 0) + 0.5) / (n[0] + 1)) for f, k in possible.items()}
    telling = [f for f, x in lift.items() if x > MIN_LIFT]
    strong = {f for f in telling if lift[f] > 2.5 and possible[f] >= max(5, n[1] // 100)}
    used = spark.sparkContext.broadcast(np.array(sorted(telling), np.int32))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for ids, counts in zip(batch.column(2), batch.column(3), strict=True):
                ids, counts = np.array(ids.values, np.int32), np.array(counts.values, np.int32)
                mask = np.isin(ids, used.value)
                kept.append((ids[mask], counts[mask]))
            columns = [pa.array([k[i] for k in kept], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, batch.column(4)], batch.schema.names)

    found = slim.mapInArrow(keep, slim.schema).orderBy("doc_id", "n", "ids", "counts").limit(2 * sample).toArrow()  # a few numbers a text
    rows = [
        (np.array(ids.values, np.int64), np.array(counts.values, np.int64), n.as_py())
        for ids, counts, n in zip(found.column("ids"), found.column("counts"), found.column("n"), strict=True)
    ]
    toxic = found.column("toxic").to_numpy().astype(np.int64)
    return fit(rows, grades(rows, toxic, strong))


def severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with further columns severity (expected grade, 0 to 3), toxic_probability, grade (the likeliest) and toxic.

    Replaces columns of those names that docs has. Every row is scored by its whole text; null and empty texts, and all
    texts where labels of one kind are missing, have severity 0 and are not toxic. Rows that repeat are scored alike.
    """
    spark = docs.sparkSession
    model = train(docs, labels, sample)
    if model is not None:
        held = spark.sparkContext.broadcast(pack(model))  # DIMENSIONS bounds it: the nonzero weights, under 12 MB
    named = ["severity", "toxic_probability", "grade", "toxic"]
    kept = [c for c in docs.columns if c not in named]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = unpack(held.value) if model is not None else None
        for batch in batches:
            texts = [t.as_py() for t in batch.column(batch.num_columns - 1)]
            if ours is None:
                p = np.zeros((len(texts), GRADES))
            else:
                p = ours.probabilities(np.array([ours.linear(t) for t in texts], float))
                p[[not (t or b"").strip() for t in texts]] = 0
            exact = np.concatenate([np.ones((len(p), 1)), p], axis=1) - np.concatenate([p, np.zeros((len(p), 1))], axis=1)
            more = [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(exact.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= TOXIC_FROM)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*kept, *named])

    schema = docs.select(*kept).schema
    for name, kind in zip(named, ("double", "double", "integer", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.select(*kept, F.col("text").cast("binary").alias("text as bytes")).mapInArrow(apply, schema)


_models: dict[int, Model] = {}


def pack(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(model.weights)
    return at.astype(np.int32), model.weights[at], model.thresholds


def unpack(packed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Model:
    """The model, once a worker."""
    at, values, thresholds = packed
    key = hash((at.tobytes(), values.tobytes()))
    if key not in _models:
        _models.clear()
        w = np.zeros(DIMENSIONS, np.float32)
        w[at] = values
        _models[key] = Model(w, thresholds)
    return _models[key]
