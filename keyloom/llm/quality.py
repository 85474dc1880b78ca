"""A quality classifier learned from positive and unlabelled documents.

Trusted positives are labelled documents of quality 1; everything else the model sees is unlabelled text. Labels of
quality 0 are not used. With the share of good documents (the class prior) estimated, the risk of calling unlabelled text
bad, less what good documents add to it, is an unbiased estimate of the risk on bad documents; the non-negative form does
not let that estimate go below zero, which is where a flexible model would overfit.

The prior comes from positives and unlabelled text too. Where the model tells nothing but good documents, unlabelled text
is a mixture of good and bad: the share of unlabelled documents that score at least s is no less than the prior times the
share of positives that do. The smallest ratio of the two over all s with enough positives below bounds the prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, ship

#: The most positives and the most unlabelled documents that a model is fitted on; drawn by a hash of their ids.
SAMPLE = 20_000
#: Cuts at which each feature is binned, as quantiles of all documents.
QUANTILES = (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6, 0.8, 0.9, 0.94, 0.97, 0.99)
#: And as quantiles of the values above zero.
SOME = (0.1, 0.3, 0.5, 0.7, 0.9)
STEPS, RATE, DECAY = 1500, 0.05, 1e-4
#: The class prior: steps of the models it is estimated with, and the share of positives that a score must leave (of fewer
#: the ratio is noisy, and the smallest of noisy ratios too small).
PRIOR_STEPS, PRIOR_LEAST = 300, 0.5
FEATURES = ("log_words", "mean_word", "distinct", "distinct_pairs", "distinct_lines", "symbols", "bangs", "pipes", "capitals", "digits", "points", "other_bytes")


def features(text: bytes | None) -> list[float]:
    """Counts and ratios of a whole text; of an empty one zeros."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    tally = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = sum(map(len, words))
    letters = max(1, int(tally[65:91].sum() + tally[97:123].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        chars / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        len(set(lines)) / len(lines),
        float(tally[list(b"#*$%&|<>")].sum()) / n,
        float(tally[33]) / n,
        float(tally[124]) / n,
        float(tally[65:91].sum()) / letters,
        float(tally[48:58].sum()) / chars,
        float(tally[list(b".,;:")].sum()) / n,
        float(tally[128:].sum()) / chars,
    ]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Model:
    """A linear model over the bins of the features."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray):
        self.edges, self.weights = edges, weights

    def bins(self, x: np.ndarray) -> np.ndarray:
        return _bins(x, self.edges)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.bins(x) @ self.weights))


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """1 for every cut that a feature reaches, and a constant."""
    return np.concatenate([(x[:, [i]] >= e[None, :]).astype(np.float32) for i, e in enumerate(edges)] + [np.ones((len(x), 1), np.float32)], axis=1)


def cuts(x: np.ndarray) -> list[np.ndarray]:
    """Where to cut each feature, from its values."""
    out = []
    for column in x.T:
        some = column[column > 0]  # most texts have none of what the rarer features count
        out.append(np.unique(np.concatenate([np.quantile(column, QUANTILES), np.quantile(some, SOME) if len(some) else []])))
    return out


def risk(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * R_p(+) and the estimate of the risk on bad documents R_u(-) - prior * R_p(-), of scores of positives and of
    unlabelled documents under the logistic loss."""
    sp, su = np.clip(sp, 1e-12, 1 - 1e-12), np.clip(su, 1e-12, 1 - 1e-12)
    return prior * np.mean(-np.log(sp)), np.mean(-np.log1p(-su)) - prior * np.mean(-np.log1p(-sp))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, edges: list[np.ndarray]) -> float:
    """The share of good documents among unlabelled ones. Scores come from models fitted on the other half of each side."""
    sp, su = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for half in (0, 1):
        p, u = np.arange(len(positive)) % 2 == half, np.arange(len(unlabelled)) % 2 == half
        model = fit(positive[~p] if (~p).any() else positive, unlabelled[~u] if (~u).any() else unlabelled, 0.5, edges, PRIOR_STEPS)
        sp[p], su[u] = model.score(positive[p]), model.score(unlabelled[u])
    scores = np.quantile(sp, np.linspace(0, 1 - PRIOR_LEAST, 91))
    return float(min(0.99, max(0.01, min((su >= s).mean() / (sp >= s).mean() for s in scores))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, edges: list[np.ndarray], steps: int = STEPS) -> Model:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under the logistic loss."""
    p, u = _bins(positive, edges), _bins(unlabelled, edges)
    w = np.zeros(p.shape[1], np.float64)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        good = -prior * p.T @ (1 - sp) / len(p)
        _, on_bad = risk(sp, su, prior)
        bad = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        # Where the estimate of the risk on bad documents is negative, its gradient is followed backwards.
        g = good + bad if on_bad >= 0 else -bad
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(edges, w)


def corpus_cuts(table: DataFrame) -> list[np.ndarray]:
    """cuts() of all documents' features (x), to a ten-thousandth of the ranks."""
    aggs = []
    for i in range(len(FEATURES)):
        x = F.col("x")[i]
        aggs += [F.percentile_approx(x, list(QUANTILES), 10_000).alias(f"a{i}"), F.percentile_approx(F.when(x > 0, x), list(SOME), 10_000).alias(f"s{i}")]
    row = table.agg(*aggs).first()
    return [np.unique([*(row[f"a{i}"] or []), *(row[f"s{i}"] or [])]) for i in range(len(FEATURES))]


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) -> doc_id, held_out, score, predicted.

    Labels count only where crc32(doc_id as text) mod 5 is not 0, and only those of quality 1. The text alone makes the
    score. The cuts of the features are quantiles of all documents; the prior and the model come from at most `sample`
    positives and `sample` unlabelled documents; the scores cover every document. Null texts count as empty, a null doc_id is not held out, rows that repeat an id
    are scored one by one; without positives every score is 0.5. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(extract, f"doc_id {kind}, x array<double>")
    table = cut(table, "quality")
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("q")).where(F.col("q").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    by_hash = [F.xxhash64(F.lit("quality"), F.col("doc_id")), F.col("doc_id")]
    trusted = marked.where("q = 1").select("doc_id").distinct().orderBy(*by_hash).limit(sample)
    positive = table.join(F.broadcast(trusted), "doc_id", "left_semi").orderBy(*by_hash, "x").limit(2 * sample).select("x").toPandas()
    unlabelled = table.select("doc_id", "x").orderBy(*by_hash, "x").limit(sample).select("x").toPandas()
    model = None
    if len(positive) and len(unlabelled):
        p, u, edges = np.stack(positive["x"]), np.stack(unlabelled["x"]), corpus_cuts(table)
        model = fit(p, u, class_prior(p, u, edges), edges)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).flatten(), np.float64).reshape(-1, len(FEATURES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = table.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "x")
    return rows.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")
