"""Quality rules by weak supervision. DataFrame operations only.

Rules read counts of a text and vote good (1), bad (0) or abstain (-1). No rule is trusted by itself: expectation-
maximisation over all documents estimates how accurate each rule is, and the posterior probability of "good" replaces
the test that all rules must pass. Junk comes in kinds, and one kind passes the rules for the others; a model with one
class of bad documents would take agreement between two of the rules for quality. So the latent classes are "good" and
one kind of junk a rule, and quality is the probability of the first.

A document enters the estimate only through its vote pattern, so EM runs over the counted patterns: at most 3 to the
number of rules, however many documents there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACE, count_of, cut, let, words_sql

#: Iterations of EM, the weight of the prior in documents a cell, and the posterior from which a document is kept.
ITERATIONS = 25
SMOOTHING = 1.0
KEEP_FROM = 0.5
#: Up to so many repeated hashes are looked up one by one.
LOOKUP = 16
#: Where EM begins: the share of good documents, how likely a rule calls a good document bad, and how likely it does so
#: for the junk that it is for and for the other kinds.
START_GOOD = 0.8
START_BAD_VOTE = {"good": 0.001, "own": 0.9, "other": 0.1}


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, the first included.

    Most texts have no window twice: a set of hashes settles those. Else sorting finds the hashes met twice; their
    windows are looked up in that list while it is short and found by sorting the windows where it is long, so that the
    time is n log n for any text.
    """

    def covered(starts):
        # Sorted starts of repeated windows: each covers up to the next start, three words at most.
        gap = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3))))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_sorting(order):
        same = F.filter(
            order,
            lambda x, i: ((i > 0) & (order[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i + 1 < F.size(order)) & (order[F.least(i + 1, F.size(order) - 1)]["h"] == x["h"])),
        )
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    def by_hash(hashes):
        def lookup(twice):
            short = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda p: p.isNotNull())
            long = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), by_sorting)
            return let(F.when(F.size(twice) <= LOOKUP, short).otherwise(long), covered)

        met_twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(met_twice, lookup))

    def windows(w):
        hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))
        return F.when(F.size(w) < 6, _short(w)).otherwise(let(hashes, by_hash))

    return let(words, windows)


def _short(w: Column) -> Column:
    """Up to five words: at most three windows, compared one by one."""

    def same(i, j):
        a = [(w[i + k] == w[j + k]) for k in range(3)]
        return F.when(F.size(w) >= max(i, j) + 3, F.coalesce(a[0] & a[1] & a[2], F.lit(False))).otherwise(F.lit(False))

    all_ = F.when(same(0, 2), F.lit(5)).when(same(0, 1) | same(1, 2), F.lit(4))
    return F.coalesce(all_, F.lit(0)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id and the counts of the whole text that the rules read.

    A null text counts as an empty one. Rows that repeat an id stay separate rows. Columns of other names are ignored.
    """
    text = F.coalesce(F.col("_t"), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    d = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
    of_words = let(
        words_sql(F.col("_t")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")),
    )
    of_lines = let(worded, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines")))
    d = d.select("_d", of_words.alias("_w"), of_lines.alias("_l"), count_of(text, "[#*$%&|<>]").alias("n_symbols"), count_of(text, "!").alias("n_bangs"))
    return d.select(F.col("_d").alias("doc_id"), "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_bangs")


def votes() -> dict[str, Column]:
    """Each rule: 1 good, 0 bad, -1 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def rule(bad, good):
        return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(-1))

    symbols, repeats, bangs = F.col("n_symbols") / n, F.col("n_repeat_words") / n, F.col("n_bangs") / n
    mean, dup = F.col("word_chars") / n, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": rule(symbols > 0.3, symbols < 0.05),
        "repeats": rule(repeats > 0.3, repeats < 0.1),
        "bangs": rule(bangs > 0.5, bangs < 0.05),
        "mean_length": rule((mean < 2) | (mean > 9), (mean >= 3) & (mean <= 7)),
        "dup_lines": rule(dup > 0.7, (dup < 0.1) & (F.col("n_lines") >= 3)),
    }


def fit(patterns: DataFrame, names: list[str], iterations: int = ITERATIONS) -> list[tuple[float, list[tuple[float, float]]]]:
    """EM over counted vote patterns (one column a rule, and n): for each class, "good" first and then the junk that
    each rule is for, its share of the documents and how likely every rule, where it votes, says bad or good of it. An
    abstention says nothing.

    All iterations are one expression over one row that holds the patterns, at most 3 ** len(names) of them, so no
    iteration costs a job. Only the parameters come back.
    """
    cells, classes = 2 * len(names), len(names) + 1
    hits = F.filter(F.array(*[F.when(F.col(f"v_{r}") >= 0, F.col(f"v_{r}") + 2 * i) for i, r in enumerate(names)]), lambda x: x.isNotNull())
    one = patterns.agg(F.sort_array(F.collect_list(F.struct(hits.alias("hits"), F.col("n").cast("double").alias("n")))).alias("ps"))
    start = [START_GOOD] + [(1 - START_GOOD) / len(names)] * len(names)
    for k in range(classes):
        for i in range(len(names)):
            bad = START_BAD_VOTE["good" if k == 0 else "own" if k == i + 1 else "other"]
            start += [bad, 1 - bad]

    def total(rows, field):
        return F.aggregate(rows, F.lit(0.0), lambda a, x: a + field(x))

    def index(n):
        return F.sequence(F.lit(0), F.lit(n - 1))

    def step(params, _):
        def split(logs):  # each pattern's share in every class
            def shared(p):
                likely = F.transform(index(classes), lambda k: F.exp(F.aggregate(p["hits"], logs[k], lambda a, h: a + logs[k * cells + h + classes])))
                return F.struct(p["hits"].alias("hits"), p["n"].alias("n"), let(likely, lambda w: F.transform(w, lambda x: x * p["n"] / total(w, lambda y: y))).alias("in"))

            return F.transform(F.col("ps"), shared)

        def renew(rows):
            def mass(j):
                return total(rows, lambda x: F.when(F.array_contains(x["hits"], (j % cells).cast("int")), x["in"][F.floor(j / cells).cast("int")]).otherwise(F.lit(0.0)))

            def normalised(m):  # cells 2 i and 2 i + 1 are the votes of one rule on one class
                return F.transform(index(classes * cells), lambda j: (m[j] + SMOOTHING / 100) / (m[j] + m[j + 1 - (j % 2) * 2] + SMOOTHING / 50))

            shares = F.transform(index(classes), lambda k: (total(rows, lambda x: x["in"][k]) + SMOOTHING) / (total(rows, lambda x: x["n"]) + classes * SMOOTHING))
            return F.concat(shares, let(F.transform(index(classes * cells), mass), normalised))

        return let(let(F.transform(params, lambda x: F.log(x)), split), renew)

    found = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.array(*[F.lit(float(x)) for x in start]), step).alias("params")).first()["params"]
    return [(found[k], [tuple(found[classes + k * cells + 2 * i :][:2]) for i in range(len(names))]) for k in range(classes)]


def posterior(model: list[tuple[float, list[tuple[float, float]]]], names: list[str]) -> Column:
    """The probability of "good" given the votes in columns v_<rule>."""
    against = F.lit(0.0)
    for share, table in model[1:]:
        odds = F.lit(math.log(share) - math.log(model[0][0]))
        for r, ours, good in zip(names, table, model[0][1], strict=True):
            lift = [math.log(x) - math.log(y) for x, y in zip(ours, good, strict=True)]
            odds = odds + F.when(F.col(f"v_{r}") == 0, F.lit(lift[0])).when(F.col(f"v_{r}") == 1, F.lit(lift[1])).otherwise(F.lit(0.0))
        against = against + F.exp(odds)
    return F.lit(1.0) / (F.lit(1.0) + against)


def judge(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> counts, votes v_<rule>, quality (the posterior), base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows; such a document is not
    kept whatever the posterior. An empty table gives an empty result.
    """
    counted = base_counts(docs)
    rules = votes()
    counted = cut(counted.select("*", *[v.alias(f"v_{r}") for r, v in rules.items()]), "rules")
    patterns = counted.groupBy(*[f"v_{r}" for r in rules]).agg(F.count(F.lit(1)).alias("n"))
    model = fit(patterns, list(rules))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = counted.withColumn("quality", posterior(model, list(rules))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))
