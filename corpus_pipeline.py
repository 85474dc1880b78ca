"""From documents to a training mix: drop toxic documents, repeated lines, near copies and contaminated documents, then
mix the sources to their target weights. Every stage reads what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import common, contamination, lines, mixing, simhash
from keyloom.llm import toxicity as toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are probably of a grade above 0."""
    from pyspark.sql import functions as F

    scored = toxic.severity(docs, common.read(spark, sf_dir, "labels"))
    return scored.where(~F.col("toxic")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier one, give or take two edits."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles agree to 0.8 or more."""
    return simhash.drop_copies(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold 0.8 or more of the 5-word shingles of a benchmark item."""
    return contamination.decontaminate(docs, common.read(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mix, and how often each is taken."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: A fitted classifier, fingerprints and hash-seeded shingles are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/keyloom-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
