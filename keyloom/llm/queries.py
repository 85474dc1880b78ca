"""The registered queries of this subpackage, one an operator, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.lines import line_report

    return line_report(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.rules import judge

    out = judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.contamination import contained

    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.pages import main_texts

    return main_texts(read(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.simhash import near_duplicates

    out = near_duplicates(read(spark, sf_dir, "documents"), words=3, most=2, seed=42)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.quality import score

    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.toxicity import severity

    out = severity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "severity", "toxic_probability", "grade", "toxic")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyloom.llm.suffixes import repeated_bytes

    return repeated_bytes(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from keyloom.llm.tokens import token_counts

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts(read(spark, sf_dir, "documents"), path, limit=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_simhash": op5_simhash,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
}

MIXING_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0)
    / (1.0::DOUBLE / (1.0::DOUBLE + symbols::DOUBLE / greatest(size, 1))) AS key FROM counted),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
capped AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (by_ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM capped WINDOW by_ratio AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
free AS (SELECT *, (total - below) * weight <= cap * rest AS is_free FROM levels),
level AS (SELECT total - below AS left_over, rest AS left_weight, cap::DOUBLE / weight AS ratio FROM free WHERE is_free ORDER BY ratio, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN cap::DOUBLE / weight >= ratio THEN left_over::DOUBLE * weight / left_weight ELSE cap::DOUBLE END AS target FROM free, level),
plan AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs FROM targets),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM keyed)
SELECT doc_id, size, source_size, target, ((epochs + (2 * before + size <= 2 * (target - epochs * source_size))::INT) * size)::BIGINT AS taken
FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source
"""

CONTAINMENT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc_row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS item_row, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
items AS (
  SELECT item_row, item_id, k, unnest(list_distinct([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)])) AS shingle
  FROM (SELECT *, least(5, len(w)) AS k FROM b) WHERE k > 0),
sizes AS (SELECT item_row, count(*) AS n FROM items GROUP BY item_row),
texts AS (
  SELECT doc_row, doc_id, k, unnest(list_distinct([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)])) AS shingle
  FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
SELECT doc_id, item_id, n::INTEGER AS n_shingles, count(*)::INTEGER AS n_shared, count(*)::DOUBLE / n AS containment
FROM texts JOIN items USING (k, shingle) JOIN sizes USING (item_row)
GROUP BY doc_row, doc_id, item_row, item_id, n HAVING count(*) >= 0.8 * n
"""

ORACLE_SQL: dict[str, str] = {"op3_decontamination": CONTAINMENT_SQL, "op8_mixing": MIXING_SQL}
