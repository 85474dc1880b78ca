"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from keyloom.llm import common, contamination, lines, mixing, pages, quality, rules, simhash, suffixes, tokens, toxicity

TOKENIZER = "word_bpe_49k.json"


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


OPERATORS = {
    "lines": lambda d, labels, bench: lines.line_report(d),
    "rules": lambda d, labels, bench: rules.judge(d),
    "contained": lambda d, labels, bench: contamination.contained(d, bench),
    "simhash": lambda d, labels, bench: simhash.near_duplicates(d),
    "quality": lambda d, labels, bench: quality.score(d, labels),
    "toxicity": lambda d, labels, bench: toxicity.severity(d, labels),
    "mix": lambda d, labels, bench: mixing.mix(d),
    "suffixes": lambda d, labels, bench: suffixes.repeated_bytes(d),
    "tokens": lambda d, labels, bench: tokens.token_counts(d, tokenizer()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_document(messy, labels, benchmark, name):
    rows = OPERATORS[name](messy, labels, benchmark).collect()
    if name != "contained":
        assert len(rows) == messy.count()
    assert OPERATORS[name](messy.limit(0), labels, benchmark).collect() == []
    empty = OPERATORS[name](messy, labels.limit(0), benchmark.limit(0)).collect()
    assert len(empty) == (0 if name == "contained" else len(rows))


STAGES = ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]


@pytest.mark.parametrize("at", range(5))
def test_stages(spark, messy, labels, benchmark, tmp_path, at):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[at]
    assert name == STAGES[at]
    out = stage(spark, messy, str(tmp_path))
    kept = out.collect()
    assert 0 < len(kept) <= messy.count()
    if at < 4:
        assert out.columns == messy.columns and out.schema.simpleString() == messy.schema.simpleString()
    else:
        assert set(messy.columns) <= set(out.columns) and all(1 <= r["copies"] <= 3 * 3 for r in kept)
    assert stage(spark, messy.limit(0), str(tmp_path)).collect() == []


def test_simhash_values(messy):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(messy.where("doc_id not in (5)")).collect()}
    assert rows[0]["fp"] == rows[1]["fp"] == rows[2]["fp"] == 0 and rows[2]["component_id"] == 0


def test_rules_values(messy):
    rows = {r["doc_id"]: r for r in rules.judge(messy).collect() if r["doc_id"] not in (None, 5)}
    assert (rows[0]["n_words"], rows[0]["word_chars"], rows[0]["base_failed"], rows[0]["kept"]) == (0, 0, True, False)
    assert rows[9]["n_repeat_words"] == 300 and rows[11]["n_dup_lines"] == 59 and rows[8]["n_words"] == 20_000


def test_near_copies_leave_one(messy):
    kept = simhash.drop_copies(messy).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(5) == 2 and 6 not in ids and 7 not in ids  # the other text of id 5 stays, copies and repeats go
    assert sum(r["text"] is None for r in kept) == 1


def test_pages_edges(spark):
    rows = [(1, "http://h/a", None), (2, None, ""), (None, "x", "<p>plain"), (3, "http://h/b", "<article>" + "<p>word " * 5000), (3, "http://h/b", "<article><p>again")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars", "'y' as host", "0 as part")
    got = sorted(((r["page_id"] or 0, r["text"][:9], r["n_chars"]) for r in pages.main_texts(df).collect()))
    assert got == [(0, "plain", 5), (1, "", 0), (2, "", 0), (3, "again", 5), (3, "word\nword", 24_999)]
    assert pages.main_texts(df.limit(0)).collect() == []


def test_cut_survives_and_is_shared(spark, messy):
    out = common.cut(messy, "test")
    assert out.count() == messy.count() and out.schema == messy.schema
    assert "LogicalRDD" not in out._jdf.queryExecution().logical().toString()
