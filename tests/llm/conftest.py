import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, score double, toxic boolean, kept boolean, fp long, _h string, class string"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and columns whose names the
    operators use themselves."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("stra", "kel", "mon", "tu") for b in ("ta", "rim", "óx", "ple", "s", "din", "vor")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    texts = [None, "", " \n\t ", "word", "two words", base, base, base.replace("kels", "kelsy", 1), prose(20_000), "the " * 300, "!! " * 80, "a\n" * 60, prose(60) + "\n" + prose(60), "\x00 \x1f ​ 😀 ﬁ ẞ", "x" * 5000]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i, 0.5, 0.1, True, True, 3, "h", "c") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 11), (5, "other text of the same id", "en", "s0", 1, 1, 1.0, 1.0, True, True, 1, "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 3), int(i % 5 == 0)) for i in range(16)] + [(None, 1, 0), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "kel tu"), (2, None), (3, ""), (None, "word"), (1, "kel tu")], "item_id long, text string")
