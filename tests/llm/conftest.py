import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, row int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with names the operators use."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    long_ = text(30_000)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "one", "en", "b"), (5, long_, "fr", "b"), (6, text(50), None, "a"), (7, "日本語 текст ελ 🙂", "de", "c"), (8, "x" * 100_000, "en", "a")]
    rows += [(10 + i, "same text for all of these rows, twelve words long in fact yes", "en", "a") for i in range(6)]
    rows += [(20, "repeated row of text with some more words in it today ok", "en", "a")] * 3 + [(None, "no id at all but a text", None, None)]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "s", "k", 9) for i, t, l, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
