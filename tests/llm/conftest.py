from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, `rule_bits` string, rank int, shard string, part int, host string, url string"


def docs_of(spark, rows):
    """documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, lang, src, None if t is None else len(t), 0.5, -1, "x", 9, "s", 3, "h", "u") for d, t, lang, src in rows], SCHEMA)


LONG = " ".join(f"word{k % 977} and{k % 89}" for k in range(30_000))
ODD = [
    (0, "The quick brown fox jumps over the lazy dog and runs far away. " * 4, "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \n\t ", "fr", None),
    (4, LONG, "en", "b"),
    (5, "The quick brown fox jumps over the lazy dog and runs far away. " * 4, "en", "a"),
    (6, "x" * 200_000, "de", "b"),
    (6, "x" * 200_000, "de", "b"),
    (None, "a row without an id that has some words in it", "en", "b"),
    (7, "### $$$ %%% | | | &&& <> 12345 67890", None, "c"),
    (8, "één ‑ 日本語 text\u00a0with\u2003spaces\x1cand İ Σ <|endoftext|> 😀 e\u0301", "fr", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return docs_of(spark, []).limit(0)
