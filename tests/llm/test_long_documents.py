"""A clean document stays, however long it is."""

from __future__ import annotations

import corpus_pipeline
from tracewell.llm import rules


def test_very_long_clean_document_stays(spark):
    text = "\n".join(" ".join(f"word{k}" for k in range(a, a + 1000)) for a in range(0, 1_001_000, 1000))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "too short", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    assert rows[1]["n_words"] == 1_001_000 and rows[1]["rule_bits"] == rules.bit("many_words") and rows[1]["kept"] and not rows[2]["kept"]
    assert [r["doc_id"] for r in corpus_pipeline.apply_rules(spark, docs, "").collect()] == [1]
