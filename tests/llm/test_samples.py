"""Bounded samples: a text that does not fit is passed over, and no language or label is lost to the bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm import bytecnn, langid
from tracewell.llm.common import bounded_rows


def in_order(spark, n, seed):
    return [r["id"] for r in spark.range(n).orderBy(F.xxhash64(F.lit(seed), F.col("id"))).collect()]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, k % 2) for k, t in texts.items()], "doc_id long, text string, label int")


def test_long_texts_are_passed_over(spark):
    first, second, third, *rest = in_order(spark, 10, 1)
    df = frame(spark, {first: "x" * 1001, second: "x" * 900, third: "x" * 200} | {k: "x" * 10 for k in rest})
    assert [r["doc_id"] for r in bounded_rows(df, 100, 1000)] == [second, *rest]
    assert [r["doc_id"] for r in bounded_rows(df, 3, 1000)] == [second, rest[0]]
    assert [r["doc_id"] for r in bounded_rows(df, 100, 5)] == [rest[0]]
    assert bounded_rows(df.limit(0), 100, 5) == []


def test_each_label_is_there(spark):
    df = spark.createDataFrame([(k, "good", 1) for k in range(50)] + [(50, "y" * 2000, 0), (51, "y" * 1500, 0)], "doc_id long, text string, label int")
    rows = bounded_rows(df, 20, 1000, each="label", values=(0, 1))
    assert sorted((r["label"], r["doc_id"]) for r in rows if not r["label"]) == [(0, 51)] and len(rows) == 21
    labels = df.select("doc_id", F.col("label").alias("quality"))
    assert bytecnn.train(df.select("doc_id", "text"), labels, max_rows=20, max_bytes=1000).constant is None


def test_long_document_keeps_its_language(spark):
    order = in_order(spark, 8, 2)
    rows = [(k, "abc bca cab " * (500 if k == order[0] else 5), "aa") for k in range(8)] + [(100, "klm mlk lkm " * 500, "kk"), (101, "12345", "kk")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_bytes=1000)
    assert model.languages == ["aa", "kk"]
