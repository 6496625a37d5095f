"""Corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bytecnn
from tracewell.llm.common import stage, table
from tracewell.llm.dedup import keep_one
from tracewell.llm.packing import pack
from tracewell.llm.queries import quality_model
from tracewell.llm.rules import quality_rules

#: Bytes of encoded words that a Python worker keeps: the executors have grown with the stages before.
WORD_CACHE = 40 << 20


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], verdict: str) -> DataFrame:
    """The rows of docs that pass the verdict, with their own columns, also those that bear a name of the operator's."""
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)])
    return judge(plain).where(verdict).select(*plain.columns).toDF(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_model(spark, sf_dir)
    return _kept(docs, lambda df: bytecnn.classify(df, model), "predicted = 1")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return _kept(docs, lambda df: quality_rules(df, keep_text=True), "kept")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles link at a Jaccard similarity of 0.8."""
    return keep_one(docs, 5, 80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of 2048 tokens at most."""
    return pack(docs, cache=WORD_CACHE)


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("packing", pack_sequences),
]

#: The classifier cannot be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
