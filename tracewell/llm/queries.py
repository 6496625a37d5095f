"""The opN_<name> queries: thin digests over the operators of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bytecnn, langid
from tracewell.llm.arrowfiles import token_files
from tracewell.llm.bpe import bpe_encode
from tracewell.llm.common import crc_mod, table
from tracewell.llm.impact import top_k
from tracewell.llm.jaccard import jaccard_components
from tracewell.llm.oracles import ORACLES
from tracewell.llm.packing import pack
from tracewell.llm.rules import quality_rules
from tracewell.llm.sharding import kd_shards
from tracewell.llm.urls import url_filter


def quality_model(spark: SparkSession, sf_dir: str) -> bytecnn.ByteCnn:
    """Learned from the labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod("doc_id", 5) != 0)
    return bytecnn.train(table(spark, sf_dir, "documents"), labels)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bytecnn.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod("doc_id", 3) != 1))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_bits")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), keep_ids=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_topk_search, op3_ngram_jaccard_join, op4_token_files, op5_language_id, op6_quality_rules, op7_bpe, op8_packing, op9_url_filter, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
