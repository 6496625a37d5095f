"""The registered queries: columns, whole tables, and held-out accuracy of what is trained."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import pytest

from tracewell.llm.queries import oracle_sql, queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the driver's tables")

COLUMNS = {
    "op1_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_topk_search": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op3_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}


def test_names():
    assert set(queries()) == set(COLUMNS) and set(oracle_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    out = queries()[name](spark, SMALL)
    kinds = dict(out.dtypes)
    assert all(kinds.get(c) == k for c, k in (x.split(" ") for x in COLUMNS[name].split(", ")))
    rows = out.collect()
    if name == "op2_topk_search":
        assert Counter(r["query_id"] for r in rows) == {q: 10 for q in range(0, 500, 100)}
    else:
        key, table = ("page_id", "pages") if name.startswith("op9") else ("doc_id", "documents")
        whole = Counter(r[key] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").collect())
        got = Counter(r[key] for r in rows)
        assert got.keys() == whole.keys() and (name == "op8_packing" or got == whole)


def test_held_out_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for r in queries()["op1_quality_classifier"](spark, LARGER).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.95 * len(rows) > 0


def test_held_out_language(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = [r for r in queries()["op5_language_id"](spark, LARGER).collect() if r["held_out"] and langs[r["doc_id"]]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) >= 0.98 * len(rows) > 0
