"""The pipeline's stages against a brute-force version over the same documents."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_documents import brute_links, brute_measures, words_of
from tracewell.llm.queries import quality_model
from tracewell.llm.tokens import public_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(31), tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    bases = [words_of(r, 120) for _ in range(6)]
    for k in range(260):
        kind = k % 5
        if kind == 0:
            text, y = " ".join([r.choice(["spam", "win"])] * 90), 0
        elif kind == 1:
            text, y = " ".join(w + "$$$" for w in words_of(r, 90)), 0
        elif kind == 2:
            base = list(r.choice(bases))
            base[r.randrange(120)] = "edit" + str(r.randrange(3))
            text, y = " ".join(base), 1
        else:
            text, y = " ".join(words_of(r, r.choice([20, 100, 700]))), 1
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, y, 0))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (None, rows[3][1], "en", "s", 1), rows[8], (8, rows[13][1], "en", "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    model = quality_model(spark, path)
    data = [(t or "").encode() for _, t, *_ in rows]
    scores = model.score(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = [x for x, s in zip(rows, scores) if s >= 0.3]
    assert 0 < len(want) < len(rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    key = lambda x: tuple((v is not None, v or 0) if i != 1 else (v is not None, v or "") for i, v in enumerate(x) if i != 2 and i != 3)
    got = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, path)
        assert out.columns == columns
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        got.append(sorted((tuple(x) for x in docs.collect()), key=key))
    assert got[0] == sorted(want, key=key)

    def passes(text):
        n, chars, symbols, repeated_lines, repeated, lines = brute_measures(text)
        return 50 <= n <= 1_000_000 and 100 * repeated <= 50 * n and 2 * n <= chars <= 15 * n and 10 * symbols <= n and 100 * repeated_lines <= 50 * lines

    want = [x for x in want if passes(x[1])]
    assert got[1] == sorted(want, key=key) and len(want) < len(got[0])
    # every row is a document of its own: rows that share an id, or have none, stand behind those that have one
    alone = Counter(x[0] for x in want)
    nodes = {(x[0] if x[0] is not None and alone[x[0]] == 1 else 10_000 + k): x for k, x in enumerate(want)}
    links = {n: c for n, (_, c) in brute_links([(n, x[1]) for n, x in nodes.items()], 5, 80).items()}
    stay = [x for n, x in nodes.items() if links[n] == n]
    assert len(got[2]) == len(stay)
    assert sorted(x[0] for x in got[2] if alone[x[0]] == 1 and x[0] is not None) == sorted(n for n in set(links.values()) if n < 10_000)

    pieces = defaultdict(list)
    for x in corpus_pipeline.STAGES[3][1](spark, docs, path).collect():
        pieces[x["doc_id"]].append(x)
    tok = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    twice = {d for d, n in Counter(x[0] for x in got[2]).items() if n > 1}
    for d in twice:
        pieces.pop(d)
    for d, text, *_ in [x for x in got[2] if x[0] not in twice]:
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for x in sorted(pieces.pop(d), key=lambda x: x["start"]):
            assert x["start"] == at and x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids)
    assert not pieces


def test_run_equals_its_stages(spark, folder):
    path, _ = folder
    whole = corpus_pipeline.run(spark, path)
    docs = spark.read.parquet(f"{path}/n-gram Jaccard join")
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, corpus_pipeline.STAGES[3][1](spark, docs, path).collect()), key=repr)


def test_own_columns_stay(spark, folder):
    """Columns that bear the operators' names keep their own values."""
    path, rows = folder
    docs = spark.createDataFrame([(k, rows[8][1] if k else None, 7, 0.25, -1, -2, {"a": 1}) for k in range(2)], "doc_id long, text string, predicted int, score double, n_words int, kept int, __text map<string,int>")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        assert {(r["predicted"], r["score"], r["n_words"], r["kept"], r["__text"]["a"]) for r in out.collect()} <= {(7, 0.25, -1, -2, 1)}


def test_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
