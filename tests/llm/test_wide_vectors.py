"""Vectors with large components take part in the search, with exact scores."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from tracewell.llm import impact


def test_large_components_take_part(spark):
    r = random.Random(5)
    rows = [(k, [r.choice([-1, 1]) * r.random() * 10.0 ** r.choice([0, 0, 0, 4, 5, 9, 12]) for _ in range(4)]) for k in range(300)]
    rows += [(k, [r.uniform(-1, 1) for _ in range(4)]) for k in range(300, 600)]
    rows += [(k, [2.0**40, 1.0 + (k - 600) / 1024, 2.0**40, -(2.0**40)]) for k in range(600, 640)]  # alike but for the last bits
    scaled = [(k, [int(np.floor(1024 * x)) for x in v]) for k, v in rows]
    got = defaultdict(list)
    for x in impact.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, every=50, rows_per_block=64, queries_per_block=2).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    past = 0
    for q, v in scaled:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in scaled if i != q)[:10]
            assert sorted(got[q]) == [(n, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for n, (s, i) in enumerate(best, 1)]
            past += sum(-s >= 1 << 63 for s, _ in best)
    assert 0 < past < 130


def test_wide_top_is_exact():
    r = np.random.default_rng(6)
    vectors = r.integers(-(2**62), 2**62, (500, 6))
    vectors[100:200] = vectors[99]
    ids = r.permutation(500)
    for j, (rows, scores) in enumerate(impact.wide_top(vectors, vectors[90:110], ids, 10, [*range(90, 110)], strip=64), 90):
        want = sorted((-sum(a * b for a, b in zip(vectors[j].tolist(), w)), int(ids[i])) for i, w in enumerate(vectors.tolist()) if i != j)[:10]
        assert [(-s, int(ids[i])) for i, s in zip(rows, scores)] == want
