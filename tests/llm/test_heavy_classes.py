"""A size class of a family of near copies is not dealt to one task before it is cut into tiles."""

from __future__ import annotations

import re

from tracewell.llm import jaccard


def test_members_are_not_dealt_by_their_class(spark, monkeypatch):
    plans, run = [], jaccard.map_batches

    def watched(df, function, schema, *more):
        if schema == "a long, b long":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return run(df, function, schema, *more)

    monkeypatch.setattr(jaccard, "HEAVY", 1)
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "map_batches", watched)
    shared = " ".join(f"shared{k}" for k in range(60))
    docs = [(d, f"{shared} " + " ".join(f"own{d}x{k}" for k in range(40))) for d in range(30)] + [(50, f"{shared} " + " ".join(f"own7x{k}" for k in range(38)) + " other words")]
    rows = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: 7 if d == 50 else d for d, _ in docs}
    assert len(plans) == 1 and not re.search(r"hashpartitioning\(family#\d+L?, key#\d+L?, size#\d+L?,", plans[0])
