"""Keeping one document of each group of near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import stage, unused
from tracewell.llm.jaccard import jaccard_components


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their group of linked documents: the one of the least doc_id.

    Every row is a document of its own, also where rows share a doc_id or have none: these take part under numbers beyond
    the ids, so a row with an id of its own stays before them. Defined results: rows without a shingle link with nothing and stay;
    of equal rows with a shingle one stays; all columns are kept, whatever their names and types.
    """
    node, lost = unused(docs.columns, "__node"), unused(docs.columns, "__lost")
    rows = docs.withColumn(node, F.col("doc_id").cast("long"))
    shared = stage(rows.groupBy(node).agg(F.count(F.lit(1)).alias(lost)).where((F.col(lost) > 1) | F.col(node).isNull()).drop(lost), "shared-ids")
    if not shared.isEmpty():
        low, high = rows.agg(F.min(node), F.max(node)).first()
        same = rows[node].eqNullSafe(shared[node])
        room = 1 << 62  # numbers that monotonically_increasing_id may take
        if (high or 0) < room:
            first, step = max(high or 0, 0) + 1, 1
        elif low > -room:
            first, step = min(low, 0) - 1, -1
        else:
            first = None
        numbered = lambda df: stage(df.withColumn(node, F.monotonically_increasing_id() * F.lit(step) + F.lit(first)), "numbered-rows")
        if first is None:
            rows, first, step = docs, 0, 1
            rows = numbered(rows)
        else:
            rows = rows.join(shared, same, "left_anti").unionByName(numbered(rows.join(shared, same, "left_semi")))
    groups = jaccard_components(rows.select(F.col(node).alias("doc_id"), "text"), k, percent)
    losers = stage(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(lost)), "losers")
    return rows.join(losers, F.col(f"`{node}`") == F.col(f"`{lost}`"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
