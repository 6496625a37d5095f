"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension until leaves are small enough.

Only DataFrame operations run on the executors. Rows are first gathered into units: rows of equal text are one unit, so
copies stay together in one shard. Only a group that is heavier than a shard's share cannot; its rows are dealt over several
units (such groups are split, never dropped). The driver holds one histogram of the current level, bounded by leaves times
bins, and the list of leaves.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import stage

BINS = 64
#: Slots are numbered within cells of about so many rows at least; there are about MOST_CELLS cells at most, whose counts are broadcast.
CELL_ROWS, MOST_CELLS = 1024, 100_000


def _dimensions(units: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    row = units.agg(*[f(F.col(n)).alias(f"{n}_{k}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return {n: (float(row[f"{n}_lo"] or 0.0), float(row[f"{n}_hi"] or 0.0)) for n in names}


def kd_leaves(units: DataFrame, names: list[str], target: float, levels: int = 24, most_leaves: int = 4096) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Give each unit (columns names, weight) a `leaf`; returns the units and the (leaf, weight) list.

    A node over the target is cut along its widest dimension, its spread taken relative to the whole table's. The cut is the
    bin edge nearest to half the node's weight; where all the weight is in one bin, the bin's bounds are the next
    level's bounds, so that the search closes in on the median level by level. A node of one point is a leaf.
    """
    units = cells = stage(units.withColumn("node", F.lit(1).cast("long")), "kd")
    spans = _dimensions(units, names)
    done: list[tuple[int, float]] = []
    total = units.agg(F.sum("weight")).first()[0]
    if total is None:
        return cells.withColumnRenamed("node", "leaf"), []
    nodes: dict[int, float] = {1: float(total)}
    bounds = {1: dict(spans)}
    following = 2
    for _ in range(levels):
        for k in [k for k, w in nodes.items() if w <= target or len(nodes) + len(done) >= most_leaves]:
            done.append((k, nodes.pop(k)))
        if not nodes:
            break
        # one pass: the histograms of every open node along its widest dimension
        wide = {k: max(names, key=lambda n, k=k: (bounds[k][n][1] - bounds[k][n][0]) / ((spans[n][1] - spans[n][0]) or 1.0)) for k in nodes}
        plan = [(k, wide[k], *bounds[k][wide[k]]) for k in nodes]
        known = units.sparkSession.createDataFrame([(k, names.index(n), lo, hi) for k, n, lo, hi in plan], "node long, dim int, lo double, hi double")
        value = F.element_at(F.array(*[F.col(n).cast("double") for n in names]), F.col("dim") + 1)
        place = F.when(F.col("hi") > F.col("lo"), F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).otherwise(0)
        binned = cells.join(F.broadcast(known), "node", "left").withColumn("bin", F.when(F.col("dim").isNotNull(), F.least(F.lit(BINS - 1), F.greatest(F.lit(0), place))).cast("int"))
        spread = [f(F.col(n)).alias(f"{n}_{k}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]
        hist: dict[int, list] = {}
        for r in binned.where("bin is not null").groupBy("node", "bin").agg(F.sum("weight").alias("w"), *spread).collect():
            hist.setdefault(r["node"], []).append(r)
        cuts = []
        for k, n, lo, hi in plan:
            rows = sorted(hist[k], key=lambda r: r["bin"])
            tight = [{d: (float(r[f"{d}_lo"]), float(r[f"{d}_hi"])) for d in names} for r in rows]
            merge = lambda part: {d: (min(t[d][0] for t in part), max(t[d][1] for t in part)) for d in names}
            if len(rows) == 1:
                narrowed = merge(tight)
                if all(a == b for a, b in narrowed.values()):
                    done.append((k, nodes.pop(k)))
                else:
                    bounds[k] = narrowed
                continue
            half, run, best = nodes[k] / 2, 0.0, None
            for i, r in enumerate(rows[:-1]):
                run += float(r["w"])
                if best is None or abs(run - half) < best[0]:
                    best = (abs(run - half), i, run)
            _, i, left = best
            a, b = following, following + 1
            following += 2
            cuts.append((k, rows[i]["bin"], a, b))
            nodes[a], nodes[b] = left, nodes.pop(k) - left
            bounds[a], bounds[b] = merge(tight[: i + 1]), merge(tight[i + 1 :])
        if cuts:
            split = units.sparkSession.createDataFrame(cuts, "node long, cut int, below long, above long")
            cells = binned.join(F.broadcast(split), "node", "left").withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).when(F.col("bin") <= F.col("cut"), F.col("below")).otherwise(F.col("above"))).drop("cut", "below", "above", "dim", "lo", "hi", "bin")
            cells = stage(cells, "kd")
    done += list(nodes.items())
    return cells.withColumnRenamed("node", "leaf"), sorted(done)


def deal(leaves: list[tuple[int, float]], shards: int) -> dict[int, int]:
    """Leaves to shards, heaviest first, each to the lightest shard so far."""
    heap = [(0.0, s) for s in range(shards)]
    out = {}
    for leaf, weight in sorted(leaves, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[leaf] = s
        heapq.heappush(heap, (load + weight, s))
    return out


def kd_shards(docs: DataFrame, shards: int = 8, leaves_per_shard: int = 16, text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null: the law is not `key`).

    size is the UTF-8 bytes of the text plus one, 1 for null. Rows of equal text are in one shard unless together they are over
    total / shards bytes. Leaves hold total / (shards * leaves_per_shard) bytes at
    most, save for single groups that are larger; they are dealt to the shards so that byte sums are near equal.
    Dimensions: doc_id, size, and hashes of language and source. Slots count the rows of a shard from 0.
    Defined results: null ids, languages and sources are points of their own; repeated rows get a row and a slot each;
    other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    flat = F.col(f"`{text}`")
    unit_hash = lambda c: (F.xxhash64(F.coalesce(c.cast("string"), F.lit("\0"))) / F.lit(2.0**63)).cast("double")
    has = lambda n: F.col(n) if n in docs.columns else F.lit(None).cast("string")
    rows = stage(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(flat), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(flat, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.xxhash64(flat), F.lit(0)).alias("text_key"),
            F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("d_id"),
            unit_hash(has("lang")).alias("d_lang"),
            unit_hash(has("source")).alias("d_source"),
        ),
        "kd-rows",
    )
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    target = total / (shards * leaves_per_shard)
    # a group heavier than a shard's share is dealt by a hash of the row: of n parts, each has rows of about target / 4 bytes
    units = rows.groupBy("text_key").agg(F.sum("size").alias("whole"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("whole") / F.lit(target / 4))).cast("int")
    heavy = stage(units.where(F.col("whole") > total / shards).select("text_key", parts.alias("parts")), "kd-heavy")
    # fewer than `shards` groups are that heavy
    rows = rows.join(F.broadcast(heavy), "text_key", "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.col("doc_id"), F.spark_partition_id(), F.monotonically_increasing_id()), F.col("parts"))).otherwise(0).cast("int"))
    rows = stage(rows.drop("parts"), "kd-parts")
    points = rows.groupBy("text_key", "part").agg(F.sum("size").alias("weight"), F.min("d_id").alias("d_id"), F.log2(F.max("size")).alias("d_size"), F.min("d_lang").alias("d_lang"), F.min("d_source").alias("d_source"), (F.xxhash64("text_key", "part") / F.lit(2.0**63)).alias("d_key"))
    cells, leaves = kd_leaves(points, ["d_id", "d_size", "d_lang", "d_source", "d_key"], target)
    dealt = spark.createDataFrame(list(deal(leaves, shards).items()), "leaf long, shard int")
    placed = rows.select("doc_id", "size", "text_crc32", "text_key", "part").join(cells.select("text_key", "part", "leaf"), ["text_key", "part"]).join(F.broadcast(dealt), "leaf")
    # slots: position within a cell of the shard, after the rows of the cells before it; a leaf has as many cells as its rows ask for
    placed = stage(placed.drop("part"), "kd-placed")
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a leaf
    cell_rows = max(CELL_ROWS, -(-sum(r["n"] for r in sizes) // MOST_CELLS))
    cells = spark.createDataFrame([(r["leaf"], -(-r["n"] // cell_rows)) for r in sizes], "leaf long, cells long")
    # equal rows are told apart by their place, so that many of them are dealt over cells too
    cell = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text_key"), F.monotonically_increasing_id()), F.col("cells"))
    placed = stage(placed.join(F.broadcast(cells), "leaf").withColumn("cell", cell).drop("cells"), "kd-cells")
    counts = placed.groupBy("shard", "leaf", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("leaf", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "leaf", "cell").orderBy("doc_id", "text_key")))
    out = inside.join(F.broadcast(before), ["shard", "leaf", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
