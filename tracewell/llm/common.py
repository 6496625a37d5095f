"""Shared staging tables, bounded sampling and text-batch helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.sources.staging import application_dir, stage

__all__ = ["bounded_rows", "crc_mod", "give_back", "hashed_below", "in_id_order", "map_batches", "new_path", "resident", "running_base", "stage", "table", "text_slices", "unused", "utf8_parts"]

_resident: dict = {}


def resident(key, make=lambda: None):
    """What an operator keeps in a Python worker over its tasks: made once, and dropped when another operator's is asked for.

    Spark uses a worker for the tasks of many operators; their caches must not add up."""
    if key not in _resident:
        _resident.clear()
        give_back()
        _resident[key] = make()
    return _resident[key]


def give_back() -> None:
    """Return what this process has freed to the system: what an operator leaves behind must not add to what the next one takes."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, function, schema: str, most: str = "4m") -> DataFrame:
    """mapInArrow over record batches of about `most` bytes: by rows alone, long texts would make a batch of any size.

    The bound is a setting of the session and stays set."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    return df.mapInArrow(function, schema)


def unused(columns: Iterable[str], name: str) -> str:
    """name, with underscores before it until none of the columns bears it; case does not tell columns apart."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = "_" + name
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, k: int):
    """crc32 of the column's decimal text, modulo k; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about max_bytes of text at most (one text may be longer)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(lengths) // max_bytes).astype(np.int64)
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column one after another (null: empty), and the n + 1 offsets into them."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_id_order(docs: DataFrame, bytes_per_part: int = 64 << 20) -> DataFrame:
    """(doc_id, __text) range-partitioned and sorted by doc_id, then by text; nulls first. Null texts become empty ones.

    The number of parts follows the size of the input that Spark estimates, the session's shuffle partitions at least.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # beyond: Spark has no estimate
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(known // bytes_per_part, 1 << 20))
    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    return source.repartitionByRange(parts, "doc_id", F.xxhash64("__text")).sortWithinPartitions("doc_id", F.xxhash64("__text"))


def running_base(parts: DataFrame, key: str, count: str) -> DataFrame:
    """parts (one row per task) with `base`: the sum of `count` over the parts before it."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum(count).over(before), F.lit(0)).cast("long"))


def hashed_below(column: str, share: float, seed: int):
    """True for about this share of the column's values, the same ones each time."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))


def bounded_rows(rows: DataFrame, max_rows: int, max_bytes: int, key: str = "doc_id", text: str = "text", seed: int = 1, each: str | None = None, values: tuple = (None,)) -> list:
    """Rows to train on, at the driver: in the order of a hash of their key, max_rows at most, each that still fits into max_bytes of
    text; a row that does not is passed over.

    Of each of the `values` of column `each` (of all rows, where there is no such column) one whole row is among them, even beyond
    the bounds: the first that fits into max_bytes by itself, else the shortest."""
    value = F.lit(None).cast("int") if each is None else F.col(each)
    size = F.coalesce(F.octet_length(text), F.lit(0))
    # rows are ranked and chosen by what is narrow; texts are read for the chosen ones alone
    facts = rows.select(F.xxhash64(F.lit(seed), F.col(key)).alias("order"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark"), size.alias("size"), value.alias("each"))
    order, fits = ["order", "key", "mark"], F.col("size") <= max_bytes
    ranked = facts.where(fits).orderBy(*order).limit(max_rows).collect()
    chosen: dict[int, int] = {}
    found = set()
    for at, r in enumerate(ranked):
        if r["each"] in values and r["each"] not in found:
            found.add(r["each"])
            chosen[at] = r["size"]
    used = sum(chosen.values())
    for at, r in enumerate(ranked):
        if at not in chosen and used + r["size"] <= max_bytes:
            chosen[at] = r["size"]
            used += r["size"]
    wanted = [ranked[at] for at in sorted(chosen)]
    for one in values:
        if one not in found:
            wanted += facts.where(F.col("each").eqNullSafe(F.lit(one))).orderBy(~fits, F.when(~fits, F.col("size")), *order).limit(1).collect()
    if not wanted:
        return []
    spark = rows.sparkSession
    o, m = unused(rows.columns, "__order"), unused(rows.columns, "__mark")
    # as many rows as are wanted at most, of 16 bytes
    list_ = F.broadcast(spark.createDataFrame(sorted({(r["order"], r["mark"]) for r in wanted}), f"`{o}` long, `{m}` long"))
    marked = rows.withColumn(o, F.xxhash64(F.lit(seed), F.col(key))).withColumn(m, F.xxhash64(F.col(text)))
    # equal rows are read once, so that what comes to the driver is what was chosen
    one_each = marked.join(list_, [o, m]).groupBy(o, m, key, *([] if each is None else [each])).agg(F.first(text).alias(text)).collect()
    texts = {(r[o], r[key], r[m], None if each is None else r[each]): r for r in one_each}
    return [texts[(r["order"], r["key"], r["mark"], r["each"])] for r in wanted]
