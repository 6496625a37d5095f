"""Provenance tokens for base tables: a short prefix and a number per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.schemas import PREFIXES
from tracewell.sources.staging import stage


def key_token(prefix: str, key: Column) -> Column:
    """prefix and key + 1: tables with a dense key from 0 need no numbering and no shuffle."""
    return F.concat(F.lit(prefix), (key + 1).cast("string"))


def number_rows(df: DataFrame, order: list[str], name: str = "__number") -> DataFrame:
    """df with the position (from 1) of each row in the ascending order of the columns, nulls last, without a single-task sort.

    Rows are range-partitioned and sorted; a row's number is its place in its part after the sizes of the parts before, of which
    there are as many as tasks. Equal rows get different numbers in no particular order.
    """
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order]
    ordered = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    held = stage(ordered.withColumn("__place", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__place", 33))
    sizes = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    base = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    place = F.col("__base") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(F.broadcast(base), "__part").withColumn(name, place).drop("__part", "__place", "__base")


def annotate(df: DataFrame, relation: str, order: list[str] | None = None) -> DataFrame:
    """df with `prov`, numbered in the order of the given columns (all of them by default)."""
    numbered = number_rows(df, order or df.columns)
    return numbered.withColumn("prov", F.concat(F.lit(PREFIXES[relation]), F.col("__number").cast("string"))).drop("__number")


def write_annotated(tables: dict[str, DataFrame], folder: str) -> None:
    """Write each relation, annotated, as Parquet under folder."""
    for relation, df in tables.items():
        annotate(df, relation).write.mode("overwrite").parquet(f"{folder}/{relation}.parquet")
