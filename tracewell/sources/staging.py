"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


#: Staged tables that are made once and read by many queries, by application and source.
memo: dict[tuple[str, str], DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local folder if all runs on this machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tracewell-shared")
        warnings.warn(f"spark.checkpoint.dir is unset: intermediate tables are written to {found}", stacklevel=2)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tracewell/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. DataFrames that read them cannot be run any more."""
    memo.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there."""
    path = f"{application_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
