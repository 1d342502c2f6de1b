"""Folders that the driver and every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from txnflow.sources.files import delete_at_end


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder, emptied when the driver ends; a local temporary folder only for a local master without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return delete_at_end(spark, f"{shared or tempfile.mkdtemp(prefix='txnflow-')}/{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read again whatever executor is lost, gone when the driver ends."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
