"""The stored table of payments, partitioned by client and day."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnflow.functions import to_day
from txnflow.operators.predicates import DAY_OF
from txnflow.sources.files import read_clients, write_clients

#: Column with the day of ``ts``; null where it can't be parsed.
DAY = "ts_day"


def ingest(txns: DataFrame, path: str, clients: Iterable[str] = ()) -> None:
    """Store payments by client and day. A day of a client that comes again replaces itself; nothing old of ``clients`` stays.

    Timestamps are parsed here once: ``ts`` remembers the name of its day's column, and date conditions of ``where_op``
    become conditions on partitions. Rows are dealt out by partition, large ones in several files.
    """
    kept = txns.select("*", to_day("ts").alias(DAY)).withMetadata("ts", {DAY_OF: DAY})
    write_clients(kept.hint("rebalance", "client_id", DAY), path, clients, by=(DAY,))


def stored_payments(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``ingest`` wrote."""
    return read_clients(spark, path).withColumn(DAY, F.col(DAY).cast("date"))
