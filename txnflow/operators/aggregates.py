"""Grouped aggregates; ``client_id`` leads every key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnflow.functions import to_number


def _keys(key: list[str]) -> list[str]:
    return ["client_id", *(k for k in key if k != "client_id")]


def aggregate(df: DataFrame, op: str, field: str | None = None, key: list[str] = (), carry: list[str] = (), tag: str | None = None) -> DataFrame:
    """``max`` (with the carried columns of its row), ``avg``, ``sum`` or ``count`` per client and key.

    Null fields count as 0 in sums and means. Rows tied for the maximum are told apart by the smallest carried
    values, so the result doesn't depend on arrival order.
    """
    g = df.groupBy(*_keys(list(key)))
    if op == "max":
        v = to_number(field)
        # Rows without a value are no candidates.
        best = F.min_by(F.struct(*carry), F.when(v.isNotNull(), F.struct((-v).alias("v"), *carry))) if carry else None
        out = g.agg(F.max(v).alias(field), *([best.alias("_row")] if carry else []))
        out = out.select(*_keys(list(key)), field, *(F.col("_row")[c].alias(c) for c in carry))
    elif op == "avg":
        out = g.agg(F.avg(F.coalesce(to_number(field), F.lit(0.0))).alias(f"avg_{field}"))
    elif op == "sum":
        out = g.agg(F.sum(F.coalesce(to_number(field), F.lit(0.0))).alias(f"sum_{field}"))
    elif op == "count":
        out = g.agg(F.count("*").alias("count"))
    else:
        raise ValueError(f"unknown aggregate {op!r}")
    return out.withColumn("source", F.lit(tag)) if tag is not None else out


def top1(df: DataFrame, key: list[str], field: str, *ties: str) -> DataFrame:
    """The row with the largest ``field`` per key as a ranking; ``aggregate(op="max")`` is the cheaper form."""
    w = Window.partitionBy(*_keys(key)).orderBy(F.desc(field), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def distinct_first(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """One value per key, the smallest, whatever the order of arrival."""
    return df.groupBy(*key).agg(F.min(value).alias(value))
