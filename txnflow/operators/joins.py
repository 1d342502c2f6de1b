"""Reference-table joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.functions import normalize_bank_id
from txnflow.operators.aggregates import distinct_first


def bank_names(accounts: DataFrame) -> DataFrame:
    """One name per client and normalised bank id."""
    return distinct_first(accounts.select("client_id", normalize_bank_id("bank_id").alias("bank_id"), "bank_name"), ["client_id", "bank_id"], "bank_name")


def add_bank_name(df: DataFrame, accounts: DataFrame, bank: str = "from_bank", how: str = "left") -> DataFrame:
    """Normalise ``bank`` and add ``bank_name``; an unmatched bank keeps its id as its name, or drops out with ``how="inner"``.

    No broadcast is forced: the names are aggregated first, so adaptive execution knows their size when it picks the join.
    """
    names = bank_names(accounts).withColumnRenamed("bank_id", bank)
    out = df.withColumn(bank, normalize_bank_id(bank)).join(names, ["client_id", bank], how)
    return out.withColumn("bank_name", F.coalesce("bank_name", bank))


def below_group_baseline(df: DataFrame, baseline: DataFrame, key: list[str], value: str, mean: str, coef: float) -> DataFrame:
    """Rows whose value is strictly below ``coef`` times the mean of their group; groups without a mean drop out."""
    return df.join(baseline, key).where(F.col(value) < F.col(mean) * coef).drop(mean)
