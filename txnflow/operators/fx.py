"""Currency conversion over a rate table ``(day, origin, target, rate, op)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.functions import currency_code, day_key


def _requests(df: DataFrame, target: str) -> DataFrame:
    return df.withColumns({"_day": day_key("ts").try_cast("date"), "_origin": currency_code("currency")})


def convert_currency(df: DataFrame, rates: DataFrame, target: str = "USD") -> DataFrame:
    """``amount`` in ``target``; ``op`` of a rate says whether it multiplies or divides. Rows without a rate drop out.

    Of several rates for a day and currency the smallest counts, those that divide before those that multiply, so a
    payment is never doubled.
    """
    first = F.min(F.struct("op", "rate")).alias("_r")
    r = rates.where((F.col("target") == target) & F.col("rate").isNotNull()).groupBy(F.col("day").alias("_day"), F.col("origin").alias("_origin")).agg(first).select("_day", "_origin", "_r.rate", "_r.op")
    out = _requests(df, target).join(r, ["_day", "_origin"], "left")
    amount = F.when(F.col("_origin") == target, F.col("amount")).when(F.col("op") == "div", F.try_divide("amount", "rate")).when(F.col("op") == "mul", F.col("amount") * F.col("rate"))
    return out.withColumns({"amount": amount, "currency": F.lit(target)}).where(F.col("amount").isNotNull()).drop("_day", "_origin", "rate", "op")


def missing_rates(df: DataFrame, rates: DataFrame, target: str = "USD") -> DataFrame:
    """Each ``(day, origin, target)`` that a conversion would need and the table lacks, once."""
    need = _requests(df, target).where((F.col("_origin") != target) & F.col("_day").isNotNull())
    need = need.select(F.col("_day").alias("day"), F.col("_origin").alias("origin"), F.lit(target).alias("target")).distinct()
    return need.join(rates, ["day", "origin", "target"], "left_anti")
