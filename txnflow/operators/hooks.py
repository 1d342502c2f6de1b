"""Extension points shown on payments: row to rows, per-client finaliser, two inputs together.

Each groups by bounded keys after a pre-aggregation, so no client's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.functions import to_day


def flat_map_legs(txns: DataFrame) -> DataFrame:
    """Each payment as a debit and a credit row."""

    def legs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"client_id": p.client_id, "account": p.from_account, "leg": "debit", "cents": -p.cents})
            yield pd.DataFrame({"client_id": p.client_id, "account": p.to_account, "leg": "credit", "cents": p.cents})

    return txns.select("client_id", "from_account", "to_account", F.round(F.col("amount") * 100).cast("long").alias("cents")).mapInPandas(legs, "client_id string, account string, leg string, cents long")


def daily(txns: DataFrame) -> DataFrame:
    return txns.groupBy("client_id", to_day("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"))


def busiest_day(txns: DataFrame) -> DataFrame:
    """A finaliser over each client's daily state: its busiest day (the earliest of several)."""

    def last(p: pd.DataFrame) -> pd.DataFrame:
        return p.sort_values(["n", "day"], ascending=[False, True]).head(1)[["client_id", "day", "n"]]

    return daily(txns).groupBy("client_id").applyInPandas(last, "client_id string, day date, n long")


def sent_and_received(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Two daily inputs of a client met side by side: cents on each side per client."""

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        client = (a if len(a) else b).client_id.iloc[0]
        return pd.DataFrame({"client_id": [client], "sent": [int(a.cents.sum())], "received": [int(b.cents.sum())]})

    a, b = (daily(x).toDF("client_id", "day", "n", "cents") for x in (sent, received))
    return a.groupBy("client_id").cogroup(b.groupBy("client_id")).applyInPandas(both, "client_id string, sent long, received long")
