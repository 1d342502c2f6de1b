"""Result layouts and writers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from txnflow.sources.files import write_clients

# The published column order of each result.
LAYOUTS = {
    "q1": ["from_bank", "from_account", "to_bank", "to_account", "amount"],
    "q2": ["from_bank", "from_account", "bank_name", "amount"],
    "q3": ["from_bank", "from_account", "payment_format", "amount"],
    "q4": ["bank", "account"],
    "q5": ["count"],
}


def result_columns(df: DataFrame, query: str) -> DataFrame:
    return df.select("client_id", *LAYOUTS[query])


def write_results(df: DataFrame, path: str, query: str, clients: Iterable[str] = ()) -> None:
    """Headerless CSV, a folder per client; earlier results of the clients with rows, and of ``clients``, are replaced.

    Results of other clients stay. One of ``clients`` without a row has no folder afterwards.
    """
    write_clients(result_columns(df, query), f"{path}/results_{query}", clients, "csv", header=False)


def fan_out(df: DataFrame, consumers: dict[str, Callable[[DataFrame], DataFrame]], out: str | None = None) -> dict[str, DataFrame]:
    """Several consumers of one input, which is computed once.

    With ``out`` each consumer's rows are written to a folder of its name there, the input is released, and the frames
    returned read the folders. Without, the input is kept after its first use; unpersist it through ``df.unpersist()``.
    """
    shared = df.persist()
    if out is None:
        return {name: f(shared) for name, f in consumers.items()}
    try:
        for name, f in consumers.items():
            f(shared).write.mode("overwrite").parquet(f"{out}/{name}")
    finally:
        shared.unpersist()
    return {name: df.sparkSession.read.parquet(f"{out}/{name}") for name in consumers}
