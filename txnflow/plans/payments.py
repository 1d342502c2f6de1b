"""The five ready-made payment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnflow.operators.aggregates import aggregate
from txnflow.operators.fx import convert_currency
from txnflow.operators.graph import scatter_gather
from txnflow.operators.joins import add_bank_name, below_group_baseline
from txnflow.operators.predicates import where_op
from txnflow.operators.quality import tag_client
from txnflow.functions import normalize_bank_id
from txnflow.schema import BASE_PERIOD, BASELINE_COEF, MIN_PATHS, PROBE_PERIOD
from txnflow.sources.files import client_names
from txnflow.sources.readers import fx_rates, read_accounts, read_btc_rates, read_client_accounts, read_client_transactions, read_fiat_rates, read_transactions
from txnflow.sources.sinks import result_columns, write_results


def usd(txns: DataFrame) -> DataFrame:
    return where_op(txns, "currency", "eq", "US Dollar")


def small_payments(txns: DataFrame, limit: float = 50) -> DataFrame:
    return result_columns(where_op(usd(txns), "amount", "lt", limit), "q1")


def bank_max(txns: DataFrame, accounts: DataFrame, how: str = "left") -> DataFrame:
    """The largest dollar payment of each sending bank; the key is normalised before grouping."""
    best = aggregate(usd(txns).withColumn("from_bank", normalize_bank_id("from_bank")), "max", "amount", ["from_bank"], ["from_account"])
    return result_columns(add_bank_name(best, accounts, how=how), "q2")


def far_below_baseline(txns: DataFrame, base=BASE_PERIOD, probe=PROBE_PERIOD, coef: float = BASELINE_COEF) -> DataFrame:
    dollars = usd(txns)
    mean = aggregate(where_op(dollars, "ts", "in", base), "avg", "amount", ["payment_format"])
    return result_columns(below_group_baseline(where_op(dollars, "ts", "in", probe), mean, ["client_id", "payment_format"], "amount", "avg_amount", coef), "q3")


def scatter_gather_accounts(txns: DataFrame, period=BASE_PERIOD, k: int = MIN_PATHS, multiplicity: str = "set") -> DataFrame:
    found = scatter_gather(where_op(usd(txns), "ts", "in", period), k, multiplicity)
    return result_columns(found, "q4").orderBy("client_id", "bank", "account")


def micro_count(txns: DataFrame, rates: DataFrame, period=BASE_PERIOD, formats=("Wire", "ACH"), limit: float = 1) -> DataFrame:
    """Cheap filters run before the conversion; clients without a qualifying payment have no row."""
    chosen = where_op(where_op(txns, "ts", "in", period), "payment_format", "in", list(formats))
    return result_columns(aggregate(where_op(convert_currency(chosen, rates), "amount", "lt", limit), "count"), "q5")


def run_all(txns: DataFrame, accounts: DataFrame, rates: DataFrame) -> dict[str, DataFrame]:
    """All five results by name. Persist ``txns`` before and release it after the results are written."""
    return {"q1": small_payments(txns), "q2": bank_max(txns, accounts), "q3": far_below_baseline(txns), "q4": scatter_gather_accounts(txns), "q5": micro_count(txns, rates)}


def _run(txns: DataFrame, accounts: DataFrame, rates: DataFrame, out: str, clients: list[str]) -> None:
    txns = txns.persist()
    try:
        for name, result in run_all(txns, accounts, rates).items():
            write_results(result, out, name, clients)
    finally:
        txns.unpersist()


def run_files(spark: SparkSession, transactions: str, accounts: str, btc: str, out: str, fiat: str | None = None, client: str = "0") -> None:
    """From the source files of one client to the five result folders under ``out``; other clients' results stay."""
    rates = fx_rates(read_btc_rates(spark, btc), read_fiat_rates(spark, fiat) if fiat else None)
    _run(tag_client(read_transactions(spark, transactions), client), tag_client(read_accounts(spark, accounts), client), rates, out, [client])


def run_client_files(spark: SparkSession, transactions: str, accounts: str, btc: str, out: str, fiat: str | None = None) -> None:
    """The same for all clients at once, whose files lie in folders ``client_id=...`` under both paths."""
    rates = fx_rates(read_btc_rates(spark, btc), read_fiat_rates(spark, fiat) if fiat else None)
    txns = read_client_transactions(spark, transactions)
    _run(txns, read_client_accounts(spark, accounts), rates, out, client_names(spark, transactions))
