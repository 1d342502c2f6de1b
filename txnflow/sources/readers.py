"""Batch and streaming readers of the delimited source files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnflow.functions import disambiguate_headers, normalize_bank_id, to_number
from txnflow.operators.predicates import drop_malformed
from txnflow.schema import TXN_COLUMNS, TXN_HEADERS
from txnflow.sources.files import subfolders

# A comma outside quotes, for counting the cells of a malformed line.
_CELL = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _header(spark: SparkSession, path: str | list[str]) -> list[str]:
    first = spark.read.option("header", False).csv(path).first()
    return disambiguate_headers([str(c).strip() for c in first]) if first else []


def _whole_rows(df: DataFrame, n: int) -> DataFrame:
    """Drop lines with too few cells; longer ones stay and their extra cells are ignored."""
    bad = F.col("_corrupt_record")
    return df.where(bad.isNull() | (F.size(F.split(bad, _CELL)) >= n))


def _schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupt_record"]])


def _pick(df: DataFrame, *more: str) -> DataFrame:
    picked = df.select(*(F.col(f"`{h}`").alias(c) for h, c in zip(TXN_HEADERS, TXN_COLUMNS, strict=True)), *more)
    return drop_malformed(picked, "amount").withColumn("amount", to_number("amount"))


def _client_of_path() -> Column:
    """Client named by the folder ``client_id=...`` that a row's file is in, null without one."""
    found = F.regexp_extract(F.col("_metadata.file_path"), "/client_id=([^/]+)/", 1)
    # Names are escaped when written, and again as part of a path; neither takes + for a blank.
    decoded = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return decoded(decoded(F.nullif(found, F.lit(""))))


def _csv(spark: SparkSession, names: list[str], path: str, clients: bool) -> DataFrame:
    raw = spark.read.schema(_schema(names)).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", enforceSchema=True, recursiveFileLookup=clients).csv(path)
    return raw.withColumn("client_id", _client_of_path()) if clients else raw


def _client_files(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Folders of clients below ``path`` by their header, so that files of one layout are read together."""
    by: dict[tuple[str, ...], list[str]] = {}
    for folder in subfolders(spark, path):
        if "/client_id=" in folder and (header := _header(spark, folder)):
            by.setdefault(tuple(header), []).append(folder)
    return by


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The eight transaction columns by header name; short rows and rows without a numeric amount are dropped."""
    names = _header(spark, path)
    return _pick(_whole_rows(_csv(spark, names, path, False), len(names)))


def read_client_transactions(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_transactions`` over a folder with a folder ``client_id=...`` for each client; each row with its client.

    Clients may have their columns in different order. Files outside such folders are ignored.
    """
    parts = [_pick(_whole_rows(_csv(spark, list(names), folders, True), len(names)), "client_id") for names, folders in _client_files(spark, path).items()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ", ".join([*(f"{c} {'double' if c == 'amount' else 'string'}" for c in TXN_COLUMNS), "client_id string"]))


def _stream(spark: SparkSession, path: str, more: list[str], files_per_trigger: int, clients: bool) -> DataFrame:
    raw = spark.readStream.schema(_schema([*TXN_HEADERS, *more])).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", maxFilesPerTrigger=files_per_trigger, recursiveFileLookup=clients).csv(path)
    kept = _whole_rows(raw.withColumn("client_id", _client_of_path()) if clients else raw, len(TXN_HEADERS))
    return kept.select(*(F.col(f"`{h}`").alias(c) for h, c in zip(TXN_HEADERS, TXN_COLUMNS, strict=True)), *more, *(["client_id"] if clients else []))


def stream_transactions(spark: SparkSession, path: str, files_per_trigger: int = 4, clients: bool = False) -> DataFrame:
    """The same as a stream over a drop folder whose files carry exactly the published headers.

    The client is a last column of the files, or with ``clients`` that of the folder ``client_id=...`` a file arrives in.
    """
    picked = _stream(spark, path, [] if clients else ["client_id"], files_per_trigger, clients)
    return drop_malformed(picked, "amount").withColumn("amount", to_number("amount"))


def stream_sessions(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """Payments and the markers of their sessions in order of arrival: files with the columns ``client_id, event`` at their end.

    ``event`` is null for payments. A row with an event is kept whatever else it holds; its client's payments stand
    before it in its file or in earlier ones.
    """
    rows = _stream(spark, path, ["client_id", "event"], files_per_trigger, False).withColumn("amount", to_number("amount"))
    return rows.where(F.col("event").isNotNull() | F.col("amount").isNotNull())


def _accounts(raw: DataFrame, *more: str) -> DataFrame:
    return _whole_rows(raw, 2).select("bank_name", normalize_bank_id("bank_id").alias("bank_id"), *more)


def _account_names(header: list[str] | tuple[str, ...]) -> list[str]:
    return ["bank_name", "bank_id", *(f"c{i}" for i in range(2, len(header)))]


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Bank name and normalised bank id: the first two columns, whatever their headers."""
    return _accounts(_csv(spark, _account_names(_header(spark, path)), path, False))


def read_client_accounts(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_accounts`` over a folder with a folder ``client_id=...`` for each client."""
    parts = [_accounts(_csv(spark, _account_names(names), folders, True), "client_id") for names, folders in _client_files(spark, path).items()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "bank_name string, bank_id string, client_id string")


def read_btc_rates(spark: SparkSession, path: str) -> DataFrame:
    """``day, rate`` with ``/`` accepted in dates; blank and unparseable lines are skipped."""
    raw = spark.read.schema("date string, rate string").options(header=True, mode="PERMISSIVE").csv(path)
    out = raw.select(F.regexp_replace(F.trim("date"), "/", "-").try_cast("date").alias("day"), to_number("rate").alias("rate"))
    return out.where(F.col("day").isNotNull() & F.col("rate").isNotNull())


def read_fiat_rates(spark: SparkSession, path: str) -> DataFrame:
    """``day, origin, target, rate`` of other currencies, with headers of these names; lines that can't be parsed are skipped."""
    raw = spark.read.schema("day string, origin string, target string, rate string").options(header=True, mode="PERMISSIVE").csv(path)
    day = F.regexp_replace(F.trim("day"), "/", "-").try_cast("date").alias("day")
    out = raw.select(day, F.upper(F.trim("origin")).alias("origin"), F.upper(F.trim("target")).alias("target"), to_number("rate").alias("rate"))
    return out.dropna()


def fx_rates(btc: DataFrame, fiat: DataFrame | None = None) -> DataFrame:
    """The rate table: bitcoin divides by its dollar price, other currencies multiply."""
    out = btc.select("day", F.lit("BTC").alias("origin"), F.lit("USD").alias("target"), "rate", F.lit("div").alias("op"))
    return out.unionByName(fiat.select("day", "origin", "target", "rate", F.lit("mul").alias("op"))) if fiat is not None else out
