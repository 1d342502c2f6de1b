"""Schemas and defaults shared by the operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import types as T

#: Columns of the transactions table, in order; ``client_id`` is added at ingest.
TXN_COLUMNS = ("ts", "from_bank", "from_account", "to_bank", "to_account", "amount", "currency", "payment_format")
#: Header names of the same columns in a source file (the second ``Account`` is the receiver's).
TXN_HEADERS = ("Timestamp", "From Bank", "Account", "To Bank", "Account.1", "Amount Paid", "Payment Currency", "Payment Format")

RATES = T.StructType([
    T.StructField("day", T.DateType()),
    T.StructField("origin", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("rate", T.DoubleType()),
    T.StructField("op", T.StringType()),
])

# Currency names as they stand in the source files, with their ISO codes.
CURRENCY_CODES = {
    "Australian Dollar": "AUD",
    "Bitcoin": "BTC",
    "Brazil Real": "BRL",
    "Canadian Dollar": "CAD",
    "Euro": "EUR",
    "Mexican Peso": "MXN",
    "Ruble": "RUB",
    "Rupee": "INR",
    "Saudi Riyal": "SAR",
    "Shekel": "ILS",
    "Swiss Franc": "CHF",
    "UK Pound": "GBP",
    "US Dollar": "USD",
    "Yen": "JPY",
    "Yuan": "CNY",
}

BASE_PERIOD = (date(2022, 9, 1), date(2022, 9, 5))
PROBE_PERIOD = (date(2022, 9, 6), date(2022, 9, 14))
BASELINE_COEF = 0.01
MIN_PATHS = 5
