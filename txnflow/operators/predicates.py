"""Row predicates and projections."""

from __future__ import annotations

import math
import struct
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnflow.functions import to_day, to_number

_COMPARE = {
    "eq": lambda x, v: x == v,
    "lt": lambda x, v: x < v,
    "le": lambda x, v: x <= v,
    "gt": lambda x, v: x > v,
    "ge": lambda x, v: x >= v,
}
_TEXT = {
    "contains": lambda x, v: x.contains(v),
    "startswith": lambda x, v: x.startswith(v),
    "endswith": lambda x, v: x.endswith(v),
}
OPS = ("eq", "neq", "lt", "le", "gt", "ge", "contains", "startswith", "endswith", "in")


_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Months that a range of days may touch to be told by their names; longer ranges are told by years.
MONTHS = 24


def _shortest_float(value: float) -> bool:
    """Whether ``value`` is what a 32-bit float near it reads as."""
    return math.isfinite(value) and abs(value) < 3e38 and float(f"{struct.unpack('f', struct.pack('f', value))[0]:.7g}") == value


def _compared(x: Column, op: str, value: float, kind: str) -> Column:
    """Comparison with a number. Numeric columns are compared as they are, so that the scan can do it."""
    if kind in _WHOLE and math.isfinite(value):
        if not float(value).is_integer():
            # No whole number is equal to a fraction; the next one below or above stands for it.
            if op in ("eq", "neq"):
                return x.isNotNull() & F.lit(False) if op == "eq" else F.lit(True)
            return x <= math.floor(value) if op in ("lt", "le") else x >= math.ceil(value)
        value = F.lit(int(value))
    elif kind == "double":
        value = F.lit(float(value))
    elif kind == "float" and _shortest_float(float(value)):
        value = F.lit(float(value)).cast("float")
    elif kind.startswith("decimal") and math.isfinite(value):
        value = F.lit(Decimal(str(value)))
    else:
        x, value = to_number(x), F.lit(float(value))
    return ~x.eqNullSafe(value) if op == "neq" else _COMPARE[op](x, value)


def _text_range(x: Column, first: date | None, last: date | None) -> Column:
    """What the text of a timestamp must be like for its day to lie between two days, in terms that a scan can check.

    Months may have one digit or two; a range of many months or without an end is told by its years. A year of more than
    four digits has a sign.
    """
    if first and last and last.year < 9999 and (last.year - first.year) * 12 + last.month - first.month < MONTHS:
        months, at = [], first.replace(day=1)
        while at <= last:
            months.append((at.year, at.month))
            at = (at + timedelta(31)).replace(day=1)
        names = dict.fromkeys(f"{y:04}/{m}/" for y, n in months for m in (f"{n:02}", str(n)))
        out = None
        for name in names:
            out = x.startswith(name) if out is None else out | x.startswith(name)
        return out
    out = F.lit(True)
    if first:
        out = x >= f"{first.year:04}/"
    if last:
        out = out & (x < f"{last.year:04}0")  # 0 comes next after /
    return out if last else out | x.startswith("+")


def _on_day(x: Column, op: str, value, kind: str, day: Column | None) -> Column:
    """Comparison of a timestamp's day with a date, or with a pair of dates. ``day`` is its stored day where there is one."""
    lo, hi = (min(value), max(value)) if op == "in" else (value if op in ("eq", "ge", "gt") else None, value if op in ("eq", "le", "lt") else None)
    parsed = to_day(x) if day is None else day
    if op == "in":
        own = parsed.between(F.lit(lo), F.lit(hi))
    else:
        own = ~parsed.eqNullSafe(F.lit(value)) if op == "neq" else _COMPARE[op](parsed, F.lit(value))
    return own if day is not None or op == "neq" or kind != "string" else _text_range(x, lo, hi) & own


def _condition(x: Column, op: str, value, kind: str = "string", day: Column | None = None) -> Column:
    """The comparison itself, null where what is compared can't be parsed. ``kind`` is the column's type."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}; known: {', '.join(OPS)}")
    text = x if kind == "string" else x.cast("string")
    if op == "in":
        if isinstance(value, tuple) and len(value) == 2 and all(isinstance(v, date) for v in value):
            return _on_day(x, op, value, kind, day)
        if not isinstance(value, (list, set, tuple)):
            raise ValueError("'in' needs a list or a pair of dates")
        return text.isin([str(v) for v in value])
    if isinstance(value, (list, tuple, set)):
        raise ValueError("a list or a pair of dates needs the operator 'in'")
    if op in _TEXT:
        return _TEXT[op](text, str(value))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _compared(x, op, value, kind)
    if isinstance(value, date):
        return _on_day(x, op, value, kind, day)
    x, value = text, F.lit(str(value))
    return ~x.eqNullSafe(value) if op == "neq" else _COMPARE[op](x, value)


def predicate(field: str, op: str, value) -> Column:
    """Boolean column, never null. The type of ``value`` decides the comparison.

    Numbers compare as doubles (decimal comma accepted), dates by day, a pair of dates with ``in`` as an
    inclusive day range in either order, a list with ``in`` by text, everything else as text. What can't be
    parsed fails every operator but ``neq``.
    """
    return F.coalesce(_condition(F.col(field), op, value, ""), F.lit(False))


#: Key of a column's metadata that names the column with its day.
DAY_OF = "day"


def where_op(df: DataFrame, field: str, op: str, value) -> DataFrame:
    """Rows that ``predicate`` holds for. The column's type is known here, so plain comparisons reach the scan.

    Dates reach it too: by the stored day of a table written by ``sources.tables.ingest``, which prunes partitions, else
    by the beginnings that the text must have, beside the parsed day.
    """
    known = df.schema[field] if field in df.columns else None
    day = (known.metadata or {}).get(DAY_OF) if known else None
    return df.where(_condition(F.col(field), op, value, known.dataType.simpleString() if known else "", F.col(day) if day in df.columns else None))


def drop_filter_field(df: DataFrame, field: str, op: str, value) -> DataFrame:
    return where_op(df, field, op, value).drop(field)


def reduce_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """The listed columns in order, then ``client_id``; missing columns are an error."""
    if not keep:
        raise ValueError("no columns to keep")
    return df.select(*keep, *(["client_id"] if "client_id" not in keep else []))


def tag_source(df: DataFrame, tag: str) -> DataFrame:
    return df.withColumn("source", F.lit(tag))


def drop_malformed(df: DataFrame, text: str = "amount", min_cells: int = 0, cells: str | None = None) -> DataFrame:
    """Rows whose ``text`` column is a number and, if ``cells`` names a count column, with enough cells."""
    ok = to_number(text).isNotNull()
    return df.where(ok & (F.col(cells) >= min_cells) if cells else ok)


def completed_clients(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of clients whose session has an end marker and was not aborted (``client_id, event``)."""
    ended = sessions.where(F.col("event") == "end").select("client_id").distinct()
    aborted = sessions.where(F.col("event") == "abort").select("client_id").distinct()
    return df.join(ended, "client_id", "left_semi").join(aborted, "client_id", "left_anti")
