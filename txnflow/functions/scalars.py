"""Scalar functions on columns; everything stays inside Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnflow.schema import CURRENCY_CODES


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_bank_id(x: Column | str) -> Column:
    """Trimmed id without leading zeros; null, empty and all-zero ids are "0"."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(_col(x)), "^0+", ""), F.lit("")), F.lit("0"))


def to_timestamp(ts: Column | str) -> Column:
    """``yyyy/M/d H:m`` or ``yyyy/M/d``, else null."""
    ts = _col(ts)
    return F.coalesce(F.try_to_timestamp(ts, F.lit("yyyy/M/d H:m")), F.try_to_timestamp(ts, F.lit("yyyy/M/d")))


def to_day(ts: Column | str) -> Column:
    """Calendar day of a source timestamp, null where it can't be parsed."""
    return to_timestamp(ts).cast("date")


def day_key(ts: Column | str) -> Column:
    """Text before the first blank with ``-`` for ``/``; nothing is validated."""
    return F.regexp_replace(F.split(_col(ts), " ")[0], "/", "-")


def currency_code(name: Column | str) -> Column:
    """ISO code of a currency name; unknown names pass through."""
    pairs = F.create_map(*(F.lit(x) for kv in CURRENCY_CODES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, _col(name)), _col(name))


def to_number(x: Column | str) -> Column:
    """Double from text; a decimal comma is accepted, anything else unparseable is null."""
    return F.regexp_replace(_col(x).cast("string"), ",", ".").try_cast("double")


def rate_key(day: Column | str, origin: Column | str, target: Column | str) -> Column:
    return F.concat_ws("_", *(_col(x).cast("string") for x in (day, origin, target)))


def shard_crc32(cols: list[Column | str], n: int, sep: str = "") -> Column:
    """CRC-32 of the joined key text modulo ``n``. Without ``sep`` different keys can join to one text."""
    return F.crc32(F.concat_ws(sep, *(_col(c).cast("string") for c in cols))) % n


def shard_md5(key: Column | str, n: int) -> Column:
    """The md5 digest as one 128-bit number modulo ``n``, folded over four 32-bit words."""
    digest, rest = F.md5(_col(key).cast("string")), F.lit(0).cast("long")
    for at in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
        rest = (rest * (2**32 % n) + word) % n
    return rest


def normalize_value(x: Column | str) -> Column:
    """Comparable text of a value: numbers rounded to 4 places, whole ones without a fraction."""
    x = _col(x)
    v = F.round(x.try_cast("double"), 4)
    return F.when(v.isNull(), x.cast("string")).when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def disambiguate_headers(names: list[str]) -> list[str]:
    """Repeated header names get ``.1``, ``.2``, ... as suffixes."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out
