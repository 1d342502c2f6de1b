from txnflow.functions.scalars import (
    currency_code,
    day_key,
    disambiguate_headers,
    normalize_bank_id,
    normalize_value,
    rate_key,
    shard_crc32,
    shard_md5,
    to_day,
    to_number,
    to_timestamp,
)

__all__ = ["currency_code", "day_key", "disambiguate_headers", "normalize_bank_id", "normalize_value", "rate_key", "shard_crc32", "shard_md5", "to_day", "to_number", "to_timestamp"]
