"""Column expressions. All of them are built-in functions, none is a UDF."""

from ledgerscope.functions.clock import parse_ts, rate_date
from ledgerscope.functions.money import (
    BTC_RATES,
    CURRENCY_ISO,
    currency_iso,
    float_text,
    low_amount_bound,
    round_cents,
    usd_value,
)
from ledgerscope.functions.shard import stable_shard
from ledgerscope.functions.text import (
    bank_number,
    currency_key,
    float_parse,
    format_key,
    normalize_bank_id,
)

__all__ = [
    "BTC_RATES",
    "CURRENCY_ISO",
    "bank_number",
    "currency_iso",
    "currency_key",
    "float_parse",
    "float_text",
    "format_key",
    "low_amount_bound",
    "normalize_bank_id",
    "parse_ts",
    "rate_date",
    "round_cents",
    "stable_shard",
    "usd_value",
]
