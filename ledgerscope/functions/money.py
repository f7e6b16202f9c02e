from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# The currency names of the data set and their ISO codes. Names
# that are not listed, the US Dollar among them, count as worth 1 USD.
CURRENCY_ISO = {
    "australian dollar": "AUD",
    "bitcoin": "BTC",
    "brazil real": "BRL",
    "canadian dollar": "CAD",
    "euro": "EUR",
    "mexican peso": "MXN",
    "ruble": "RUB",
    "rupee": "INR",
    "saudi riyal": "SAR",
    "shekel": "ILS",
    "swiss franc": "CHF",
    "uk pound": "GBP",
    "yen": "JPY",
    "yuan": "CNY",
}

# Bitcoin per USD on the days of period 1. The second day is ten
# times its neighbours in the original data as well and is kept for equal results.
BTC_RATES = {
    date(2022, 9, 1): 1.0 / 19793.1,
    date(2022, 9, 2): 1.0 / 199999.0,
    date(2022, 9, 3): 1.0 / 19831.4,
    date(2022, 9, 4): 1.0 / 19952.7,
    date(2022, 9, 5): 1.0 / 20126.1,
}

DEFAULT_RATE = 1.0

_SPLITTER = 134217729.0  # 2^27 + 1
_EXACT_CENTS = 9.0e13  # below this a hundredfold double still has all its integers


def currency_iso(col: Column | str) -> Column:
    """ISO code of a currency name, null if it has none in the table."""
    name = F.lower(col)
    pairs = [F.lit(text) for pair in CURRENCY_ISO.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), name)


def usd_value(amount: Column | str, rate: Column | str) -> Column:
    """Worth in USD, not rounded. A missing rate means 1.

    The product with the reciprocal is deliberate: ``amount / rate`` may differ
    in the last bit, which is enough to cross a rounding border.
    """
    amount = F.col(amount) if isinstance(amount, str) else amount
    return amount * (F.lit(1.0) / F.coalesce(rate, F.lit(DEFAULT_RATE)))


def round_cents(col: Column | str) -> Column:
    """Round to two places by the exact binary value, ties to the even cent.

    ``F.round`` looks at the shortest decimal text instead and makes 1.0 of
    0.995, whose binary value lies below the border. Here the part of ``x * 100``
    that a double product loses is computed as well (splitting ``x`` in two
    halves whose products are exact) and decides at the border.
    """
    x = F.col(col) if isinstance(col, str) else col
    scaled = x * 100.0
    spread = x * _SPLITTER
    high = spread - (spread - x)
    low = x - high
    lost = (high * 100.0 - scaled) + low * 100.0
    whole = F.floor(scaled).cast("double")
    part = scaled - whole
    odd = (whole % 2.0) != 0.0
    up = (part > 0.5) | ((part == 0.5) & ((lost > 0.0) | ((lost == 0.0) & odd)))
    cents = whole + F.when(up, 1.0).otherwise(0.0)
    return F.when(F.abs(x) < _EXACT_CENTS, cents / 100.0).otherwise(F.round(x, 2))


def low_amount_bound(threshold: float, digits: int = 2) -> float:
    """Largest double whose rounded value is below ``threshold``.

    ``round(x) < threshold`` is monotone in ``x``, so it equals ``x <= bound``:
    rows are compared with one literal and never rounded. The bound is found by
    halving between two doubles on the driver, whatever the threshold.
    """
    low, high = threshold - 1.0, threshold + 1.0
    while math.nextafter(low, high) < high:
        middle = low + (high - low) / 2.0
        if middle in (low, high):
            middle = math.nextafter(low, high)
        if round(middle, digits) < threshold:
            low = middle
        else:
            high = middle
    return low


def float_text(col: Column | str) -> Column:
    """A double as the shortest decimal text, e.g. ``50.0`` or ``12345678.9``.

    A cast to string would write ``1.23456789E7``. Plain digits are used from
    1e-4 up to 1e16, outside of it ``1e+16`` and ``1.5e-05``. Digits come from
    Java, which before version 19 has one too many for a few values above 1e16.
    """
    x = F.col(col) if isinstance(col, str) else col
    plain = F.call_function("format_number", x, F.lit("0.0" + "#" * 24))
    text = x.cast("string")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(text, "E", -1)
    sign = F.when(exponent.startswith("-"), "-").otherwise("+")
    digits = F.regexp_replace(exponent, "^-", "")
    digits = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    size = F.abs(x)
    fixed = (size == 0.0) | ((size >= 1e-4) & (size < 1e16))
    special = F.isnan(x) | (size == float("inf"))
    return (
        F.when(special, F.lower(F.replace(text, F.lit("Infinity"), F.lit("inf"))))
        .when((x == 0.0) & text.startswith("-"), "-0.0")
        .when(fixed, plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, digits))
    )
