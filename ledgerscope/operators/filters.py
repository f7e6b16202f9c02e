"""Row filters and the period classification."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import currency_key, low_amount_bound
from ledgerscope.params import Period, RiskParams

# Fields a row must have before it can take part in a step.
REQUIRED_FIELDS = {
    "low_usd": ("from_bank", "from_account", "to_bank", "to_account", "amount"),
    "bank_max": ("from_bank", "from_account", "amount"),
    "format_average": ("payment_format", "amount"),
    "anomaly": ("payment_format", "amount", "from_bank", "from_account"),
    "conversion": ("ts", "payment_format", "amount", "currency"),
    "edges": ("from_bank", "from_account", "to_bank", "to_account"),
}

ROUTE_ALL_PERIOD_1 = "all.period1"
ROUTE_USD_PERIOD_1 = "usd.period1"
ROUTE_USD_PERIOD_2 = "usd.period2"


def require_fields(tx: DataFrame, step: str) -> DataFrame:
    """Drop rows with a null in a field that ``step`` needs.

    One test per field rather than ``dropna``, which counts over all of them at
    once and so cannot be pushed to the scans.
    """
    return tx.where(reduce(and_, [F.col(name).isNotNull() for name in REQUIRED_FIELDS[step]]))


def is_usd(tx: DataFrame, params: RiskParams) -> Column:
    """Letter case does not count; a ledger has the lower-case name as a column."""
    name = F.col("currency_key") if "currency_key" in tx.columns else currency_key("currency")
    return name == params.usd_name.lower()


def in_period(tx: DataFrame, period: Period) -> Column:
    """Both ends included; a ledger is also restricted by the column it is partitioned by."""
    start = F.lit(period.start).cast("timestamp_ntz")
    end = F.lit(period.end).cast("timestamp_ntz")
    inside = F.col("ts").between(start, end)
    first, last = period.start.date(), period.end.date()
    if "tx_date" in tx.columns:
        inside &= F.col("tx_date").between(F.lit(first), F.lit(last))
    if "tx_month" in tx.columns:
        inside &= F.col("tx_month").between(F.lit(first.replace(day=1)), F.lit(last))
    return inside


def usd_only(tx: DataFrame, params: RiskParams) -> DataFrame:
    return tx.where(is_usd(tx, params))


def below_amount(tx: DataFrame, threshold: float) -> DataFrame:
    """Strictly below the threshold."""
    return tx.where(F.col("amount") < F.lit(threshold))


def classify_period(tx: DataFrame, params: RiskParams) -> DataFrame:
    """One row per transaction and route it takes, named in ``route``.

    Period 1 rows take the route of all currencies, USD rows of it a second one
    as well; of period 2 only USD rows are kept.
    """
    first, second = in_period(tx, params.period_1), in_period(tx, params.period_2)
    usd = is_usd(tx, params)
    routes = (
        F.when(first & usd, F.array(F.lit(ROUTE_ALL_PERIOD_1), F.lit(ROUTE_USD_PERIOD_1)))
        .when(first, F.array(F.lit(ROUTE_ALL_PERIOD_1)))
        .when(second & usd, F.array(F.lit(ROUTE_USD_PERIOD_2)))
    )
    return tx.where(first | (second & usd)).select("*", F.explode(routes).alias("route"))


def route_usd_all(tx: DataFrame, params: RiskParams) -> DataFrame:
    """One row per transaction and branch: ``all``, and for USD ``usd`` and ``usd_max``."""
    branches = F.when(
        is_usd(tx, params), F.array(F.lit("all"), F.lit("usd"), F.lit("usd_max"))
    ).otherwise(F.array(F.lit("all")))
    return tx.select("*", F.explode(branches).alias("branch"))


def with_payment_format(tx: DataFrame, formats: Iterable[str]) -> DataFrame:
    """Keep the listed payment formats; case does not count, outer blanks of the row do."""
    wanted = sorted({name.strip().lower() for name in formats})
    return tx.where(F.lower("payment_format").isin(*wanted))


def is_asked(tx: DataFrame, step: str, params: RiskParams) -> Column:
    """Whether a row is of period 1, of a conversion format, and has all fields of ``step``; never null."""
    wanted = sorted({name.strip().lower() for name in params.conversion_formats})
    filled = reduce(and_, [F.col(name).isNotNull() for name in REQUIRED_FIELDS[step]])
    asked = in_period(tx, params.period_1) & F.lower("payment_format").isin(*wanted) & filled
    return F.coalesce(asked, F.lit(False))


def is_anomalous(amount: Column | str, average: Column | str, fraction: float) -> Column:
    """Below the fraction of a known, positive average; never true otherwise."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    average = F.col(average) if isinstance(average, str) else average
    below = (average > 0.0) & (amount < F.lit(fraction) * average)
    return F.coalesce(below, F.lit(False))


def is_low_converted(converted: Column | str, threshold: float) -> Column:
    """``round(converted, 2) < threshold``, compared without rounding any row."""
    converted = F.col(converted) if isinstance(converted, str) else converted
    return converted <= F.lit(low_amount_bound(threshold))

