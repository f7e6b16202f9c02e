"""Joins with side tables. ``by`` names extra leading keys, e.g. ``["client_id"]``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import CURRENCY_ISO, currency_key, format_key, rate_date, usd_value
from ledgerscope.operators.filters import is_anomalous
from ledgerscope.params import Period, RiskParams
from ledgerscope.session import land


def small_side(table: DataFrame, params: RiskParams, label: str = "side") -> DataFrame:
    """Finish a side table, measure it, and mark it for broadcast only if it is small.

    An aggregate of a huge table is planned as if it were huge too, so without
    this the other side would be shuffled by a handful of hot keys. The table
    is written first, hence the measuring does not compute it again. A table
    beyond the limits comes back unmarked and is joined by shuffling, where
    skewed partitions are split at run time.
    """
    landed = land(table, label)
    texts = [f.name for f in landed.schema if f.dataType.simpleString() == "string"]
    width = F.lit(16 * len(landed.columns))
    for name in texts:
        width = width + F.coalesce(F.octet_length(name), F.lit(0))
    size = landed.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
    ).first()
    if size["rows"] <= params.side_rows and size["bytes"] <= params.side_bytes:
        return F.broadcast(landed)
    return landed


def _equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k] == right[k] for k in keys])


def with_bank_name(
    maxima: DataFrame,
    names: DataFrame,
    params: RiskParams,
    by: Sequence[str] = (),
    unmatched: str = "default",
) -> DataFrame:
    """Attach the bank name to the maxima.

    A bank missing from the catalog is called ``params.unknown_bank``, or left
    out with ``unmatched="drop"``. Both sides have one row per bank; the
    strategy is left to Spark, which knows their sizes when it gets there.
    """
    if unmatched not in ("default", "drop"):
        raise ValueError("unmatched must be 'default' or 'drop'")
    if unmatched == "drop":
        return maxima.join(names, [*by, "bank_id"])
    listed = names.withColumn("in_catalog", F.lit(True))  # a bank may be listed without a name
    joined = maxima.join(listed, [*by, "bank_id"], "left")
    name = F.when(F.col("in_catalog"), F.col("bank_name")).otherwise(F.lit(params.unknown_bank))
    return joined.withColumn("bank_name", name).drop("in_catalog")


def anomalies(
    tx: DataFrame, averages: DataFrame, params: RiskParams, by: Sequence[str] = ()
) -> DataFrame:
    """Transactions below a fraction of the average of their payment format."""
    keyed = tx.withColumn("format_key", format_key("payment_format"))
    condition = _equal(keyed, averages, [*by, "format_key"]) & is_anomalous(
        keyed["amount"], averages["average_amount"], params.anomaly_fraction
    )
    return keyed.join(averages, condition, "left_semi").select(*tx.columns)


def conversion_rates(rates: DataFrame, period: Period | None, params: RiskParams) -> DataFrame:
    """Rates of the period keyed by day and currency name.

    There is at most one row per day and listed currency, so the size is known
    before anything runs: it is marked for broadcast while days x currencies
    stay within the limit. Of several rates for one key the smallest is taken.
    Without a period there are all rates, of unknown number and so unmarked.
    """
    if period is not None:
        first, last = period.start.date(), period.end.date()
        rates = rates.where(F.col("rate_date").between(F.lit(first), F.lit(last)))
    iso_name = F.create_map(
        *[F.lit(text) for name, iso in CURRENCY_ISO.items() for text in (iso, name)]
    )
    table = (
        rates.where(F.col("iso").isin(*CURRENCY_ISO.values()))
        .groupBy("rate_date", "iso")
        .agg(F.min("rate").alias("rate"))
        .select(
            "rate_date", F.try_element_at(iso_name, F.col("iso")).alias("currency_key"), "rate"
        )
    )
    if period is None:
        return table
    rows = ((last - first).days + 1) * len(CURRENCY_ISO)
    return F.broadcast(table) if rows <= params.side_rows else table


def with_rate(tx: DataFrame, rates: DataFrame) -> DataFrame:
    """Attach ``rate`` (null if there is none for the day and currency)."""
    condition = (rate_date(tx["ts"]) == rates["rate_date"]) & (
        currency_key(tx["currency"]) == rates["currency_key"]
    )
    return tx.join(rates, condition, "left").select(*[tx[c] for c in tx.columns], rates["rate"])


def with_usd_value(tx: DataFrame, rates: DataFrame) -> DataFrame:
    """Attach ``converted``, the unrounded worth in USD; a missing rate counts as 1."""
    return with_rate(tx, rates).withColumn("converted", usd_value("amount", F.col("rate")))


def unmatched_rates(tx: DataFrame, rates: DataFrame) -> DataFrame:
    """How many rows of a listed currency were taken at rate 1 for want of a rate, per day."""
    listed = F.lower("currency").isin(*CURRENCY_ISO)
    return (
        with_rate(tx.where(listed), rates)
        .where("rate is null")
        .groupBy(rate_date("ts").alias("rate_date"), currency_key("currency").alias("currency_key"))
        .agg(F.count("*").alias("tx_count"))
    )
