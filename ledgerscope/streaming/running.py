"""Aggregates kept up to date while transactions arrive.

The definitions are those of the batch operators; Spark keeps their buffers as
state, per client where ``by`` says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import aggregates, filters, joins
from ledgerscope.params import RiskParams
from ledgerscope.streaming.tables import run_updating


def running_bank_max(
    stream: DataFrame, params: RiskParams, by: Sequence[str] = (), path: str | None = None
) -> DataFrame:
    """Largest USD transaction per source bank so far."""
    usd = filters.require_fields(filters.usd_only(stream, params), "bank_max")
    return run_updating(aggregates.bank_max(usd, by), [*by, "bank_id"], "bank-max", path)


def running_format_averages(
    stream: DataFrame, params: RiskParams, by: Sequence[str] = (), path: str | None = None
) -> DataFrame:
    """USD average of period 1 per payment format so far, with its sum and count."""
    usd = filters.usd_only(stream.where(filters.in_period(stream, params.period_1)), params)
    rows = filters.require_fields(usd, "format_average")
    totals = run_updating(
        aggregates.format_totals(rows, by), [*by, "format_key"], "format-totals", path
    )
    average = F.col("total_amount") / F.col("tx_count")
    return totals.where("tx_count > 0").withColumn("average_amount", average)


def running_low_count(
    stream: DataFrame,
    rates: DataFrame,
    params: RiskParams,
    by: Sequence[str] = (),
    path: str | None = None,
) -> DataFrame:
    """Number of low converted amounts so far; rates are a static table.

    With ``by`` every client that has sent anything has a row, with 0 if nothing of it counts.
    """
    if by:
        asked = filters.is_asked(stream, "conversion", params)
        rows = stream.select(*by, "ts", "amount", "currency", asked.alias("asked"))
    else:
        rows = stream.where(filters.is_asked(stream, "conversion", params)).withColumn("asked", F.lit(True))
    priced = joins.with_usd_value(rows, joins.conversion_rates(rates, params.period_1, params))
    amount = F.when(F.col("asked"), F.col("converted"))
    counts = aggregates.low_amount_count(
        priced.withColumn("converted", amount), params.low_converted_amount, by
    )
    newest = run_updating(counts, by, "low-count", path)
    if by:
        return newest
    return newest.agg(F.coalesce(F.max("count"), F.lit(0)).alias("count"))
