from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import aggregates, filters, graph, joins
from ledgerscope.operators.projections import as_result, bank_catalog, for_conversion
from ledgerscope.params import RiskParams


def low_usd_transfers(tx: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Question 1: every USD transaction below the amount, over all dates."""
    usd = filters.require_fields(filters.usd_only(tx, params), "low_usd")
    return as_result(filters.below_amount(usd, params.low_usd_amount), 1)


def largest_per_bank(
    tx: DataFrame,
    accounts: DataFrame,
    params: RiskParams = RiskParams(),
    by: Sequence[str] = (),
    unmatched: str = "default",
) -> DataFrame:
    """Question 2: per source bank its name and largest USD transaction, over all dates."""
    usd = filters.require_fields(filters.usd_only(tx, params), "bank_max")
    maxima = aggregates.bank_max(usd, by)
    names = aggregates.bank_names(bank_catalog(accounts), by)
    return as_result(joins.with_bank_name(maxima, names, params, by, unmatched), 2)


def anomalous_transfers(
    tx: DataFrame, params: RiskParams = RiskParams(), by: Sequence[str] = ()
) -> DataFrame:
    """Question 3: USD rows of period 2 far below the period 1 average of their format.

    The averages are finished first, as they are needed whole before the first
    row can be judged; period 2 is then read once and not shuffled.
    """
    usd = filters.usd_only(tx, params)
    first = usd.where(filters.in_period(tx, params.period_1))
    later = filters.require_fields(usd.where(filters.in_period(tx, params.period_2)), "anomaly")
    base = filters.require_fields(first, "format_average")
    averages = joins.small_side(aggregates.format_averages(base, by), params, "averages")
    return as_result(joins.anomalies(later, averages, params, by), 3)


def scatter_gather_account_pairs(
    tx: DataFrame, params: RiskParams = RiskParams(), by: Sequence[str] = (), prune: bool = True
) -> DataFrame:
    """The (origin, destination) pairs behind question 4."""
    edges = graph.distinct_edges(graph.transfers(tx, params), by)
    pairs = graph.scatter_gather_pairs(edges, params, prune)
    return pairs.select(
        *[F.col(f"src.{c}") for c in by],
        F.col("src.bank").alias("from_bank"),
        F.col("src.account").alias("from_account"),
        F.col("dst.bank").alias("to_bank"),
        F.col("dst.account").alias("to_account"),
    )


def scatter_gather_accounts(
    tx: DataFrame, params: RiskParams = RiskParams(), by: Sequence[str] = (), prune: bool = True
) -> DataFrame:
    """Question 4: accounts at either end of a scatter-gather pattern."""
    edges = graph.distinct_edges(graph.transfers(tx, params), by)
    return as_result(graph.scatter_gather_nodes(edges, params, prune), 4)


def low_converted_count(
    tx: DataFrame,
    rates: DataFrame,
    params: RiskParams = RiskParams(),
    by: Sequence[str] = (),
) -> DataFrame:
    """Question 5: number of period 1 wire and ACH transactions worth less than the amount."""
    rows = filters.require_fields(tx.where(filters.in_period(tx, params.period_1)), "conversion")
    rows = for_conversion(filters.with_payment_format(rows, params.conversion_formats))
    priced = joins.with_usd_value(
        rows, joins.conversion_rates(rates, params.period_1, params)
    )
    counts = aggregates.low_amount_count(priced, params.low_converted_amount, by)
    if by:  # a client without such rows has the count 0, as one table alone would
        clients = tx.select(*by).distinct()
        counts = clients.join(counts, list(by), "left").fillna(0, ["count"])
    return as_result(counts, 5)


def run_all(
    tx: DataFrame,
    accounts: DataFrame,
    rates: DataFrame,
    params: RiskParams = RiskParams(),
    by: Sequence[str] = (),
) -> dict[int, DataFrame]:
    """All five results by query number."""
    return {
        1: low_usd_transfers(tx, params),
        2: largest_per_bank(tx, accounts, params, by),
        3: anomalous_transfers(tx, params, by),
        4: scatter_gather_accounts(tx, params, by),
        5: low_converted_count(tx, rates, params, by),
    }
