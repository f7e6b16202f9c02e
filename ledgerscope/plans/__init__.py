"""The five questions, composed of the operators."""

from ledgerscope.plans.questions import (
    anomalous_transfers,
    largest_per_bank,
    low_converted_count,
    low_usd_transfers,
    run_all,
    scatter_gather_accounts,
    scatter_gather_account_pairs,
)
from ledgerscope.plans.summaries import Summaries, land_summaries

__all__ = [
    "Summaries",
    "anomalous_transfers",
    "land_summaries",
    "largest_per_bank",
    "low_converted_count",
    "low_usd_transfers",
    "run_all",
    "scatter_gather_account_pairs",
    "scatter_gather_accounts",
]
