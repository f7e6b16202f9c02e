"""Structured Streaming forms of the operators.

Every run reads what is there and ends (``availableNow``), writes to files in
the shared folder, and is restarted from its checkpoint like any other stream.
"""

from ledgerscope.streaming.growing_graph import GrowingGraph, growing_scatter_gather
from ledgerscope.streaming.held import held_anomalies, held_counts
from ledgerscope.streaming.running import (
    running_bank_max,
    running_format_averages,
    running_low_count,
)
from ledgerscope.streaming.staged import staged_anomalies, staged_scatter_gather
from ledgerscope.streaming.tables import drop_seen, run_appending, run_updating

__all__ = [
    "GrowingGraph",
    "drop_seen",
    "growing_scatter_gather",
    "held_anomalies",
    "held_counts",
    "run_appending",
    "run_updating",
    "running_bank_max",
    "running_format_averages",
    "running_low_count",
    "staged_anomalies",
    "staged_scatter_gather",
]
