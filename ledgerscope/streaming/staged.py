"""Queries which need one side whole before the first row of the other is judged.

Each is two steps over the same arriving files: the first finishes a table, the
second uses it. Nothing is held back in memory meanwhile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ledgerscope.operators import filters, graph, joins
from ledgerscope.operators.projections import as_result
from ledgerscope.params import RiskParams
from ledgerscope.streaming.running import running_format_averages
from ledgerscope.streaming.tables import run_appending


def staged_anomalies(
    stream: DataFrame, params: RiskParams, by: Sequence[str] = (), path: str | None = None
) -> DataFrame:
    """Averages of period 1 so far, and all rows of period 2 so far judged by them.

    ``path`` names a folder kept between runs: the next run reads only what came in since. The USD rows
    of period 2 are kept there, as new rows of period 1 change what is judged.
    """
    averages = running_format_averages(stream, params, by, path and f"{path}/averages")
    later = filters.usd_only(stream.where(filters.in_period(stream, params.period_2)), params)
    needed = filters.require_fields(later, "anomaly").select(
        *by, "from_bank", "from_account", "amount", "payment_format"
    )
    rows = run_appending(needed, "later", path and f"{path}/later")
    side = joins.small_side(averages.select(*by, "format_key", "average_amount"), params)
    return as_result(joins.anomalies(rows, side, params, by), 3)


def staged_scatter_gather(
    stream: DataFrame, params: RiskParams, by: Sequence[str] = (), path: str | None = None
) -> DataFrame:
    """Distinct edges as a stream into a table, then the path search over it.

    With ``path`` the next run adds the edges of new files only; which edges are there is the stream's state.
    """
    edges = run_appending(
        graph.distinct_edges(graph.transfers(stream, params), by), "stream-edges", path
    )
    return as_result(graph.scatter_gather_nodes(edges, params), 4)
