"""Query parameters.

The defaults are the fixed values of the five questions: change them with
``dataclasses.replace`` or keyword arguments, never in the operators.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class Period:
    """A closed time range: both ends belong to it."""

    start: datetime
    end: datetime


@dataclass(frozen=True)
class RiskParams:
    # Fixed values (the questions as they are asked of the bank data).
    usd_name: str = "US Dollar"
    period_1: Period = Period(datetime(2022, 9, 1, 0, 0), datetime(2022, 9, 5, 23, 59))
    period_2: Period = Period(datetime(2022, 9, 6, 0, 0), datetime(2022, 9, 15, 23, 59))
    low_usd_amount: float = 50.0
    anomaly_fraction: float = 0.01
    min_intermediaries: int = 5
    conversion_formats: tuple[str, ...] = ("Wire", "ACH")
    low_converted_amount: float = 1.0
    unknown_bank: str = "Unknown"

    graph_period: Period | None = None  # scatter-gather period, period_1 if None

    # How the work is spread; none of these changes a result.
    hub_paths: int | None = 1_000_000  # in x out of one account above which it is a hub
    side_rows: int = 200_000  # a side table up to this size may be broadcast
    side_bytes: int = 32 * 1024 * 1024

    @property
    def scatter_period(self) -> Period:
        return self.graph_period or self.period_1
