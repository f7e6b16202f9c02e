"""Bank transaction risk analytics on Spark DataFrames."""

from ledgerscope.params import Period, RiskParams

__all__ = ["Period", "RiskParams"]
