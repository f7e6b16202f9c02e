"""Daily exchange rates, units of a currency per USD.

Rates are an input table: no job fetches them from the network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions import BTC_RATES
from ledgerscope.schemas import FX_RATE, RAW_FX_RATE


def with_btc_rates(rates: DataFrame) -> DataFrame:
    """Add the fixed bitcoin rows; they replace bitcoin rows of the same days."""
    spark = rates.sparkSession
    fixed = spark.createDataFrame([(day, "BTC", rate) for day, rate in BTC_RATES.items()], FX_RATE)
    replaced = (F.col("iso") == "BTC") & F.col("rate_date").isin(*BTC_RATES)
    return rates.where(~replaced).select(*FX_RATE.names).unionByName(fixed)


def read_fx_rates(
    spark: SparkSession, path: str, fmt: str = "json", btc: bool = True
) -> DataFrame:
    """Rates saved as JSON (an array or lines), CSV with a header, or Parquet.

    The fields are ``date``, ``quote`` and ``rate``, others are ignored.
    """
    reader = spark.read.schema(RAW_FX_RATE)
    if fmt == "json":
        raw = reader.option("multiLine", True).json(path)
    elif fmt == "jsonl":
        raw = reader.json(path)
    elif fmt == "csv":
        raw = reader.option("header", True).option("enforceSchema", False).csv(path)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown rates format {fmt!r}")
    rates = raw.select(
        F.col("date").alias("rate_date"), F.col("quote").alias("iso"), F.col("rate")
    )
    return with_btc_rates(rates) if btc else rates
