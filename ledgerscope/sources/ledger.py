"""The ledger: transactions written once as Parquet for all five questions.

Partitioned by day or month, so a question about a period opens its part only,
with the currency name normalised once, so that the USD filter is a plain
equality which reaches the Parquet row groups. Filters use these columns
wherever a table has them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from ledgerscope.functions import currency_key
from ledgerscope.schemas import TRANSACTION

# Partition column by grain: a day for weeks of heavy traffic, a month for years.
GRAINS = {"day": "tx_date", "month": "tx_month"}


def land_ledger(
    tx: DataFrame, path: str, by: Sequence[str] = (), grain: str = "day", mode: str = "replace"
) -> DataFrame:
    """Write transactions below ``path``, partitioned by ``by`` and time, and read the ledger back.

    ``mode`` says what becomes of a ledger that is there: ``replace`` it whole, ``append`` the rows, or
    replace only the ``parts`` (client and day or month) that the new rows fall in.

    The rebalance hint gives every partition its own files, splits one with
    most of the rows over several tasks and merges small ones.
    """
    if mode not in ("replace", "append", "parts"):
        raise ValueError("mode must be 'replace', 'append' or 'parts'")
    parts = [*by, GRAINS[grain]]
    rows = tx.select(
        *TRANSACTION.names,
        currency_key("currency").alias("currency_key"),
        *by,
        F.date_trunc(grain, "ts").cast("date").alias(GRAINS[grain]),
    )
    writer = rows.hint("rebalance", *parts).write.partitionBy(*parts)
    if mode == "parts":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.mode("append" if mode == "append" else "overwrite").parquet(path)
    return read_ledger(tx.sparkSession, path, by, grain)


def read_ledger(
    spark: SparkSession, path: str, by: Sequence[str] = (), grain: str = "day"
) -> DataFrame:
    extra = [StructField(name, StringType()) for name in ("currency_key", *by)]
    schema = [*TRANSACTION.fields, *extra, StructField(GRAINS[grain], DateType())]
    return spark.read.schema(StructType(schema)).parquet(path)
