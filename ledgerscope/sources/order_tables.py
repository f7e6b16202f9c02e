"""Bank tables derived from order, customer and event tables.

Every order line is a transfer from the customer's account to the supplier's.
Customers and suppliers share one space of account numbers, and the bank is a
function of the number, so an account may receive as supplier and pay as
customer. There is one bank more than there are nations: it has no name in the
catalog. Rates exist on business days only, as in published tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions import float_text
from ledgerscope.params import Period, RiskParams
from ledgerscope.schemas import TRANSACTION

BANKS = 26

PARAMS = RiskParams(
    low_usd_amount=10.0,
    period_1=Period(datetime(1995, 1, 1, 0, 0), datetime(1995, 1, 31, 23, 59)),
    period_2=Period(datetime(1995, 2, 1, 0, 0), datetime(1996, 12, 31, 23, 59)),
    graph_period=Period(datetime(1995, 1, 1, 0, 0), datetime(2001, 12, 31, 23, 59)),
)

# The event stream has transfers of one month; low amounts are the first twentieth.
STREAM_PARAMS = RiskParams(
    low_usd_amount=10.0,
    period_1=Period(datetime(2024, 1, 1, 0, 0), datetime(2024, 1, 15, 23, 59)),
    period_2=Period(datetime(2024, 1, 16, 0, 0), datetime(2024, 1, 31, 23, 59)),
    conversion_formats=("error", "signup"),
    graph_period=Period(datetime(2024, 1, 1, 0, 0), datetime(2024, 1, 31, 23, 59)),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bank(key: Column) -> Column:
    return F.lpad((key % BANKS).cast("string"), 3, "0")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    currency = (
        F.when(F.col("l_returnflag") == "A", "Euro")
        .when(F.col("l_returnflag") == "R", "Yen")
        .otherwise("US Dollar")
    )
    payment_format = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Wire")
        .when(F.col("o_orderpriority") == "2-HIGH", "ACH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Cheque")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Credit Card")
        .otherwise("Bitcoin")
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").alias("ts"),
        _bank(F.col("o_custkey")).alias("from_bank"),
        F.col("o_custkey").cast("string").alias("from_account"),
        _bank(F.col("l_suppkey")).alias("to_bank"),
        F.col("l_suppkey").cast("string").alias("to_account"),
        (F.col("l_extendedprice") * F.col("l_discount") / 100).alias("amount"),
        currency.alias("currency"),
        payment_format.alias("payment_format"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per customer. Banks of the first region trade under two names."""
    customers, nations = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    second = (F.col("n_regionkey") == 0) & (F.col("c_mktsegment") == "MACHINERY")
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.when(second, F.concat("n_name", F.lit(" TRADE"))).otherwise(F.col("n_name")).alias(
            "bank_name"
        ),
        F.col("c_nationkey").cast("string").alias("bank_id"),
        F.col("c_custkey").cast("string").alias("account_number"),
        F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("entity_id"),
        F.col("c_name").alias("entity_name"),
    )


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("rate_date")
    days = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("rate_date"))
    quotes = F.array(
        F.struct(F.lit("EUR").alias("iso"), (0.9 + F.dayofmonth(day) * 0.001).alias("rate")),
        F.struct(F.lit("JPY").alias("iso"), (140.0 + F.dayofmonth(day) * 0.125).alias("rate")),
    )
    return days.distinct().where(F.weekday(day) < 5).select("rate_date", F.inline(quotes))


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Euro rate for every day of the events."""
    day = F.col("rate_date")
    days = _table(spark, sf_dir, "events").select(F.to_date("ts").alias("rate_date")).distinct()
    return days.where(day.isNotNull()).select(
        "rate_date", F.lit("EUR").alias("iso"), (0.5 + F.dayofmonth(day) * 0.125).alias("rate")
    )


def raw_transactions(tx: DataFrame) -> DataFrame:
    """Transactions as the text columns of the bank's file."""
    return tx.select(
        F.date_format("ts", "yyyy/MM/dd HH:mm").alias("timestamp"),
        "from_bank",
        "from_account",
        "to_bank",
        "to_account",
        float_text("amount").alias("amount_received"),
        F.col("currency").alias("receiving_currency"),
        float_text("amount").alias("amount_paid"),
        F.col("currency").alias("payment_currency"),
        "payment_format",
        F.lit("0").alias("is_laundering"),
    )


def with_client(tx: DataFrame) -> DataFrame:
    """Transactions of several clients: each payment format is one client's file."""
    return tx.withColumn("client_id", F.concat(F.lit("client-"), F.lower("payment_format")))


def event_transactions(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as transactions with ``message_id`` and ``client_id``."""
    receiver = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    currency = F.when(F.col("event_type") == "error", "Euro").otherwise("US Dollar")
    return events.select(
        F.col("event_id").cast("string").alias("message_id"),
        F.concat(F.lit("client-"), (F.col("user_id") % 3).cast("string")).alias("client_id"),
        "ts",
        _bank(F.col("user_id")).alias("from_bank"),
        F.col("user_id").cast("string").alias("from_account"),
        _bank(receiver).alias("to_bank"),
        receiver.cast("string").alias("to_account"),
        F.col("value").alias("amount"),
        currency.alias("currency"),
        F.col("event_type").alias("payment_format"),
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event file as a stream; a glob, because a stream needs a folder of files."""
    schema = _table(spark, sf_dir, "events").schema
    return event_transactions(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_transactions(_table(spark, sf_dir, "events"))


__all__ = [
    "PARAMS",
    "STREAM_PARAMS",
    "TRANSACTION",
    "accounts",
    "batch_events",
    "event_rates",
    "event_stream",
    "event_transactions",
    "fx_rates",
    "raw_transactions",
    "transactions",
    "with_client",
]
