"""Record layouts of the inputs and of the five results."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _strings(*names: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


# Transactions file: eleven columns, given by position because the header has
# the name "Account" twice.
RAW_TRANSACTION = _strings(
    "timestamp",
    "from_bank",
    "from_account",
    "to_bank",
    "to_account",
    "amount_received",
    "receiving_currency",
    "amount_paid",
    "payment_currency",
    "payment_format",
    "is_laundering",
)

RAW_ACCOUNT = _strings("bank_name", "bank_id", "account_number", "entity_id", "entity_name")

TRANSACTION = StructType(
    [
        StructField("ts", TimestampNTZType()),
        StructField("from_bank", StringType()),
        StructField("from_account", StringType()),
        StructField("to_bank", StringType()),
        StructField("to_account", StringType()),
        StructField("amount", DoubleType()),
        StructField("currency", StringType()),
        StructField("payment_format", StringType()),
    ]
)

FX_RATE = StructType(
    [
        StructField("rate_date", DateType()),
        StructField("iso", StringType()),
        StructField("rate", DoubleType()),
    ]
)

# The rates file as it is published: one object per date and quote currency.
RAW_FX_RATE = StructType(
    [
        StructField("date", DateType()),
        StructField("base", StringType()),
        StructField("quote", StringType()),
        StructField("rate", DoubleType()),
    ]
)

RESULTS = {
    1: StructType(
        [
            StructField("from_bank", StringType()),
            StructField("from_account", StringType()),
            StructField("to_bank", StringType()),
            StructField("to_account", StringType()),
            StructField("amount_paid", DoubleType()),
        ]
    ),
    2: StructType(
        [
            StructField("bank_name", StringType()),
            StructField("from_account", StringType()),
            StructField("amount_paid", DoubleType()),
        ]
    ),
    3: StructType(
        [
            StructField("from_bank", StringType()),
            StructField("from_account", StringType()),
            StructField("amount_paid", DoubleType()),
        ]
    ),
    4: StructType([StructField("bank", StringType()), StructField("account", StringType())]),
    5: StructType([StructField("count", LongType())]),
}
