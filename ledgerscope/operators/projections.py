"""Projections between the record layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import float_parse, normalize_bank_id, parse_ts, round_cents
from ledgerscope.schemas import RESULTS

_PARSED = ("ts", "amount")
# Columns that go along with a transaction where a table has them.
_CARRIED = ("client_id", "message_id")
_BAD_LINE = "bad_line"


def whole_lines(raw: DataFrame) -> DataFrame:
    """Rows as they are; a line with too few or too many fields is an error."""
    if _BAD_LINE not in raw.columns:
        return raw
    message = F.concat(F.lit("a line has not the fields of its file: "), F.col(_BAD_LINE))
    return raw.where(F.when(F.col(_BAD_LINE).isNull(), F.lit(True)).otherwise(F.raise_error(message)))


def _fits(raw: DataFrame) -> Column:
    return F.col(_BAD_LINE).isNull() if _BAD_LINE in raw.columns else F.lit(True)


def _parsed(raw: DataFrame, strict: bool) -> DataFrame:
    return raw.select(
        parse_ts("timestamp", strict).alias("ts"),
        "from_bank",
        "from_account",
        "to_bank",
        "to_account",
        float_parse("amount_paid", strict).alias("amount"),
        F.col("payment_currency").alias("currency"),
        "payment_format",
        *[c for c in raw.columns if c in _CARRIED],
    )


def normalize_transactions(raw: DataFrame) -> DataFrame:
    """Raw text columns to the eight typed ones. Bad text and bad lines are errors."""
    return _parsed(whole_lines(raw), strict=True)


def normalize_valid_transactions(raw: DataFrame) -> DataFrame:
    """Like `normalize_transactions`, without the rows `rejected_transactions` gives."""
    readable = normalize_bank_id("from_bank", strict=False).isNotNull()
    return _parsed(raw.where(_fits(raw) & readable), strict=False).dropna(subset=list(_PARSED))


def rejected_transactions(raw: DataFrame) -> DataFrame:
    """Raw rows with a wrong number of fields, or whose time, amount or source bank cannot be read.

    ``reject_reason`` is the first of ``fields``, ``timestamp``, ``amount`` and ``from_bank`` that holds.
    """
    bad_line = ~_fits(raw)
    bad_ts = parse_ts("timestamp", strict=False).isNull()
    bad_amount = float_parse("amount_paid", strict=False).isNull()
    bad_bank = normalize_bank_id("from_bank", strict=False).isNull()
    reason = (
        F.when(bad_line, "fields").when(bad_ts, "timestamp").when(bad_amount, "amount").otherwise("from_bank")
    )
    return raw.where(bad_line | bad_ts | bad_amount | bad_bank).withColumn("reject_reason", reason)


def bank_catalog(accounts: DataFrame) -> DataFrame:
    """Accounts to (bank_id, name), one row per account as they come. Bad lines are errors."""
    accounts = whole_lines(accounts)
    return accounts.select(
        "bank_id",
        F.col("bank_name").alias("name"),
        *[c for c in accounts.columns if c == "client_id"],
    )


def for_conversion(tx: DataFrame) -> DataFrame:
    """The three fields the conversion needs."""
    return tx.select("ts", "amount", "currency", *[c for c in tx.columns if c == "client_id"])


def usd_amounts(converted: DataFrame) -> DataFrame:
    """Only the converted amount, rounded to two places."""
    return converted.select(
        round_cents("converted").alias("amount"),
        *[c for c in converted.columns if c == "client_id"],
    )


def as_result(rows: DataFrame, query_id: int) -> DataFrame:
    """Shape rows as the result of one query (an ``amount`` becomes ``amount_paid``)."""
    if "amount" in rows.columns:
        rows = rows.withColumnRenamed("amount", "amount_paid")
    keep = [c for c in rows.columns if c == "client_id"]
    return rows.select(*keep, *[f.name for f in RESULTS[query_id]])
