"""Grouped results. ``by`` names extra leading keys, e.g. ``["client_id"]``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import bank_number, format_key
from ledgerscope.operators.exact_sums import exact_sums
from ledgerscope.operators.filters import is_low_converted


def bank_max(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest transaction of each source bank; among equals the smallest account.

    One aggregate over ``(-amount, account)`` follows the tie rule, which
    ``max_by`` does not, and leaves one row per bank and task to shuffle, so a
    bank with most of the rows needs no further care.
    """
    best = F.min(F.struct((-F.col("amount")).alias("negated"), F.col("from_account")))
    return (
        tx.groupBy(*by, bank_number("from_bank").alias("bank"))
        .agg(best.alias("best"))
        .select(
            *by,
            F.col("bank").cast("string").alias("bank_id"),
            F.col("best.from_account").alias("from_account"),
            (-F.col("best.negated")).alias("amount"),
        )
    )


def bank_max_window(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same result by ranking; Spark keeps one row per bank and task before it shuffles."""
    rows = tx.select(*by, bank_number("from_bank").alias("bank"), "from_account", "amount")
    order = Window.partitionBy(*by, "bank").orderBy(
        F.col("amount").desc(), F.col("from_account").asc()
    )
    return (
        rows.withColumn("place", F.row_number().over(order))
        .where("place = 1")
        .select(*by, F.col("bank").cast("string").alias("bank_id"), "from_account", "amount")
    )


def merge_bank_max(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merge partial maxima (bank_id, from_account, amount) with the same rule."""
    return bank_max(partials.withColumnRenamed("bank_id", "from_bank"), by)


def bank_names(catalog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One name per normalised bank id, the smallest if there are several."""
    names = catalog.groupBy(*by, bank_number("bank_id").alias("bank")).agg(
        F.min("name").alias("bank_name")
    )
    return names.select(*by, F.col("bank").cast("string").alias("bank_id"), "bank_name")


def bank_name_conflicts(catalog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bank ids which appear with more than one name."""
    pairs = catalog.select(*by, bank_number("bank_id").alias("bank"), "name").distinct()
    return (
        pairs.where("name is not null")
        .groupBy(*by, "bank")
        .agg(F.count("*").alias("names"), F.min("name").alias("bank_name"))
        .where("names > 1")
        .select(*by, F.col("bank").cast("string").alias("bank_id"), "names", "bank_name")
    )


def format_totals(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum and number of the amounts per payment format."""
    return tx.groupBy(*by, format_key("payment_format").alias("format_key")).agg(
        F.sum("amount").alias("total_amount"), F.count("amount").alias("tx_count")
    )


def exact_format_totals(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Like `format_totals`, with sums that are the same bits in any order of the rows, and the averages of these sums."""
    rows = tx.select(*by, format_key("payment_format").alias("format_key"), "amount")
    return exact_sums(rows, [*by, "format_key"], "amount").select(
        *by,
        "format_key",
        F.col("total").alias("total_amount"),
        F.col("number").alias("tx_count"),
        F.when(F.col("number") > 0, F.col("total") / F.col("number")).alias("average_amount"),
    )


def format_averages(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average amount per payment format; formats without an amount are left out."""
    return (
        format_totals(tx, by)
        .where("tx_count > 0")
        .select(
            *by, "format_key", (F.col("total_amount") / F.col("tx_count")).alias("average_amount")
        )
    )


def low_amount_count(
    converted: DataFrame, threshold: float, by: Sequence[str] = ()
) -> DataFrame:
    """Number of converted amounts below the threshold.

    Without keys there is always one row, 0 on empty input.
    """
    low = F.count_if(is_low_converted("converted", threshold)).alias("count")
    return converted.groupBy(*by).agg(low)
