"""Questions 2, 3 and 5 answered from partial results stored per day beside the ledger.

`land_summaries` reads new transactions once and writes, for every day and key, states that can be merged: the largest
transfer of each bank, exact sums of each payment format, and the number of low converted amounts. It takes the same ``by``,
``grain`` and ``mode`` as ``land_ledger``, so a part of the ledger that is written anew is written anew here too. A question
then merges the states of the whole days of its period and reads of the ledger only a day that the period cuts.

States are a few rows per key and day whatever the number of transactions is; a question over years reads these, not the ledger.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions import bank_number, format_key
from ledgerscope.operators import aggregates, exact_sums, filters, joins
from ledgerscope.operators.projections import as_result, bank_catalog
from ledgerscope.params import Period, RiskParams
from ledgerscope.sources.ledger import GRAINS

MAXIMA, FORMAT_SUMS, LOW_COUNTS = "maxima", "format_sums", "low_counts"


# What each table has besides its keys and the column it is partitioned by.
_COLUMNS = {
    MAXIMA: "bank_id string, from_account string, amount double",
    FORMAT_SUMS: "format_key string, place int, "
    + ", ".join(f"part_{i} bigint" for i in range(exact_sums.PARTS))
    + ", number bigint, "
    + ", ".join(f"{name} boolean" for name in exact_sums.FLAGS),
    LOW_COUNTS: "count bigint, first_ts timestamp_ntz, last_ts timestamp_ntz",
}


def _folder(path: str, params: RiskParams) -> str:
    """States hold for the values they were made with; other values have other folders."""
    formats = sorted({name.strip().lower() for name in params.conversion_formats})
    values = json.dumps([params.usd_name.lower(), formats, params.low_converted_amount])
    return f"{path}/values={hashlib.md5(values.encode()).hexdigest()}"


def _filled(step: str) -> Column:
    return reduce(and_, [F.col(name).isNotNull() for name in filters.REQUIRED_FIELDS[step]])


def _states(
    tx: DataFrame, rates: DataFrame | None, params: RiskParams, by: Sequence[str]
) -> dict[str, DataFrame]:
    """Rows that a question leaves out are states too, under a null key: so every day that has rows has a state in each table, and
    a day written anew replaces the old one also where nothing of it counts any more."""
    usd = F.coalesce(filters.is_usd(tx, params), F.lit(False))
    day = F.col("ts").cast("date").alias("day")
    wanted = sorted({name.strip().lower() for name in params.conversion_formats})
    fields = [*by, day, "ts", "amount", "currency", "from_account"]
    rows = tx.select(
        *fields,
        F.when(usd & _filled("bank_max"), bank_number("from_bank")).alias("from_bank"),
        F.when(usd & _filled("format_average"), format_key("payment_format")).alias("format_key"),
        (_filled("conversion") & F.lower("payment_format").isin(*wanted)).alias("asked"),
    )
    keys = [*by, "day"]
    states = {
        MAXIMA: aggregates.bank_max(rows, keys),
        FORMAT_SUMS: exact_sums.partial_sums(
            rows.withColumn("amount", F.when(F.col("format_key").isNotNull(), F.col("amount"))),
            [*keys, "format_key"],
            "amount",
        ),
    }
    if rates is not None:
        table = joins.small_side(joins.conversion_rates(rates, None, params), params, "rates")
        priced = joins.with_usd_value(rows, table)
        low = F.col("asked") & filters.is_low_converted("converted", params.low_converted_amount)
        states[LOW_COUNTS] = priced.groupBy(*keys).agg(
            F.count_if(F.coalesce(low, F.lit(False))).alias("count"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    return states


@dataclass(frozen=True)
class Summaries:
    """Stored states together with the ledger they belong to."""

    ledger: DataFrame
    rates: DataFrame
    path: str
    params: RiskParams = RiskParams()
    by: Sequence[str] = ()
    grain: str = "day"

    def _read(self, name: str) -> DataFrame:
        spark: SparkSession = self.ledger.sparkSession
        keys = [*(f"`{c}` string" for c in self.by), "day date"]
        schema = ", ".join([*keys, _COLUMNS[name], f"{GRAINS[self.grain]} date"])
        return spark.read.schema(schema).parquet(f"{_folder(self.path, self.params)}/{name}")

    def _within(self, rows: DataFrame, first: date, last: date) -> DataFrame:
        """States of the days from ``first`` to ``last``, by the column they are partitioned by and by day."""
        part = GRAINS[self.grain]
        start = first.replace(day=1) if self.grain == "month" else first
        inside = F.col("day").between(F.lit(first), F.lit(last))
        return rows.where(inside & F.col(part).between(F.lit(start), F.lit(last)))

    def _cut_days(self, period: Period) -> set[date]:
        """Those of the first and the last day of the period that have rows outside it."""
        ends = {period.start.date(), period.end.date()}
        start, end = (F.lit(t).cast("timestamp_ntz") for t in (period.start, period.end))
        outside = (F.col("first_ts") < start) | (F.col("last_ts") > end)
        counts = self._within(self._read(LOW_COUNTS), min(ends), max(ends))
        cut = counts.agg(*[F.max(outside & (F.col("day") == F.lit(d))).alias(str(d)) for d in sorted(ends)]).first()
        return {d for d in ends if cut[str(d)]}

    def _of_period(self, name: str, period: Period) -> DataFrame:
        """States of the whole days of a period, and of the part of a day that it cuts from the ledger."""
        first, last = period.start.date(), period.end.date()
        cut = self._cut_days(period)
        whole = self._read(name)
        columns = [c for c in whole.columns if c != GRAINS[self.grain]]
        whole = self._within(whole, first, last).select(*columns)
        if not cut:
            return whole
        whole = whole.where(~F.col("day").isin(*cut))
        parts = []
        for day in sorted(cut):
            start = max(period.start, datetime.combine(day, datetime.min.time()))
            end = min(period.end, datetime.combine(day + timedelta(days=1), datetime.min.time()) - timedelta.resolution)
            parts.append(self.ledger.where(filters.in_period(self.ledger, Period(start, end))))
        rest = reduce(DataFrame.unionByName, parts)
        rates = self.rates if name == LOW_COUNTS else None
        return whole.unionByName(_states(rest, rates, self.params, self.by)[name].select(*columns))

    def bank_max(self, period: Period | None = None) -> DataFrame:
        """Like ``aggregates.bank_max`` over USD rows; over all dates without a period."""
        states = self._read(MAXIMA) if period is None else self._of_period(MAXIMA, period)
        return aggregates.merge_bank_max(states.where("bank_id is not null"), self.by)

    def format_averages(self, period: Period) -> DataFrame:
        """Like ``aggregates.format_averages`` over USD rows, from exact sums."""
        states = self._of_period(FORMAT_SUMS, period).where("format_key is not null")
        sums = exact_sums.finished_sums(states, [*self.by, "format_key"]).where("number > 0")
        return sums.select(*self.by, "format_key", (F.col("total") / F.col("number")).alias("average_amount"))

    def low_counts(self, period: Period) -> DataFrame:
        """Like ``aggregates.low_amount_count``; with ``by`` every client of the ledger has a row."""
        total = F.coalesce(F.sum("count"), F.lit(0)).alias("count")
        counts = self._of_period(LOW_COUNTS, period).groupBy(*self.by).agg(total)
        if not self.by:
            return counts
        clients = self._read(LOW_COUNTS).select(*self.by).distinct()
        return clients.join(counts, list(self.by), "left").fillna(0, ["count"])

    def largest_per_bank(self, accounts: DataFrame, unmatched: str = "default") -> DataFrame:
        """Question 2."""
        names = aggregates.bank_names(bank_catalog(accounts), self.by)
        return as_result(joins.with_bank_name(self.bank_max(), names, self.params, self.by, unmatched), 2)

    def anomalous_transfers(self) -> DataFrame:
        """Question 3: of the ledger only period 2 is read."""
        params = self.params
        usd = filters.usd_only(self.ledger, params)
        later = filters.require_fields(usd.where(filters.in_period(usd, params.period_2)), "anomaly")
        averages = joins.small_side(self.format_averages(params.period_1), params, "averages")
        return as_result(joins.anomalies(later, averages, params, self.by), 3)

    def low_converted_count(self) -> DataFrame:
        """Question 5."""
        return as_result(self.low_counts(self.params.period_1), 5)


def land_summaries(
    tx: DataFrame,
    ledger: DataFrame,
    rates: DataFrame,
    path: str,
    params: RiskParams = RiskParams(),
    by: Sequence[str] = (),
    grain: str = "day",
    mode: str = "replace",
) -> Summaries:
    """Write the states of ``tx``, the rows that ``land_ledger`` was given with the same ``mode``, and give all there are.

    ``rates`` are those of today: if rates of a day change, write its part anew. A part has few rows, so it
    becomes one file per run and table.
    """
    if mode not in ("replace", "append", "parts"):
        raise ValueError("mode must be 'replace', 'append' or 'parts'")
    part = GRAINS[grain]
    for name, states in _states(tx, rates, params, by).items():
        rows = states.withColumn(part, F.date_trunc(grain, "day").cast("date"))
        writer = rows.repartition(*by, part).write.partitionBy(part, *by)
        if mode == "parts":
            writer = writer.option("partitionOverwriteMode", "dynamic")
        target = f"{_folder(path, params)}/{name}"
        writer.mode("append" if mode == "append" else "overwrite").parquet(target)
    return Summaries(ledger, rates, path, params, by, grain)
