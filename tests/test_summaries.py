"""Answers from stored states against the full scan, while days come in, are added to and are written anew."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from ledgerscope import plans
from ledgerscope.operators import aggregates, filters
from ledgerscope.params import Period, RiskParams
from ledgerscope.schemas import FX_RATE, TRANSACTION
from ledgerscope.sources import land_ledger

FIRST = datetime(2022, 9, 1)
PERIODS = [
    Period(FIRST, datetime(2022, 9, 5, 23, 59)),
    Period(datetime(2022, 9, 2, 7, 30), datetime(2022, 9, 4, 12, 0)),
    Period(datetime(2022, 9, 3, 6, 0), datetime(2022, 9, 3, 18, 0)),
    Period(datetime(2022, 10, 1), datetime(2022, 10, 2)),
]
SCHEMA = TRANSACTION.simpleString()[7:-1] + ",client_id:string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some(rng, days, number):
    def maybe(value):
        return None if rng.random() < 0.03 else value

    return [
        (
            FIRST + timedelta(days=rng.choice(days), minutes=rng.randrange(1440), seconds=rng.choice((0, 0, 59))),
            maybe(rng.choice(("1", "01", "2", "3"))), maybe(f"A{rng.randrange(4)}"), "9", "B",
            maybe(rng.choice((rng.random() * 10.0 ** rng.randrange(-3, 9), 0.995, 5.0))),
            maybe(rng.choice(("US Dollar", "us dollar", "Euro"))),
            maybe(rng.choice(("Wire", "ACH", " wire", "Cheque"))),
            rng.choice(("x", "y")),
        )
        for _ in range(number)
    ]


@pytest.mark.parametrize("by, grain", [([], "day"), (["client_id"], "day")])
def test_equal_to_the_full_scan_after_each_step(spark, tmp_path, by, grain):
    rng = random.Random(len(by) + len(grain))
    params = RiskParams()
    rates = spark.createDataFrame(
        [(date(2022, 9, d), "EUR", 0.5 + d / 7) for d in range(1, 7, 2)], FX_RATE
    )
    euro = [(FIRST + timedelta(days=2, hours=5), "1", "A1", "9", "B", 7.0, "Euro", "Cheque", c) for c in "xy"]
    steps = [
        ("replace", some(rng, range(7), 150)),
        ("append", some(rng, range(3, 9), 80)),
        ("parts", some(rng, [1, 4], 40)),
        ("parts", euro),  # nothing of that day is in USD any more
    ]
    for step, (mode, new) in enumerate(steps):
        tx = spark.createDataFrame(new, SCHEMA.replace(":", " "))
        ledger = land_ledger(tx, str(tmp_path / "ledger"), by, grain, mode)
        states = plans.land_summaries(tx, ledger, rates, str(tmp_path / "states"), params, by, grain, mode)
        usd = filters.usd_only(ledger, params)
        usable = filters.require_fields(usd, "bank_max")
        assert rows(states.bank_max()) == rows(aggregates.bank_max(usable, by))
        for period in {1: PERIODS[:1], 2: PERIODS[3:], 3: PERIODS[1:3]}.get(step, ()):
            inside = usd.where(filters.in_period(usd, period))
            sums = aggregates.exact_format_totals(filters.require_fields(inside, "format_average"), by)
            assert rows(states.format_averages(period)) == rows(sums.drop("total_amount", "tx_count"))
            asked = RiskParams(period_1=period)
            counted = plans.low_converted_count(ledger, rates, asked, by)
            assert rows(states.low_counts(period).select(*counted.columns)) == rows(counted)


def test_other_values_are_not_answered_from_these_states(spark, tmp_path):
    tx = spark.createDataFrame(some(random.Random(1), range(3), 20), SCHEMA.replace(":", " "))
    ledger = land_ledger(tx, str(tmp_path / "ledger"))
    rates = spark.createDataFrame([], FX_RATE)
    path = str(tmp_path / "states")
    plans.land_summaries(tx, ledger, rates, path)
    other = plans.Summaries(ledger, rates, path, RiskParams(low_converted_amount=2.0))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        other.low_converted_count()


def test_empty_ledger(spark, tmp_path):
    tx = spark.createDataFrame([], SCHEMA.replace(":", " "))
    ledger = land_ledger(tx, str(tmp_path / "ledger"))
    states = plans.land_summaries(tx, ledger, spark.createDataFrame([], FX_RATE), str(tmp_path / "states"))
    assert rows(states.bank_max()) == []
    assert rows(states.low_converted_count()) == [(0,)]


def test_whole_days_do_not_open_the_ledger(spark, tmp_path):
    tx = spark.createDataFrame(some(random.Random(2), range(5), 60), SCHEMA.replace(":", " "))
    ledger = land_ledger(tx, str(tmp_path / "ledger"))
    states = plans.land_summaries(tx, ledger, spark.createDataFrame([], FX_RATE), str(tmp_path / "states"))
    whole = Period(FIRST, datetime(2022, 9, 5, 23, 59, 59))
    for answer in (states.bank_max(), states.format_averages(whole), states.low_counts(whole)):
        assert answer.inputFiles() and all("/states/" in name for name in answer.inputFiles())


def test_deliveries_read_the_joined_rows_once_written(spark, monkeypatch):
    """Ledger and states read each delivery several times; none of these reads joins the source tables again."""
    from ledgerscope.checks import queries

    read = []

    def watched(rows, *args, **kwargs):
        read.extend(rows.inputFiles())
        return land_ledger(rows, *args, **kwargs)

    monkeypatch.setattr(queries, "land_ledger", watched)
    monkeypatch.setattr(plans, "land_summaries", lambda rows, *args: read.extend(rows.inputFiles()))
    queries._ledger(spark, "/root/testdata/sf0.001")
    queries._summaries(spark, "/root/testdata/sf0.001")
    assert read and not [name for name in read if "lineitem" in name or "orders" in name]
