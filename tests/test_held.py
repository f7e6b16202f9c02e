"""Rows held in state until their client's averages are complete."""

from __future__ import annotations

import time
from datetime import datetime

import pytest

from ledgerscope import RiskParams, plans, streaming
from ledgerscope.streaming import held_counts

PARAMS = RiskParams()
TX = (
    "client_id string, ts timestamp_ntz, from_bank string, from_account string, to_bank string, to_account string, "
    "amount double, currency string, payment_format string"
)
FIRST, SECOND = PARAMS.period_1.start, PARAMS.period_2.start
MARKS = "client_id string, mark string"


def tx(client, when, account, amount, payment_format="Wire"):
    return (client, when, "1", account, "2", "Z", amount, "US Dollar", payment_format)


class Arrivals:
    """Folders of rows and marks, read as streams of one file a batch."""

    def __init__(self, spark, root):
        self.spark, self.root, self.sent = spark, str(root), []

    def send(self, *rows):
        self.sent += rows
        self.spark.createDataFrame(list(rows), TX).coalesce(1).write.mode("append").parquet(f"{self.root}/tx")

    def mark(self, *marks):
        self.spark.createDataFrame(list(marks), MARKS).coalesce(1).write.mode("append").parquet(f"{self.root}/marks")

    def run(self, **options):
        def stream(name, schema):
            self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.root}/{name}")
            return (
                self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/{name}")
            )

        got = streaming.held_anomalies(
            stream("tx", TX), stream("marks", MARKS), PARAMS, f"{self.root}/kept", spread=3, **options
        )
        return sorted(tuple(r) for r in got.collect())

    def batch(self, *clients):
        got = plans.anomalous_transfers(self.spark.createDataFrame(self.sent, TX), PARAMS, ["client_id"])
        return sorted(tuple(r) for r in got.collect() if r["client_id"] in clients)

    def held(self):
        return {r["client_id"]: r["held"] for r in held_counts(self.spark, f"{self.root}/kept").collect()}


@pytest.fixture
def arrivals(spark, tmp_path):
    return Arrivals(spark, tmp_path)


def test_rows_come_out_once_after_the_mark_and_leave_no_state(arrivals):
    # The later period first: these rows have to wait for averages that are still to come.
    arrivals.send(*[tx("a", SECOND, f"A{i}", 0.001 * i) for i in range(1, 40)])
    arrivals.send(tx("b", SECOND, "B", 0.5), tx("b", FIRST, "B", 90.0))
    assert arrivals.run() == []
    assert arrivals.held() == {"a": 39, "b": 1}

    arrivals.send(tx("a", FIRST, "A", 1.0), tx("a", FIRST, "A", 5.0))
    arrivals.mark(("a", "side"), ("b", "what"))
    got = arrivals.run()
    assert got == arrivals.batch("a") and len(got) == 29
    assert arrivals.held() == {"b": 1}

    arrivals.send(tx("a", SECOND, "late", 0.002), tx("a", SECOND, "much", 7.0))
    got = arrivals.run()
    assert got == arrivals.batch("a") and len(got) == 30
    assert arrivals.run() == got

    arrivals.mark(("a", "end"), ("b", "end"))
    assert arrivals.run() == arrivals.batch("a", "b")
    assert arrivals.held() == {}
    # b's further row is of a new transmission and waits for its mark.
    arrivals.send(tx("b", SECOND, "new", 0.5))
    assert len(arrivals.run()) == 31
    assert arrivals.held() == {"b": 1}


def test_rows_sent_before_an_end_are_all_judged_over_many_batches(arrivals):
    for i in range(6):
        arrivals.send(tx("a", SECOND, f"A{i}", 0.01), tx("a", FIRST, "A", 10.0 * i))
    arrivals.mark(("a", "end"))
    got = arrivals.run()
    assert got == arrivals.batch("a") and len(got) == 6
    assert arrivals.held() == {}


def test_odd_rows(arrivals):
    text = 'quote " comma , \\ back\nbreak'
    arrivals.send(
        tx(None, SECOND, "N", 0.001),
        tx(None, FIRST, "N", 10.0),
        tx("a", SECOND, text, 0.001),
        tx("a", SECOND, text, 0.001),
        tx("a", SECOND, None, 0.001),
        tx("a", SECOND, "A", None),
        tx("a", FIRST, "A", 10.0),
        tx("a", datetime(2020, 1, 1), "A", 0.001),
    )
    arrivals.mark((None, "end"), ("a", "end"))
    got = arrivals.run()
    assert got == arrivals.batch("a", None)
    assert got.count(("a", "1", text, 0.001)) == 2
    assert arrivals.held() == {}


def test_no_rows_and_no_marks(arrivals):
    assert arrivals.run() == []


def test_a_silent_client_is_forgotten(arrivals):
    arrivals.send(tx("a", SECOND, "A", 0.001), tx("a", FIRST, "A", 10.0))
    assert arrivals.run(patience_ms=1) == []
    time.sleep(0.1)
    arrivals.send(tx("b", SECOND, "B", 0.001))
    arrivals.run(patience_ms=600_000)
    assert arrivals.held() == {"b": 1}
