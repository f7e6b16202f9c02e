"""Streams against their batch twins: several files, several runs, repeated files."""

from __future__ import annotations

import shutil
from datetime import datetime, timedelta

import pytest
from bank_files import TRANSACTIONS, scatter_gather_edges, write

from ledgerscope import RiskParams, plans, streaming
from ledgerscope.operators import aggregates, filters
from ledgerscope.operators.projections import normalize_transactions
from ledgerscope.schemas import FX_RATE
from ledgerscope.sources import read_transactions, stream_transactions, with_btc_rates
from ledgerscope.sources import order_tables as tables

HEADER, *LINES = TRANSACTIONS.replace("\n\n", "\n").splitlines()
PARAMS = RiskParams()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def part(folder, name, lines):
    return write(folder, name, "\n".join([HEADER, *lines]) + "\n")


@pytest.fixture
def folder(tmp_path):
    """Three files of the small transactions, one micro-batch each."""
    into = tmp_path / "in"
    into.mkdir()
    for number in range(3):
        part(into, f"{number}.csv", LINES[number::3])
    return into


def stream_of(spark, folder):
    raw = stream_transactions(spark, str(folder), max_files=1)
    return normalize_transactions(raw)


def batch_of(spark, folder):
    return normalize_transactions(read_transactions(spark, str(folder)))


def test_scan(spark, folder):
    got = streaming.run_appending(stream_transactions(spark, str(folder), max_files=1), "scan")
    assert rows(got) == rows(read_transactions(spark, str(folder)))


def test_low_usd_takes_up_only_new_files(spark, folder, tmp_path):
    out = str(tmp_path / "out")

    def run():
        low = plans.low_usd_transfers(stream_of(spark, folder))
        return rows(streaming.run_appending(low, "low", out))

    assert run() == rows(plans.low_usd_transfers(batch_of(spark, folder)))
    assert run() == rows(plans.low_usd_transfers(batch_of(spark, folder)))
    part(folder, "late.csv", ["2022/09/20 00:00,1,Z,2,Y,1,Euro,2.5,US Dollar,Wire,0"])
    later = run()
    assert ("1", "Z", "2", "Y", 2.5) in later
    assert later == rows(plans.low_usd_transfers(batch_of(spark, folder)))


def test_running_aggregates(spark, folder, tmp_path):
    tx = batch_of(spark, folder)
    usd = filters.usd_only(tx, PARAMS)
    out = str(tmp_path / "max")
    got = streaming.running_bank_max(stream_of(spark, folder), PARAMS, path=out)
    assert rows(got) == rows(aggregates.bank_max(usd)) == [("10", "A0", 50.0), ("30", "A3", 0.995)]
    part(folder, "late.csv", ["2022/09/20 00:00,010,A,2,Y,1,Euro,50.0,US Dollar,Wire,0"])
    got = streaming.running_bank_max(stream_of(spark, folder), PARAMS, path=out)
    assert rows(got) == [("10", "A", 50.0), ("30", "A3", 0.995)]

    averages = streaming.running_format_averages(stream_of(spark, folder), PARAMS)
    first = usd.where(filters.in_period(usd, PARAMS.period_1))
    expected = rows(aggregates.format_averages(first))
    assert rows(averages.select("format_key", "average_amount")) == expected


def test_low_count(spark, folder, tmp_path):
    rates = with_btc_rates(spark.createDataFrame([], FX_RATE))
    assert rows(streaming.running_low_count(stream_of(spark, folder), rates, PARAMS)) == [(1,)]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert rows(streaming.running_low_count(stream_of(spark, empty), rates, PARAMS)) == [(0,)]
    none = plans.low_usd_transfers(stream_of(spark, empty))
    assert streaming.run_appending(none, "none").count() == 0


def test_staged_anomalies(spark, folder):
    got = streaming.staged_anomalies(stream_of(spark, folder), PARAMS)
    assert rows(got) == rows(plans.anomalous_transfers(batch_of(spark, folder)))
    assert rows(got) == [("030", "A3", 0.3)]


def test_staged_scatter_gather(spark, tmp_path):
    into = tmp_path / "graph"
    into.mkdir()
    lines = [
        f"2022/09/02 10:00,1,{a},1,{b},1,US Dollar,1,US Dollar,Wire,0"
        for a, b in scatter_gather_edges()
    ]
    for number in range(3):
        part(into, f"{number}.csv", lines[number::3] + lines[:5])
    got = streaming.staged_scatter_gather(stream_of(spark, into), PARAMS)
    assert rows(got) == [("1", "G"), ("1", "P"), ("1", "Q"), ("1", "S")]


@pytest.mark.parametrize("event_time", [None, "ts"])
def test_repeated_files_count_once(spark, tmp_path, event_time):
    """The same messages delivered three times, in separate batches."""
    source = tmp_path / "events"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(source))
    (file,) = source.glob("part-*.parquet")
    for copy in ("a", "b"):
        shutil.copy(file, source / f"part-{copy}.parquet")
    raw = stream_transactions(
        spark, str(source), events.schema, fmt="parquet", max_files=1
    )
    once = streaming.drop_seen(
        tables.event_transactions(raw), event_time=event_time, delay="60 days"
    )
    got = streaming.run_appending(once, "once")
    assert rows(got) == rows(tables.event_transactions(events))


def test_ids_are_forgotten_after_the_delay(spark, tmp_path):
    source, out = str(tmp_path / "messages"), str(tmp_path / "out")
    schema = "client_id string, message_id string, ts timestamp_ntz"
    # a comes again within the delay and long after it; the last message is only there to push the time on.
    arrivals = [("a", 0), ("b", 0), ("a", 1), ("c", 30), ("d", 31), ("a", 32), ("e", 60), ("f", 61)]
    for message, hour in arrivals:
        row = spark.createDataFrame([("x", message, datetime(2024, 1, 1) + timedelta(hours=hour))], schema)
        row.coalesce(1).write.mode("append").parquet(source)
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        streaming.drop_seen(files, event_time="ts", delay="2 hours")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.read.schema(schema).parquet(out)
    assert sorted(r["message_id"] for r in got.collect()) == ["a", "a", "b", "c", "d", "e", "f"]
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 4 and sizes[-1] < 4


def test_a_message_id_of_another_client_is_another_message(spark, tmp_path):
    source = str(tmp_path / "messages")
    df = spark.createDataFrame(
        [("a", "1"), ("b", "1"), ("a", "1"), ("a", "2")], "client_id string, message_id string"
    )
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    got = streaming.run_appending(streaming.drop_seen(stream), "clients")
    assert rows(got) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_by_client(spark):
    stream = tables.event_stream(spark, "/root/testdata/sf0.001")
    batch = tables.batch_events(spark, "/root/testdata/sf0.001")
    got = streaming.running_bank_max(stream, tables.STREAM_PARAMS, ["client_id"])
    usd = filters.usd_only(batch, tables.STREAM_PARAMS)
    assert rows(got) == rows(aggregates.bank_max(usd, ["client_id"]))


def test_state_is_kept_per_client(spark):
    sf, by, params = "/root/testdata/sf0.001", ["client_id"], tables.STREAM_PARAMS
    batch, rates = tables.batch_events(spark, sf), tables.fx_rates(spark, sf)

    def stream():
        return tables.event_stream(spark, sf)

    counts = streaming.running_low_count(stream(), rates, params, by)
    assert rows(counts) == rows(plans.low_converted_count(batch, rates, params, by))
    assert counts.count() == 3

    usd = filters.usd_only(batch.where(filters.in_period(batch, params.period_1)), params)
    averages = streaming.running_format_averages(stream(), params, by)
    got = {(r["client_id"], r["format_key"]): r["average_amount"] for r in averages.collect()}
    expected = {
        (r["client_id"], r["format_key"]): r["average_amount"]
        for r in aggregates.format_averages(usd, by).collect()
    }
    assert got == pytest.approx(expected)

    anomalies = streaming.staged_anomalies(stream(), params, by)
    assert rows(anomalies) == rows(plans.anomalous_transfers(batch, params, by))
    accounts = streaming.staged_scatter_gather(stream(), params, by)
    assert rows(accounts) == rows(plans.scatter_gather_accounts(batch, params, by))
