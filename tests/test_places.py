"""De-duplication by stretches of a file: the rows of ``dropDuplicates``, with little state, and no files left behind."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerscope import streaming
from ledgerscope.checks import queries
from ledgerscope.session import shuffles_removed
from ledgerscope.sources.numbered_lines import delivered_lines, stream_lines
from ledgerscope.streaming.places import BITS

SCHEMA = "client string, file string, place bigint, text string"
KEYS = ["client", "file", "place"]


def test_same_keys_as_with_one_state_row_each(spark, tmp_path):
    """Several runs; keys repeat within a batch and between batches, out of order, across stretches, and are null."""
    rng = random.Random(5)
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    near = [0, 1, 2, 700, (1 << BITS) - 1, 1 << BITS, (1 << BITS) + 1, 5 << 40, -1, -(1 << BITS), None]
    sent = set()
    for run in range(3):
        rows = [
            (rng.choice(["a", None, ""]), rng.choice(["x", "x", "y", None]), rng.choice([rng.choice(near), rng.randrange(3000)]), f"{run} {i}")
            for i in range(1500)
        ]
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(into)
        before, sent = sent, sent | {row[:3] for row in rows}
        stream = spark.readStream.schema(SCHEMA).parquet(into)
        got = streaming.run_appending(streaming.drop_seen(stream, KEYS, place="place"), "once", out)
        found = [tuple(row) for row in got.collect()]
        assert got.columns == stream.columns
        assert len(found) == len(sent) and {row[:3] for row in found} == sent
        assert {row[:3] for row in found if row[3].startswith(f"{run} ")} == sent - before
    assert {tuple(row) for row in got.collect()} <= {tuple(row) for row in spark.read.parquet(into).collect()}


def test_place_alone(spark, tmp_path):
    into = str(tmp_path / "in")
    spark.createDataFrame([(5, "a"), (5, "b"), (6, "c")], "place int, text string").coalesce(1).write.parquet(into)
    stream = spark.readStream.schema("place int, text string").parquet(into)
    got = streaming.run_appending(streaming.drop_seen(stream, ["place"], place="place"), "alone").collect()
    assert sorted(row["place"] for row in got) == [5, 6]
    with pytest.raises(ValueError, match="one of the keys"):
        streaming.drop_seen(stream, ["text"], place="place")


def test_state_has_a_row_per_stretch(spark, tmp_path):
    """With one row per line, state and shuffle grew with the lines and the length of their file's name."""
    into, out = tmp_path / "in", tmp_path / "out"
    into.mkdir()
    for name in ("a.csv", "b.csv"):
        (into / name).write_text("head\n" + "".join(f"line {i} of {name}\n" for i in range(5_000)))
    once, again = (delivered_lines(stream_lines(spark, str(into))) for _ in range(2))
    kept = streaming.drop_seen(once.unionByName(again), ["file", "line_start"], place="line_start")
    got = streaming.run_appending(kept, "lines", str(out))
    assert got.count() == got.distinct().count() == 10_000
    assert spark.read.format("statestore").load(str(out / "checkpoint")).count() == 2


def _transactions(spark, sf):
    return spark.range(4_000).select(
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.lit("001").alias("from_bank"),
        F.col("id").cast("string").alias("from_account"),
        F.lit("002").alias("to_bank"),
        F.lit("7").alias("to_account"),
        (F.col("id") / 8).alias("amount"),
        F.lit("Euro").alias("currency"),
        F.lit("Wire").alias("payment_format"),
    )


def test_query_leaves_no_files_that_are_done_with(spark, tmp_path, monkeypatch):
    """Delivered files and shuffles of both deliveries lay on disk until the end, and state had a row per line."""
    monkeypatch.setattr(queries, "_tx", _transactions)
    monkeypatch.setattr(queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    got = queries.stream_scan_numbered(spark, "")
    want = _transactions(spark, "")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert not [p for p in Path(tmp_path / "numbered-csv").rglob("*.csv")]
    files = spark.read.parquet(str(tmp_path / "numbered" / "table")).select(F.substring_index("message_id", ":", 1)).distinct().count()
    assert spark.read.format("statestore").load(str(tmp_path / "numbered" / "checkpoint")).count() <= 2 * files


def test_setting_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with shuffles_removed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
