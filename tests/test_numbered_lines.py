"""Lines with places: every split, several batches, repeated deliveries, restarts and files that grow."""

from __future__ import annotations

import random

import pytest
from bank_files import TRANSACTIONS

from ledgerscope import streaming
from ledgerscope.operators.projections import normalize_transactions
from ledgerscope.sources import read_transactions
from ledgerscope.sources.numbered_lines import WHOLE, delivered_lines, numbered_transactions, read_lines, stream_lines


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def places(data: bytes, header: bool):
    """Start and text of every line that is not blank, by plain Python."""
    found, at = [], 0
    for line in data.split(b"\n"):
        text = line.removesuffix(b"\r")
        if text and not (header and at == 0):
            found.append((at, text.decode("utf-8", "replace")))
        at += len(line) + 1
    return found


@pytest.mark.parametrize("split", [1, 2, 3, 7, 1 << 20])
def test_every_split_gives_each_line_once(spark, tmp_path, split):
    rng = random.Random(split)
    texts = {
        "empty.csv": b"",
        "header.csv": b"head\n",
        "blank.csv": b"\n\n\n",
        "open.csv": b"head\none\n\ntwo",
        "crlf.csv": b"head\r\n\xc3\xa4\r\n\r\nb\xff\r\n",
        "random.csv": bytes(rng.choice(b"ab\n\n\r,") for _ in range(60)),
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    (tmp_path / "_SUCCESS").write_bytes(b"x\n")
    (tmp_path / ".hidden").write_bytes(b"x\n")
    for header in (True, False):
        want = sorted((n, at, line) for n, text in texts.items() for at, line in places(text, header))
        assert rows(read_lines(spark, str(tmp_path), header, split=split)) == want


def test_blocks_are_joined(spark, tmp_path):
    lines = ["head", "x" * (3 << 20), "y", *(f"line {i}" for i in range(200_000)), "z" * (1 << 20)]
    (tmp_path / "long.csv").write_text("\n".join(lines))
    for split in (1 << 19, 64 << 20):
        found = read_lines(spark, str(tmp_path), split=split).selectExpr("line_start", "sha2(line, 256)", "length(line)")
        assert found.count() == found.distinct().count() == len(lines) - 1
        assert found.agg({"length(line)": "sum"}).first()[0] == sum(map(len, lines[1:]))


def test_transactions_equal_those_of_the_csv_reader(spark, tmp_path):
    more = '2022/09/01 00:00,1,"A, ""b""",2,,1,Euro,1,Euro,Wire\n2022/09/01 00:00,1,"A, ""b""",2,,1,Euro,1,Euro,Wire,0\n'
    (tmp_path / "a.csv").write_text(TRANSACTIONS + more)
    found = numbered_transactions(read_lines(spark, str(tmp_path), split=50)).drop("message_id")
    expected = read_transactions(spark, str(tmp_path))
    assert found.columns == expected.columns
    key = [f"coalesce({c}, '-') as {c}" for c in expected.columns]
    assert rows(found.selectExpr(*key)) == rows(expected.selectExpr(*key))


def test_batches_repeats_and_restart(spark, tmp_path):
    into, out = tmp_path / "in", str(tmp_path / "out")
    into.mkdir()
    header, *lines = TRANSACTIONS.replace("\n\n", "\n").splitlines()

    def deliver(name, part):
        (into / name).write_text("\n".join([header, *part]) + "\n")

    def run():
        raw = numbered_transactions(stream_lines(spark, str(into), split=100), r"([^/.]+)[^/]*$")
        return rows(streaming.run_appending(streaming.drop_seen(raw, ["message_id"]), "numbered", out))

    assert run() == []
    deliver("first.csv", lines[:3])
    once = run()
    assert len(once) == 3 and run() == once
    deliver("first.again.csv", lines[:3])
    deliver("second.csv", lines[3:])
    twice = run()
    assert set(once) < set(twice) and len(twice) == len(lines)
    (into / "first.csv").unlink()  # done, moved away
    assert run() == twice
    deliver("first.csv", lines[:3])  # and delivered once more
    assert run() == twice
    (tmp_path / "all").mkdir()
    (tmp_path / "all" / "t.csv").write_text(TRANSACTIONS)
    typed = normalize_transactions(spark.read.parquet(f"{out}/table").drop("message_id"))
    assert rows(typed) == rows(normalize_transactions(read_transactions(spark, str(tmp_path / "all"))))
    # Without the memory of ids, a second stream from the start gives the same ids.
    again = numbered_transactions(read_lines(spark, str(into)), r"([^/.]+)[^/]*$")
    assert {r["message_id"] for r in again.collect()} == {row[0] for row in twice}


def test_growing_file(spark, tmp_path):
    into, out = tmp_path / "in", str(tmp_path / "out")
    into.mkdir()

    def run():
        return rows(streaming.run_appending(stream_lines(spark, str(into), growing=True, split=5), "growing", out))

    file = into / "a.csv"
    file.write_text("head\none\ntw")
    assert run() == [("a.csv", 5, "one")]
    with file.open("a") as more:
        more.write("o\nthree\nfo")
    assert run() == [("a.csv", 5, "one"), ("a.csv", 9, "two"), ("a.csv", 13, "three")]
    file.write_text("head\n")
    with pytest.raises(Exception, match="rewritten"):
        run()


def test_small_ranges_share_tasks(spark, tmp_path):
    """One task per range took most of its time to start."""
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("head\n" + "".join(f"line {i} of {name}\n" for i in range(5_000)))
    found, whole = read_lines(spark, str(tmp_path), split=100), read_lines(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 5 * spark.sparkContext.defaultParallelism
    assert rows(found) == rows(whole) and found.count() == 10_000


def test_lines_kept_once_before_they_are_parsed(spark, tmp_path):
    delivery, (header, *lines) = r"(.*)\.[0-9]+$", TRANSACTIONS.replace("\n\n", "\n").splitlines()
    into, out = tmp_path / "in", str(tmp_path / "out")
    for name in ("x/a.csv.1", "x/a.csv.2", "y/a.csv.1"):
        (into / name).parent.mkdir(parents=True, exist_ok=True)
        (into / name).write_text("\n".join([header, *lines]) + "\n")
        once = streaming.drop_seen(delivered_lines(stream_lines(spark, str(into), split=50), delivery), ["file", "line_start"])
        got = rows(streaming.run_appending(numbered_transactions(once, WHOLE), "once", out))
    parsed_first = numbered_transactions(read_lines(spark, str(into)), delivery)
    key = [f"coalesce({c}, '-') as {c}" for c in parsed_first.columns]
    again = spark.read.parquet(f"{out}/table").selectExpr(*key)
    assert rows(again) == rows(parsed_first.dropDuplicates(["message_id"]).selectExpr(*key))
    assert len(got) == 2 * len(lines)
