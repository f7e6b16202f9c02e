"""Scatter-gather over edges that arrive in batches, against brute force after every batch."""

from __future__ import annotations

import random
import shutil
from dataclasses import replace

import pytest
from bank_files import brute_pairs
from test_scatter_gather import GRAPHS, SCHEMA

from ledgerscope import RiskParams
from ledgerscope.operators import graph
from ledgerscope.streaming import GrowingGraph, growing_scatter_gather

BATCHES = 3
BY = ["client_id"]


def dealt(seed: int) -> list[dict[str, list[tuple[str, str]]]]:
    """The edges of all graphs, dealt out to batches; some edges come again in a later one."""
    rng = random.Random(seed)
    batches: list[dict[str, list]] = [{} for _ in range(BATCHES)]
    for name, pairs in GRAPHS.items():
        for pair in pairs:
            at = rng.randrange(BATCHES)
            batches[at].setdefault(name, []).append(pair)
            if rng.random() < 0.2:
                batches[rng.randrange(BATCHES)].setdefault(name, []).append(pair)
    return batches


def frame(spark, edges: dict[str, list[tuple[str, str]]]):
    rows = [(name, a[-1:], a, b[-1:], b) for name, pairs in edges.items() for a, b in pairs]
    return graph.distinct_edges(spark.createDataFrame(rows, SCHEMA), BY)


def by_client(df) -> dict[str, list[str]]:
    got: dict[str, list[str]] = {}
    for row in df.collect():
        got.setdefault(row["client_id"], []).append(row["account"])
    return {name: sorted(accounts) for name, accounts in got.items()}


@pytest.mark.parametrize("hub_paths", [None, 60])
def test_random_graphs_after_every_batch(spark, tmp_path, hub_paths):
    """75 graphs side by side. With a limit the first hubs come in a later batch, and the state goes on without counts."""
    params = replace(RiskParams(), min_intermediaries=3, hub_paths=hub_paths)
    state = GrowingGraph(spark, str(tmp_path / "state"), params, BY, buckets=2)
    so_far: dict[str, list] = {}
    for number, edges in enumerate(dealt(3)):
        state.add(frame(spark, edges), number)
        if number == 1 and hub_paths is None:  # a batch repeated after a failure counts once
            state.add(frame(spark, edges), number)
        for name, pairs in edges.items():
            so_far.setdefault(name, []).extend(pairs)
        expected = {n: sorted({e for p in brute_pairs(list(dict.fromkeys(pairs)), 3) for e in p}) for n, pairs in so_far.items()}
        assert by_client(state.accounts()) == {n: a for n, a in expected.items() if a}, number
    assert state.read("hubs").isEmpty() == (hub_paths is None)


def test_a_batch_reads_what_it_touches(spark, tmp_path):
    params = replace(RiskParams(), min_intermediaries=2, hub_paths=None)
    state = GrowingGraph(spark, str(tmp_path / "state"), params, BY, buckets=256)
    rng = random.Random(8)
    many = {"large": [(f"a{rng.randrange(400)}", f"a{rng.randrange(400)}") for _ in range(6_000)]}
    few = {"small": [("s", "m1"), ("s", "m2"), ("m1", "t"), ("m2", "t")]}
    state.add(frame(spark, many), 0)
    stored = {name: state.read(name).count() for name in ("out_edges", "degrees", "first", "second", "pairs", "found")}
    scanned: dict[str, int] = {}
    touched = state.touched

    def counting(name, keys, before):
        key = state.tables[name][0]
        parts = [r[0] for r in keys.select(state._bucket(key)).distinct().collect()]
        scanned[name] = scanned.get(name, 0) + state.read(name, before).where(state._bucket(key).isin(parts)).count()
        return touched(name, keys, before)

    state.touched = counting
    state.add(frame(spark, few), 1)
    assert by_client(state.accounts())["small"] == ["s", "t"]
    for name, rows in stored.items():
        assert scanned[name] <= 0.1 * rows, (name, scanned[name], rows)


def test_stream_resumes(spark, tmp_path):
    params = replace(RiskParams(), min_intermediaries=3)
    columns = "client_id string, from_bank string, from_account string, to_bank string, to_account string, currency string, ts timestamp_ntz, amount double, payment_format string"
    source = tmp_path / "files"
    source.mkdir()
    batches = dealt(5)
    so_far: dict[str, list] = {}

    def run():
        stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(source))
        return by_client(growing_scatter_gather(stream, params, BY, str(tmp_path / "kept"), buckets=2))

    for number, new in enumerate(((0, 1), (2,))):
        for i in new:
            rows = [(n, a[-1:], a, b[-1:], b) for n, pairs in batches[i].items() for a, b in pairs]
            part = spark.createDataFrame(rows, SCHEMA).selectExpr(
                "*", "'US Dollar' as currency", "timestamp_ntz'2022-09-02 10:00:00' as ts", "1.0D as amount", "'Wire' as payment_format"
            )
            part.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
            (file,) = (tmp_path / f"part{i}").glob("part-*.parquet")
            shutil.copy(file, source / f"{i}.parquet")
            for name, pairs in batches[i].items():
                so_far.setdefault(name, []).extend(pairs)
        expected = {n: sorted({e for p in brute_pairs(list(dict.fromkeys(pairs)), 3) for e in p}) for n, pairs in so_far.items()}
        assert run() == {n: a for n, a in expected.items() if a}
    assert run() == {n: a for n, a in expected.items() if a}
