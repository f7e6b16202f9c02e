"""Scatter-gather against brute force. One client per random graph: all run together."""

from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import replace

import pytest
from bank_files import brute_counts, brute_pairs, scatter_gather_edges

from ledgerscope import RiskParams
from ledgerscope.operators import graph

SCHEMA = (
    "client_id string, from_bank string, from_account string, to_bank string, to_account string"
)


def graphs() -> dict[str, list[tuple[str, str]]]:
    rng = random.Random(17)
    made = {"fixture": scatter_gather_edges()}
    for number in range(40):  # even graphs of all densities
        size = rng.randrange(4, 16)
        made[f"even-{number}"] = [
            (str(rng.randrange(size)), str(rng.randrange(size)))
            for _ in range(rng.randrange(5, 110))
        ]
    for number in range(30):  # a few hubs with most of the edges
        hubs = [f"h{i}" for i in range(rng.randrange(1, 9))]
        edges = []
        for _ in range(rng.randrange(40, 160)):
            hub, other = rng.choice(hubs), f"n{rng.randrange(20)}"
            if rng.random() < 0.8:
                edges.append((other, hub) if rng.random() < 0.5 else (hub, other))
            else:
                edges.append((other, f"n{rng.randrange(20)}"))
        made[f"hubs-{number}"] = edges
    for number in range(4):  # the same hubs around everybody
        hubs = [f"h{i}" for i in range(4 + number)]
        made[f"star-{number}"] = [(f"s{i}", h) for i in range(9) for h in hubs] + [
            (h, f"t{i}") for i in range(9) for h in hubs
        ]
    return made


GRAPHS = graphs()


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        (name, a[-1:], a, b[-1:], b) for name, pairs in GRAPHS.items() for a, b in pairs
    ]
    tx = spark.createDataFrame(rows, SCHEMA)
    return graph.distinct_edges(tx, ["client_id"]).repartition(4).cache()


def found_pairs(df):
    got = defaultdict(set)
    for row in df.collect():
        got[row["src"]["client_id"]].add((row["src"]["account"], row["dst"]["account"]))
    return got


def found_accounts(df):
    got = defaultdict(list)
    for row in df.collect():
        got[row["client_id"]].append(row["account"])
    return {name: sorted(accounts) for name, accounts in got.items()}


CASES = [
    (5, 1_000_000, True),
    (5, None, True),
    (5, None, False),
    (5, 0, True),
    (5, 9, True),
    (5, 9, False),
    (3, 4, True),
    (2, 0, True),
    (1, 9, True),
]


@pytest.mark.parametrize(("k", "hub_paths", "prune"), CASES)
def test_pairs(spark, edges, k, hub_paths, prune):
    params = replace(RiskParams(), min_intermediaries=k, hub_paths=hub_paths)
    df = graph.scatter_gather_pairs(edges, params, prune)
    assert df.count() == df.distinct().count()
    got = found_pairs(df)
    for name, pairs in GRAPHS.items():
        assert got[name] == brute_pairs(pairs, k), name


@pytest.mark.parametrize(("k", "hub_paths", "prune"), CASES)
def test_accounts(spark, edges, k, hub_paths, prune):
    params = replace(RiskParams(), min_intermediaries=k, hub_paths=hub_paths)
    got = found_accounts(graph.scatter_gather_nodes(edges, params, prune))
    for name, pairs in GRAPHS.items():
        expected = sorted({end for pair in brute_pairs(pairs, k) for end in pair})
        assert got.get(name, []) == expected, name


@pytest.mark.parametrize(("k", "hub_paths"), [(5, None), (5, 0), (3, 6), (2, 9), (1, 0)])
def test_counts(spark, edges, k, hub_paths):
    params = replace(RiskParams(), min_intermediaries=k, hub_paths=hub_paths)
    got = defaultdict(dict)
    for row in graph.scatter_gather_counts(edges, params).collect():
        pair = (row["src"]["account"], row["dst"]["account"])
        got[row["src"]["client_id"]][pair] = row["mids"]
    for name, pairs in GRAPHS.items():
        expected = {pair: mids for pair, mids in brute_counts(pairs).items() if mids >= k}
        assert got[name] == expected, name


def brute_paths(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    return {
        (a, m, b) for a, mids in out.items() for m in mids for b in out.get(m, ()) if a != b
    }


@pytest.mark.parametrize("hub_paths", [None, 0, 7, 1_000_000])
def test_paths(spark, edges, hub_paths):
    got = defaultdict(list)
    for row in graph.two_hop_paths(edges, 1, hub_paths).collect():
        path = tuple(row[end]["account"] for end in ("src", "mid", "dst"))
        got[row["src"]["client_id"]].append(path)
    for name, pairs in GRAPHS.items():
        assert sorted(got[name]) == sorted(brute_paths(pairs)), name


@pytest.mark.parametrize("hub_paths", [None, 0, 7, 1_000_000])
def test_paths_together(spark, edges, hub_paths, monkeypatch):
    monkeypatch.setattr(graph, "TASK_PATHS", 500)
    paths = graph.two_hop_paths(edges, 1, hub_paths, together=True)
    got = defaultdict(list)
    for row in paths.collect():
        path = tuple(row[end]["account"] for end in ("src", "mid", "dst"))
        got[row["src"]["client_id"]].append(path)
    for name, pairs in GRAPHS.items():
        assert sorted(got[name]) == sorted(brute_paths(pairs)), name


def test_paths_are_counted_where_they_come_out(spark, edges):
    """No path is shuffled by itself: lists of last accounts are, by the first account."""
    counts = graph.path_counts(graph.two_hop_paths(edges, 1, 7, together=True))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("explode(ends")]
    assert "HashAggregate" in after and "Exchange" not in after
    got = {(row["src"]["client_id"], row["src"]["account"], row["dst"]["account"]): row["mids"] for row in counts.collect()}
    assert got == {(name, *pair): mids for name, pairs in GRAPHS.items() for pair, mids in brute_counts(pairs).items()}


def test_paths_per_account(spark, edges):
    got = {
        (row["mid"]["client_id"], row["mid"]["account"]): row["paths"]
        for row in graph.paths_per_account(edges, 1).collect()
    }
    expected = defaultdict(int)
    for name, pairs in GRAPHS.items():
        for _, mid, _ in brute_paths(pairs):
            expected[name, mid] += 1
    assert got == expected


def test_fixture():
    assert {end for pair in brute_pairs(GRAPHS["fixture"], 5) for end in pair} == {
        "S", "G", "P", "Q",
    }


def test_degrees(spark, edges):
    into, out = defaultdict(set), defaultdict(set)
    for name, pairs in GRAPHS.items():
        for a, b in pairs:
            out[name, a].add(b)
            into[name, b].add(a)
    for row in graph.account_degrees(edges).collect():
        key = (row["node"]["client_id"], row["node"]["account"])
        assert (row["in_degree"], row["out_degree"]) == (len(into[key]), len(out[key]))


def test_no_list_of_hubs_goes_into_the_count_of_paths(spark, edges):
    """Paths are grouped by two numbers; the sketch drops a pair with too little in common before."""
    first = spark.createDataFrame([(1, m, 9.0, 9.0) for m in range(6)] + [(2, m, 9.0, 9.0) for m in range(4)], "src long, mid long, mid_in double, mid_out double")
    second = first.withColumnRenamed("src", "dst").selectExpr("mid", "dst + 10 as dst", "mid_in", "mid_out")
    first, second = graph._ranked(first, second, 5, 10)
    joined = graph._join_halves(graph._without_first(first, 5), graph._without_first(second, 5), 10)
    paths = joined.where(graph._may_share(5))
    assert {(row["src"], row["dst"]) for row in paths.collect()} == {(1, 11)}
    found = graph._found(joined, 5)
    assert found.dtypes == [("src", "bigint"), ("dst", "bigint"), ("kept", "bigint")]
    assert found.collect() == [(1, 11, 2)]
