"""Comparison by fingerprints against the comparison of all rows."""

from __future__ import annotations

import random

import pytest

from ledgerscope.fingerprints import changed_buckets, fingerprints, quick_multiset_diff
from ledgerscope.sinks import multiset_diff

SCHEMA = "name string, bucket int, amount double"


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())  # as text, as no NaN equals another


def table(spark, values, partitions=3):
    return spark.createDataFrame(values, SCHEMA).repartition(partitions)


def random_rows(rng, number):
    values = [None, "", "a", "b", "ä"]
    amounts = [None, 0.0, -0.0, float("nan"), 1.5, 1e300]
    return [(rng.choice(values), rng.choice([None, 0, 1, 2]), rng.choice(amounts)) for _ in range(number)]


@pytest.mark.parametrize("seed", range(4))
def test_planted_differences_are_all_found(spark, seed):
    rng = random.Random(seed)
    base = random_rows(rng, 200)
    other = base[rng.randrange(5):] + random_rows(rng, rng.randrange(4)) + base[:rng.randrange(3)]
    rng.shuffle(other)
    a, b = table(spark, base), table(spark, other, 5)
    assert rows(quick_multiset_diff(a, b, buckets=16)) == rows(multiset_diff(a, b))


def test_equal_tables_do_not_depend_on_order_or_partitions(spark):
    base = random_rows(random.Random(9), 300)
    a, b = table(spark, base, 1), table(spark, base[::-1], 7)
    assert rows(fingerprints(a, buckets=32)) == rows(fingerprints(b, buckets=32))
    assert changed_buckets(fingerprints(a), fingerprints(b)).isEmpty()
    assert quick_multiset_diff(a, b).isEmpty()


def test_where_a_null_stands_and_how_often_a_row_repeats(spark):
    a = spark.createDataFrame([("x", None), (None, "y"), ("z", "z")], "p string, q string")
    b = spark.createDataFrame([(None, "x"), ("y", None), ("z", "z"), ("z", "z")], "p string, q string")
    assert rows(quick_multiset_diff(a, b)) == rows(multiset_diff(a, b))
    assert quick_multiset_diff(a, b).count() == 5


def test_empty_tables(spark):
    none, some = table(spark, []), table(spark, [("a", 1, 1.0)])
    assert quick_multiset_diff(none, none).isEmpty()
    assert rows(quick_multiset_diff(none, some)) == [repr(("a", 1, 1.0, -1))]
    assert rows(quick_multiset_diff(some, none)) == [repr(("a", 1, 1.0, 1))]


def test_only_rows_of_changed_buckets_are_shuffled(spark):
    a, b = spark.range(20_000), spark.range(20_000).where("id <> 77")
    diff = quick_multiset_diff(a, b)
    assert [tuple(r) for r in diff.collect()] == [(77, 1)]
    graph = diff._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in graph and "BroadcastExchange" in graph
