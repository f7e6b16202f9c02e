"""Exact sums against Python's ``math.fsum``, bit by bit."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.exact_sums import exact_sums

SCHEMA = "key int, x double"


def bits(value):
    return None if value is None else struct.pack("<d", value)


def got(spark, rows, partitions=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return {r["key"]: (bits(r["total"]), r["number"]) for r in exact_sums(df, ["key"], "x").collect()}


def expected(rows):
    groups = {}
    for key, x in rows:
        groups.setdefault(key, []).append(x)
    return {
        key: (bits(math.fsum(xs) + 0.0), len(xs)) for key, xs in groups.items()
    }


def random_double(rng, low, high):
    return rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.uniform(low, high)


@pytest.mark.parametrize("low, high", [(-300, 300), (-3, 12), (-323, -300), (290, 300), (-20, 20)])
def test_random_groups(spark, low, high):
    rng = random.Random(low * 1000 + high)
    rows = [(key, random_double(rng, low, high)) for key in range(150) for _ in range(rng.randint(1, 40))]
    # Numbers that cancel leave what is far below them.
    rows += [(key, -x) for key, x in rows if rng.random() < 0.4]
    rng.shuffle(rows)
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_partitions_do_not_matter(spark, partitions):
    rng = random.Random(5)
    rows = [(i % 3, random_double(rng, -300, 300) if i % 2 else round(rng.random() * 1e5, 2)) for i in range(5000)]
    assert got(spark, rows, partitions) == expected(rows)


def test_halfway_and_boundaries(spark):
    tiny = 5e-324
    cases = [
        [1.0, 2.0**-53],  # halfway: to even, down
        [1.0 + 2.0**-52, 2.0**-53],  # halfway: to even, up
        [1.0, 2.0**-53, tiny],  # just above halfway
        [1.0, 2.0**-53, -tiny],  # just below
        [-1.0, -(2.0**-53), -tiny],
        [tiny] * 3,
        [2.0**-1022, -tiny],
        [1.7976931348623157e308, -1.7976931348623157e308, tiny],
        [1.7976931348623157e308],
        [-tiny],
        [0.1] * 10,
        [0.0, -0.0],
        [1e16, 1.0, 1e-16],
        [1e308, 1e308, -1e308],
    ]
    cases += [[2.0**e, -(2.0 ** (e - 53))] for e in range(-1000, 1023, 7)]
    rows = [(key, x) for key, xs in enumerate(cases) for x in xs]
    # Python refuses the last of the hand-made ones on the way, although the sum is a double.
    want = expected([(k, x) for k, x in rows if k != 13]) | {13: (bits(1e308), 3)}
    assert got(spark, rows) == want


def test_special_values(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, nan), (0, 1.0), (1, inf), (1, 2.0), (2, -inf), (2, None), (3, inf), (3, -inf), (4, None)]
    rows += [(5, 1.7e308), (5, 1.7e308), (None, 3.0), (None, None)]
    result = exact_sums(spark.createDataFrame(rows, SCHEMA), ["key"], "x")
    found = {r["key"]: (r["total"], r["number"]) for r in result.collect()}
    assert math.isnan(found[0][0]) and math.isnan(found[3][0])
    assert found[1] == (inf, 2) and found[2] == (-inf, 1)
    assert found[4] == (None, 0) and found[5] == (inf, 2) and found[None] == (3.0, 1)


def test_no_keys_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_sums(empty, ["key"], "x").collect() == []
    assert [tuple(r) for r in exact_sums(empty, [], "x").collect()] == [(None, 0)]
    odd = spark.createDataFrame([(1, 0.1, 2, 3)], "place int, total double, key_0 int, number int")
    result = exact_sums(odd, ["place", "number"], "total")
    assert [tuple(r) for r in result.select("place", "total").collect()] == [(1, 0.1)]


def test_many_rows_of_one_key_are_summed_before_the_shuffle(spark):
    df = spark.range(200_000).select((F.col("id") % 2).cast("int").alias("key"), (F.col("id") * 0.01).alias("x"))
    found = {r["key"]: r["total"] for r in exact_sums(df, ["key"], "x").collect()}
    for key in (0, 1):
        assert found[key] == math.fsum(i * 0.01 for i in range(key, 200_000, 2))
