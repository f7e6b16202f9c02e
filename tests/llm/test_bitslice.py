"""Bit-sliced search against plain inner products."""

from __future__ import annotations

import math

import numpy as np

from ledgerscope.llm.bitslice import Block, SearchParams, ordered_bytes, top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k=5):
    def numbers(v):
        return [math.floor(256 * float(np.float32(x))) for x in v]

    fine = [(i, numbers(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if asked(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in fine if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_bitmaps_add_up():
    rng = np.random.default_rng(1)
    block = Block(np.arange(200), rng.integers(-300, 300, (200, 7)))
    weights = rng.integers(-200, 200, 7)
    total = np.zeros(200, np.int64)
    for place, bitmap in enumerate(block.summed(weights)):
        total += np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:200].astype(np.int64) << place
    exact = block.values @ weights
    assert len(set((exact - total).tolist())) == 1


def test_random_rows_with_ties(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=(400, 6)), 1)
    values[100:250] = values[100]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(400), values, strict=True)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for params in (SearchParams(), SearchParams(block_rows=64, chunk_queries=3, group_queries=8)):
        got = sorted(map(tuple, top_k(frame, frame.where("vec_id % 7 = 0"), params).collect()))
        assert got == brute(rows, lambda i: i % 7 == 0)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (None, [1.0, 1.0]),
        (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, [3.0]), (7, []), (8, [-1.0, 0.001]), (50, [0.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", score int")
    got = sorted(map(tuple, top_k(frame, frame.where("vec_id % 50 = 0")).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0)
    assert top_k(frame.limit(0), frame).count() == 0
    assert top_k(frame, frame.limit(0)).count() == 0


def test_components_of_any_size(spark):
    rng = np.random.default_rng(6)
    sizes = [0.5, 9e6, 65_536.0, 8_388_608.0, 1e18, 3e37]
    rows = [(int(i), [float(np.float32(rng.choice([-1, 1]) * rng.choice(sizes) * (1 + rng.random()))) for _ in range(3)]) for i in range(120)]
    rows += [(200, [9e6, 1.0]), (201, [0.25, 0.5, 0.0]), (201, [9e6]), (210, [0.5])]
    frame = spark.createDataFrame(rows, SCHEMA)
    least, most = -(2**63), 2**63 - 1
    for params in (SearchParams(), SearchParams(block_rows=16, chunk_queries=3, group_queries=5, wide_rows=7)):
        got = sorted(map(tuple, top_k(frame, frame.where("vec_id % 10 = 0"), params).collect()))
        wanted = [(q, r, i, min(max(s, least), most)) for q, r, i, s in brute(rows, lambda i: i % 10 == 0)]
        assert got == sorted(wanted)
    double = spark.createDataFrame([(0, [1e300, -2.0]), (1, [1e308, 3.0]), (2, [-1e308, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = [r.vec_id for r in top_k(double, double.where("vec_id = 0")).orderBy("rank").collect()]
    assert found == [1, 3, 2]


def test_bytes_sort_as_numbers_do():
    rng = np.random.default_rng(7)
    numbers = [int(x) ** int(p) * int(s) for x, p, s in zip(rng.integers(0, 2**40, 500), rng.integers(0, 9, 500), rng.choice([-1, 1], 500), strict=True)]
    numbers += [0, 1, -1, 255, 256, -255, -256]
    assert sorted(numbers) == sorted(numbers, key=ordered_bytes)


def test_repeated_queries_have_their_own_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 12)] + [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    for params in (SearchParams(), SearchParams(block_rows=4, chunk_queries=1, group_queries=1)):
        got = sorted(map(tuple, top_k(frame, frame.where("vec_id = 50"), params).collect()))
        assert got == brute(rows, lambda i: i == 50) and len(got) == 15
