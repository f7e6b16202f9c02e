from __future__ import annotations

import hashlib
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from ledgerscope import functions as fn


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def cent_borders() -> list[float]:
    rng = random.Random(7)
    values = [0.995, 1.005, 0.125, 0.375, 2.675, 1.115, -0.995, -0.125, 0.0, 5e-324]
    for _ in range(3000):
        border = (rng.randrange(10 ** rng.randrange(1, 13)) + 0.5) / 100.0
        values += [border, math.nextafter(border, math.inf), math.nextafter(border, -math.inf)]
        values.append(rng.uniform(-1e6, 1e6))
    return values


def test_round_cents_is_the_exact_binary_rounding(spark):
    values = cent_borders()
    assert column(spark, values, "double", fn.round_cents("v")) == [round(v, 2) for v in values]


@pytest.mark.parametrize("threshold", [1.0, 0.5, 1.13, 1.38, 50.0, 0.01, 1.004, 1234.56])
def test_low_amount_bound(threshold):
    bound = fn.low_amount_bound(threshold)
    assert round(bound, 2) < threshold
    assert not round(math.nextafter(bound, math.inf), 2) < threshold


def test_low_amount_bound_of_one():
    assert fn.low_amount_bound(1.0) == 0.995


def test_float_text(spark):
    rng = random.Random(3)
    values = [50.0, 12345678.9, 0.0, -0.0, 0.0001, 1e-5, 1.5e-7, 1e16, 3e20, 9999999.5, -3.25]
    values += [round(rng.uniform(0, 10 ** rng.randrange(1, 11)), 2) for _ in range(2000)]
    values += [math.inf, -math.inf, math.nan]
    assert column(spark, values, "double", fn.float_text("v")) == [repr(v) for v in values]


def test_stable_shard(spark):
    keys = [f"{i:03d}.{i * 7919}" for i in range(500)]
    for shards in (1, 3, 7, 2**31 - 1):
        expected = [int(hashlib.md5(k.encode()).hexdigest(), 16) % shards for k in keys]
        assert column(spark, keys, "string", fn.stable_shard("v", shards)) == expected


def test_bank_id(spark):
    ids = ["010", "10", "0", "000", " 7 ", "00123"]
    assert column(spark, ids, "string", fn.normalize_bank_id("v")) == [str(int(v)) for v in ids]
    assert column(spark, ["x1"], "string", fn.normalize_bank_id("v", strict=False)) == [None]


def test_format_key(spark):
    texts = [" ACH\t", "ach", "\nCredit Card "]
    assert column(spark, texts, "string", fn.format_key("v")) == [t.strip().lower() for t in texts]


def test_currency_iso(spark):
    names = ["Euro", "YEN", "US Dollar", "uk pound", "none"]
    assert column(spark, names, "string", fn.currency_iso("v")) == ["EUR", "JPY", None, "GBP", None]


def test_value_uses_the_reciprocal(spark):
    rng = random.Random(11)
    pairs = [(rng.uniform(0, 1000), rng.uniform(0.1, 200)) for _ in range(2000)]
    rows = [(i, a, r) for i, (a, r) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a double, r double")
    got = df.select("i", fn.usd_value("a", F.col("r")).alias("x")).orderBy("i").collect()
    bits = [struct.pack("d", r["x"]) for r in got]
    assert bits == [struct.pack("d", a * (1.0 / r)) for a, r in pairs]


def test_parse_ts(spark):
    from datetime import datetime

    got = column(spark, ["2022/09/05 23:59"], "string", fn.parse_ts("v"))
    assert got == [datetime(2022, 9, 5, 23, 59)]
    bad = column(spark, ["2022-09-05", "x"], "string", fn.parse_ts("v", strict=False))
    assert bad == [None, None]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from ledgerscope.session import shared_dir

    def session(master, named):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: named),
            sparkContext=SimpleNamespace(master=master, applicationId="app"),
        )

    assert shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn", None))
    local = session("local[2]", None)
    assert shared_dir(local) == shared_dir(local)
