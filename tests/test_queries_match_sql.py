"""Every registered query against its SQL twin, on whole tables."""

from __future__ import annotations

import pytest
from compare import duck, spark_rows, spark_types, sql_rows, sql_types

from ledgerscope.checks.oracle import ORACLE
from ledgerscope.checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    result = QUERIES[name](spark, SF)
    assert spark_types(result) == sql_types(connection, ORACLE[name])
    columns, rows = spark_rows(result)
    expected_columns, expected = sql_rows(connection, ORACLE[name])
    assert columns == expected_columns
    assert rows == expected


@pytest.mark.parametrize(
    ("name", "rows"), [("q1_low_usd", 635), ("q3_anomaly_join", 27), ("stable_shard", 150)]
)
def test_row_counts(spark, name, rows):
    assert QUERIES[name](spark, SF).count() == rows


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 26
    assert set(QUERIES) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())
