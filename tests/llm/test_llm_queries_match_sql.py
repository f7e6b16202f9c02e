"""Queries of the subpackage that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from compare import duck, spark_rows, sql_rows

from ledgerscope.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows(spark, name, sf):
    path = f"/root/testdata/{sf}"
    assert spark_rows(QUERIES[name](spark, path)) == sql_rows(duck(path), ORACLE[name])


def test_every_twin_is_sql():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
