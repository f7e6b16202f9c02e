"""Comparison of a Spark result with the SQL twin run by DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    return sorted(df.columns), multiset(df.columns, df.collect())


def sql_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), multiset(columns, cursor.fetchall())


# Spark type names as DuckDB calls them.
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def spark_types(df: DataFrame) -> dict[str, str]:
    return {name: TYPES[kind] for name, kind in df.dtypes}


def sql_types(connection: duckdb.DuckDBPyConnection, sql: str) -> dict[str, str]:
    return {row[0]: str(row[1]) for row in connection.execute(f"describe {sql}").fetchall()}
