"""Outputs, and the comparison of an output with what is expected."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions import float_text

# Text as the expected files have it: quotes only where needed, doubled inside.
_CSV_OPTIONS = {
    "header": "false",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _text_columns(rows: DataFrame) -> list[Column]:
    return [
        float_text(f.name).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in rows.schema
        if f.name != "client_id"
    ]


def query_csv_path(out_dir: str, query_id: int, client_name: str) -> str:
    return f"{out_dir}/q{query_id}_client_{client_name}.csv"


def write_query_csv(rows: DataFrame, query_id: int, client_name: str, out_dir: str) -> str:
    """Write one result as headerless CSV; the path is a folder of part files."""
    path = query_csv_path(out_dir, query_id, client_name)
    writer = rows.select(*_text_columns(rows)).write.mode("overwrite").options(**_CSV_OPTIONS)
    writer.option("lineSep", "\r\n").csv(path)
    return path


def csv_lines(rows: DataFrame) -> DataFrame:
    """Rows as CSV text in the column ``line``, with ``client_id`` if there is one."""
    line = F.to_csv(F.struct(*_text_columns(rows)), _CSV_OPTIONS).alias("line")
    return rows.select(*[c for c in rows.columns if c == "client_id"], line)


def write_by_client(results: Mapping[int, DataFrame], out_dir: str) -> str:
    """Write results of several queries and clients in one job, a folder for each.

    Every result has a ``client_id``. The rebalance hint keeps the number of
    files near the number of (client, query) pairs and splits a large one.
    """
    lines = [
        csv_lines(rows).withColumn("query_id", F.lit(query_id))
        for query_id, rows in results.items()
    ]
    parts = ["client_id", "query_id"]
    everything = reduce(DataFrame.unionByName, lines)
    everything.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts).text(out_dir)
    return out_dir


def multiset_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows whose number differs, order ignored; no rows mean that both are equal.

    ``surplus`` is positive for rows there are too many of and negative for
    missing ones. Both tables are read once and meet in one shuffle.
    """
    columns = expected.columns
    signed = actual.select(*columns, F.lit(1).alias("sign")).unionByName(
        expected.select(*columns, F.lit(-1).alias("sign"))
    )
    return (
        signed.groupBy(*columns).agg(F.sum("sign").alias("surplus")).where(F.col("surplus") != 0)
    )


def read_by_client(spark: SparkSession, out_dir: str) -> DataFrame:
    """Lines of a folder that ``write_by_client`` wrote: ``client_id, query_id, line``."""
    rows = spark.read.schema("line string, client_id string, query_id int").text(out_dir)
    return rows.select("client_id", "query_id", "line")


def verify_by_client(spark: SparkSession, out_dir: str, expected_dir: str) -> DataFrame:
    """What differs between two result folders, per client and query; no rows mean that all agree.

    ``missing`` and ``surplus`` count lines, order ignored. A client or query that only one folder has
    differs in all its lines.
    """
    diff = multiset_diff(read_by_client(spark, out_dir), read_by_client(spark, expected_dir))
    return diff.groupBy("client_id", "query_id").agg(
        F.sum(F.greatest(-F.col("surplus"), F.lit(0))).alias("missing"),
        F.sum(F.greatest(F.col("surplus"), F.lit(0))).alias("surplus"),
    )
