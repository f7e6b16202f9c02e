"""File streams of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerscope.schemas import RAW_TRANSACTION
from ledgerscope.sources.files import CSV_OPTIONS, empty_as_text, with_bad_line


def stream_transactions(
    spark: SparkSession,
    path: str,
    schema: StructType = RAW_TRANSACTION,
    fmt: str = "csv",
    max_files: int | None = None,
) -> DataFrame:
    """A folder (or glob) of files as a stream, ``max_files`` new files per batch.

    CSV is read as by ``read_transactions``, with ``bad_line``.
    """
    csv = fmt == "csv"
    reader = spark.readStream.schema(with_bad_line(schema) if csv else schema)
    if csv:
        reader = reader.options(**CSV_OPTIONS)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.format(fmt).load(path)
    return empty_as_text(rows) if csv else rows
