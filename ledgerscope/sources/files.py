"""Bank CSV files: a header line, one record per line, blank lines skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerscope.schemas import RAW_ACCOUNT, RAW_TRANSACTION

# Quotes are doubled inside quoted text; a field may hold the separator.
# A line with too few or too many fields is kept whole in BAD_LINE.
BAD_LINE = "bad_line"
CSV_OPTIONS = {
    "header": "true",
    "enforceSchema": "true",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": BAD_LINE,
    "columnPruning": "false",  # fields are counted only if all are parsed
}


def with_bad_line(schema: StructType) -> StructType:
    """The schema to read CSV with: all fields as given, and the text of a line that does not fit."""
    return StructType([*schema, StructField(BAD_LINE, StringType())])


def empty_as_text(raw: DataFrame) -> DataFrame:
    """A field without characters is an empty text and not a null, as every field of a line has a value."""
    texts = [F.coalesce(F.col(f.name), F.lit("")).alias(f.name) for f in raw.schema if f.name != BAD_LINE]
    # As an expression: a filter on the bare column would go into the scan, which tests it too early.
    # With no characters of another column: Spark refuses to read this column alone, as a count would.
    nothing = F.substring(raw.columns[0], 1, 0)
    bad = F.nullif(F.coalesce(BAD_LINE, nothing, F.lit("")), F.lit("")).alias(BAD_LINE)
    return raw.select(*texts, bad)


def _read(spark: SparkSession, path: str | list[str], schema: StructType, header: bool) -> DataFrame:
    options = {**CSV_OPTIONS, "header": str(header).lower()}
    return empty_as_text(spark.read.schema(with_bad_line(schema)).options(**options).csv(path))


def read_transactions(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """Transactions as text columns, in the order of the file; nothing is inferred.

    ``bad_line`` has the text of a line that has not eleven fields, and is null otherwise.
    """
    return _read(spark, path, RAW_TRANSACTION, header)


def read_accounts(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """Accounts as text columns, and ``bad_line`` as with transactions."""
    return _read(spark, path, RAW_ACCOUNT, header)
