"""Comparison of two tables by sums of row hashes first, and by rows only where the sums differ.

A row goes to a bucket by one hash, and a bucket has the number of its rows and the sums of two more hashes, which do not
depend on the order of rows. Every task sends at most one row per bucket; rows are shuffled only if their bucket
differs. Two unequal buckets have equal sums by accident with a probability of about 2^-128; the hashes
are not made to withstand someone who chooses rows to that end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.session import land
from ledgerscope.sinks import multiset_diff

BUCKETS = 4096


def _hash(columns: Sequence[str], seed: int) -> Column:
    # Hashes pass over nulls, so where the nulls stand is hashed too.
    return F.xxhash64(F.lit(seed), *columns, *[F.isnull(c) for c in columns])


def _bucket(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(_hash(columns, 0), F.lit(buckets)).cast("int")


def fingerprints(rows: DataFrame, columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n_rows, sum_1, sum_2`` for each bucket that has rows.

    They can be stored beside a table, and then be compared without reading it. Null is not an empty text; as when
    grouping, -0.0 is 0.0 and all NaN are one. Maps cannot be hashed.
    """
    columns = list(columns or rows.columns)
    # As decimals the sums have room for any number of rows.
    sums = [F.sum(_hash(columns, seed).cast("decimal(20,0)")).alias(f"sum_{seed}") for seed in (1, 2)]
    return rows.groupBy(_bucket(columns, buckets).alias("bucket")).agg(F.count("*").alias("n_rows"), *sums)


def changed_buckets(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """The ``bucket`` of all fingerprints that only one side has or that differ."""
    both = actual.select(F.lit(1).alias("side"), "*").unionByName(expected.select(F.lit(2).alias("side"), "*"))
    values = F.struct("n_rows", "sum_1", "sum_2")
    return (
        both.groupBy("bucket")
        .agg(F.count("*").alias("sides"), F.min(values).alias("low"), F.max(values).alias("high"))
        .where("sides < 2 or low <> high")
        .select("bucket")
    )


def quick_multiset_diff(actual: DataFrame, expected: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``multiset_diff``. Equal tables are read once and none of their rows is shuffled.

    ``buckets`` bounds the table of changed buckets, which is broadcast. Unequal tables are read a second time.
    """
    columns = expected.columns
    changed = land(
        changed_buckets(fingerprints(actual, columns, buckets), fingerprints(expected, columns, buckets)),
        "changed-buckets",
    )
    if changed.isEmpty():
        return multiset_diff(actual.limit(0), expected.limit(0))

    def suspects(rows: DataFrame) -> DataFrame:
        bucket = _bucket(columns, buckets)
        placed = rows.select(F.struct(*columns).alias("row"), bucket.alias("bucket"))
        return placed.join(F.broadcast(changed), "bucket", "left_semi").select("row.*")

    return multiset_diff(suspects(actual), suspects(expected))
