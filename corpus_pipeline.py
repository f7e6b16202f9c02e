"""From raw documents to token ids: five stages, each on all rows that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; stages are written as Parquet
and read again in between. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.bpe import tokenized
from ledgerscope.llm.decontaminate import decontaminate
from ledgerscope.llm.line_templates import drop_repeated_lines
from ledgerscope.llm.near_dedup import keep_one
from ledgerscope.llm.quality import keep_good
from ledgerscope.session import land, ship_package

TOKENIZER = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in the first document only."""
    return drop_repeated_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and whether decoding gives the text back."""
    path = public_tokenizers.path(TOKENIZER)
    rows = tokenized(docs, path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", "lang", "source", "input_ids", F.size("input_ids").alias("n_tokens"), same.alias("round_trip")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", lines_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", benchmark_stage),
    ("bpe", tokens_stage),
]

# Boosted trees and byte-pair merging have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name)
    return docs
