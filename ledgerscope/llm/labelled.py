"""A bounded sample of labelled documents, and models broadcast to score whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.text_bytes import by_block


_FULL = 1 << 62  # hashes compared with a share; wide enough for any number of rows


def in_share(hashed: Column, rows: int, total: int | Column) -> Column:
    """Whether a row with a 64-bit hash falls into a sample of about ``rows`` of ``total`` rows."""
    total = F.greatest(total, F.lit(1)) if isinstance(total, Column) else F.lit(max(1, total))
    bound = F.least(F.lit(float(rows)) / total, F.lit(1.0)) * F.lit(float(_FULL))
    return F.pmod(hashed, F.lit(_FULL)) < bound.cast("long")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int
) -> DataFrame:
    """``doc_id, text, label`` of about ``rows`` labelled documents, chosen by a hash of the id.

    ``allowed`` is a condition on ``doc_id``. A null label is none; of several labels of one
    id the largest counts. The sample's ids are broadcast: their number is bounded by ``rows``. Of several
    rows of one id the smallest text is taken, so the sample is bounded however often rows are repeated.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(allowed)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    picked = usable.where(in_share(F.xxhash64("doc_id"), rows, usable.count()))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def features_of(
    docs: DataFrame, features: Callable[[pa.Array], np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and ids of a bounded sample, worked out in tasks and brought together.

    Sorted by id, so that a fit is the same whatever order tasks end in.
    """

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        x = features(block.column("text"))
        flat = pa.array(x.astype(np.float32).ravel())
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        return pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("label"), pa.ListArray.from_arrays(ends, flat)],
            ["doc_id", "label", "x"],
        )

    table = docs.mapInArrow(by_block("text", work), "doc_id long, label int, x array<float>").toArrow()
    ids = table.column("doc_id").to_numpy()
    y = table.column("label").to_numpy().astype(float)
    width = features(pa.array([""])).shape[1]
    x = table.column("x").combine_chunks().values if len(ids) else pa.array([], pa.float32())
    x = np.asarray(x, dtype=np.float32).reshape(len(ids), width)
    order = np.lexsort((x.sum(1), ids))
    return x[order], y[order], ids[order]


def scored(
    docs: DataFrame,
    features: Callable[[pa.Array], np.ndarray],
    score: Callable[[np.ndarray], np.ndarray],
) -> DataFrame:
    """``doc_id, score`` of every row of ``docs(doc_id, text)``; the model travels with the task."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        values = score(features(block.column("text")).astype(np.float32))
        return pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(np.clip(values, 0, 1).astype(float))], ["doc_id", "score"]
        )

    return docs.mapInArrow(by_block("text", work), "doc_id long, score double")
