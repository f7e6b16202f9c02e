"""Quality of documents by boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows outside the held-out fold; every whole text is
scored. Null, empty and blank texts have statistics of zero and a score like any other; rows
are kept one by one, whatever their id; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.boosting import BoostParams, Trees, fit_trees
from ledgerscope.llm.labelled import features_of, labelled_sample, scored
from ledgerscope.llm.text_bytes import (
    U64,
    Texts,
    Words,
    by_block,
    byte_class,
    split,
    sums_by_text,
    texts_of,
    window_hashes,
)

NOT_BLANK = byte_class((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
NOT_NEWLINE = byte_class((0x00, 0x09), (0x0B, 0xFF))
CLASSES = {
    "upper": byte_class((65, 90)),
    "lower": byte_class((97, 122)),
    "digit": byte_class((48, 57)),
    "high": byte_class((128, 255)),
    "space": byte_class((9, 13), (32, 32)),
    "stop": byte_class((33, 33), (46, 46), (63, 63)),
    "comma": byte_class((44, 44), (58, 59)),
    "bang": byte_class((33, 33)),
    "symbol": byte_class((35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 96), (126, 126)),
    "bar": byte_class((124, 124)),
    "bracket": byte_class((40, 41), (91, 91), (93, 93), (123, 123), (125, 125)),
    "control": byte_class((0, 8), (14, 31), (127, 127)),
}


@dataclass(frozen=True)
class QualityParams:
    sample_rows: int = 20_000  # bound of the labelled sample that is fitted
    folds: int = 5  # rows whose crc32 leaves 0 are held out
    threshold: float = 0.3
    boost: BoostParams = field(default_factory=BoostParams)


def repetition(hashes: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct hashes each text has, and how often its commonest occurs."""
    distinct, commonest = np.zeros(n), np.zeros(n)
    if not len(hashes):
        return distinct, commonest
    keys = np.sort((owners.astype(U64) << U64(48)) | (hashes >> U64(16)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    runs = np.diff(np.concatenate([first, [len(keys)]]))
    who = (keys[first] >> U64(48)).astype(np.int64)
    distinct += np.bincount(who, minlength=n)
    np.maximum.at(commonest, who, runs)
    return distinct, commonest


def statistics(column: pa.Array) -> np.ndarray:
    """One row of document statistics per text."""
    texts = texts_of(column)
    n = len(texts)
    size = np.diff(texts.offsets).astype(float)
    safe = np.maximum(size, 1)
    columns = [np.log1p(size)]
    for table in CLASSES.values():
        columns.append(sums_by_text(table[texts.data], texts.offsets) / safe)
    words = Words(texts, NOT_BLANK)
    lengths = words.ends - words.starts
    count = np.maximum(words.counts, 1)
    owners = words.owners()
    hashes = words.hashes()
    capital = CLASSES["upper"][texts.data[words.starts]] if len(words) else np.zeros(0, bool)
    last = texts.data[words.ends - 1] if len(words) else np.zeros(0, np.uint8)
    columns += [
        np.log1p(words.counts),
        sums_by_text(lengths, words.first) / count,
        sums_by_text(lengths <= 3, words.first) / count,
        sums_by_text(lengths >= 15, words.first) / count,
        sums_by_text(lengths == 1, words.first) / count,
        sums_by_text(capital, words.first) / count,
        sums_by_text(CLASSES["stop"][last], words.first) / count,
        sums_by_text(CLASSES["symbol"][last], words.first) / count,
    ]
    for window in (1, 3):
        values = window_hashes(hashes, window)
        ends = owners[window - 1 :] if len(owners) >= window else owners[:0]
        inside = owners[: len(values)] == ends
        distinct, commonest = repetition(values[inside], ends[inside], n)
        each = np.maximum(words.counts - window + 1, 1)
        columns += [distinct / each, commonest / each]
    lines = Words(Texts(texts.data, texts.offsets), NOT_NEWLINE)
    each = np.maximum(lines.counts, 1)
    distinct, commonest = repetition(lines.hashes(), lines.owners(), n)
    columns += [np.log1p(lines.counts), size / each, distinct / each, commonest / each, words.counts / each]
    return np.stack(columns, axis=1)


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> Trees:
    learn = (split("doc_id") % params.folds) != 0
    sample = labelled_sample(docs, labels, "quality", learn, params.sample_rows)
    x, y, _ = features_of(sample, statistics)
    return fit_trees(x, y, params.boost)


def quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit_quality(docs, labels, params)
    return scored(docs, statistics, model.score).select(
        "doc_id",
        (split("doc_id") % params.folds == 0).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns as they are."""
    model = fit_quality(docs, labels, params)

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        good = model.score(statistics(block.column("text")).astype(np.float32)) >= params.threshold
        return block.filter(pa.array(good))

    return docs.mapInArrow(by_block("text", work), docs.schema)
