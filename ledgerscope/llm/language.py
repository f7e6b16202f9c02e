"""Language of documents by words first, then shorter and shorter character n-grams.

A known word adds its log frequency in each language. A word that the model does not know adds
the mean log frequency of its known n-grams of the greatest length of which it has any, down to single letters. Words are
runs of letters in lower case; n-grams see the word's borders as a blank.

Frequencies come from a bounded sample of rows outside the held-out fold that have a
language, drawn by language so that rare ones are learned too; rows repeated with id and text count once. The model keeps
the most frequent words and n-grams, so its size is bounded by these and the number of languages. Every whole text, of any length, is
scored; of languages that score the same the first by name is taken. Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing
could be learned; an empty table gives an empty one. Rows are kept one by one, whatever their id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.labelled import in_share
from ledgerscope.llm.text_bytes import U64, blocks, by_block, hash_spans, split, window_hashes
from ledgerscope.session import land

UNKNOWN = "und"
_BLANK = 32
# Letters are worked on as 8-byte numbers, so these are smaller than blocks of bytes.
_COUNTED_BYTES = 512 << 10
_SCORED_BYTES = 1 << 20


@dataclass(frozen=True)
class LanguageParams:
    sample_rows: int = 8_000  # of the labelled sample: divided by share, but no language gets less than an equal part
    folds: int = 4
    held_out: int = 2  # rows whose crc32 leaves this are held out
    longest: int = 5  # of n-grams
    words: int = 60_000  # most frequent words kept
    grams: int = 20_000  # most frequent n-grams kept of each length
    smoothing: float = 0.5


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Letters:
    """Words of many texts as code points: everything else is a blank, and a blank follows every text."""

    def __init__(self, column: pa.Array):
        lowered = [(t or "").lower() for t in column.to_pylist()]
        raw = " ".join(["", *lowered, ""]).encode("utf-32-le", "replace")
        points = np.frombuffer(raw, dtype=np.uint32)
        letter = _letters()[points]
        self.points = np.where(letter, points, np.uint32(_BLANK))
        self.starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        bounds = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
        self.first = np.searchsorted(self.starts, bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word_hashes(self) -> np.ndarray:
        return hash_spans(self.points.view(np.uint8), 4 * self.starts, 4 * self.ends)

    def grams(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the given words, and the place in ``words`` of each."""
        pad = 1 if size > 1 else 0
        starts = self.starts[words] - pad
        counts = np.maximum(self.ends[words] + pad - starts - size + 1, 0)
        place = np.repeat(np.arange(len(words)), counts)
        at = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[place]
        return window_hashes(self.points.astype(U64), size)[at], place


@dataclass(frozen=True)
class Table:
    """Sorted hashes and a row of log frequencies for each, one per language."""

    keys: np.ndarray
    logs: np.ndarray

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and the rows of those."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        return known, at[known]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    words: Table
    grams: dict[int, Table]

    def totals(self, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
        """Summed log frequencies per text and language, and the number of words."""
        width, n = len(self.languages), len(letters.first) - 1
        each = np.zeros((len(letters.starts), width))
        known, rows = self.words.look_up(letters.word_hashes())
        each[known] = self.words.logs[rows]
        left = np.flatnonzero(~known)
        for size in sorted(self.grams, reverse=True):
            if not len(left):
                break
            hashes, place = letters.grams(left, size)
            seen, rows = self.grams[size].look_up(hashes)
            place = place[seen]
            found = np.bincount(place, minlength=len(left))
            for k in range(width):
                total = np.bincount(place, weights=self.grams[size].logs[rows, k], minlength=len(left))
                each[left, k] = total / np.maximum(found, 1)
            left = left[found == 0]
        owners = letters.owners()
        out = np.stack([np.bincount(owners, weights=each[:, k], minlength=n) for k in range(width)], axis=1)
        return out, np.diff(letters.first)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        letters = Letters(column)
        counts = np.diff(letters.first)
        if not self.languages:
            return [UNKNOWN] * len(counts), np.zeros(len(counts))
        totals, counts = self.totals(letters)
        best = totals.argmax(1)
        spread = (totals - totals.max(1, keepdims=True)) / np.sqrt(np.maximum(counts, 1))[:, None]
        score = 1 / np.exp(spread).sum(1)
        names = [self.languages[b] if c else UNKNOWN for b, c in zip(best, counts, strict=True)]
        return names, np.where(counts > 0, score, 0.0)


def _counts(sample: DataFrame, params: LanguageParams) -> DataFrame:
    """``size, key, code, n``: words (size 0) and n-grams of ``sample(text, code)``, counted in blocks first, one size at a time."""

    def counted(size: int, hashes: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        change = np.ones(len(hashes), dtype=bool)
        change[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(change)
        n = np.diff(np.append(first, len(hashes)))
        columns = [np.full(len(first), size, np.int32), hashes[first].view(np.int64), of[first], n.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "key", "code", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", _COUNTED_BYTES):
                letters = Letters(block.column("text"))
                of_word = block.column("code").to_numpy()[letters.owners()]
                yield counted(0, letters.word_hashes(), of_word)
                every = np.arange(len(letters.starts))
                for size in range(1, params.longest + 1):
                    hashes, place = letters.grams(every, size)
                    yield counted(size, hashes, of_word[place])

    return sample.mapInArrow(run, "size int, key long, code long, n long").groupBy("size", "key", "code").agg(F.sum("n").alias("n"))


def fit_language(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """The model of ``docs(doc_id, text, lang)``; reads them twice, the second time down to the sample."""
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull()
        & F.col("lang").isNotNull()
        & (split("doc_id") % params.folds != params.held_out)
    )
    row = F.xxhash64("doc_id", "text")
    languages = land(
        usable.groupBy("lang").agg(F.approx_count_distinct(row).alias("rows")).withColumn("code", F.monotonically_increasing_id()),
        "languages",
    )
    n, total = languages.agg(F.count("*"), F.sum("rows")).first()
    among = F.least(F.lit(total or 0), F.col("rows") * n)  # the larger of its share and an equal part
    picked = (
        usable.join(languages, "lang")
        .where(in_share(row, params.sample_rows, among))
        .select("doc_id", "text", "code")
        .dropDuplicates(["doc_id", "text", "code"])
    )
    counts = land(_counts(picked.select("text", "code"), params), "counts")
    by_code = F.collect_list(F.struct("code", "n"))  # one entry per language
    keyed = counts.groupBy("size", "key").agg(by_code.alias("found"), F.sum("n").alias("total"))
    ordered = [F.desc("total"), F.asc("key")]
    named = {r["code"]: r["lang"] for r in languages.join(counts.select("code").distinct(), "code", "left_semi").collect()}
    names = sorted(named.values())
    column = {code: names.index(lang) for code, lang in named.items()}
    tables = {}
    for size in range(params.longest + 1):
        most = params.grams if size else params.words
        top = keyed.where(F.col("size") == size).orderBy(*ordered).limit(most).select("key", "found").toArrow()
        found = top.column("found").combine_chunks()
        keys = top.column("key").to_numpy().view(U64)
        matrix = np.zeros((len(keys), len(names)))
        if len(keys):
            rows = np.repeat(np.arange(len(keys)), np.diff(found.offsets.to_numpy()))
            codes, place = np.unique(found.flatten().field("code").to_numpy(), return_inverse=True)
            of = np.array([column[c] for c in codes.tolist()])[place]
            matrix[rows, of] = found.flatten().field("n").to_numpy()
        whole = matrix.sum(0) + params.smoothing * max(1, len(keys))
        order = np.argsort(keys)
        tables[size] = Table(keys[order], np.log((matrix + params.smoothing) / whole)[order])
    return LanguageModel(names, tables.pop(0), tables)


def language(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast(fit_language(docs, params))

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        names, score = sent.value.predict(block.column("text"))
        return pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
            ["doc_id", "lang_pred", "score"],
        )

    return (
        docs.select("doc_id", "text")
        .mapInArrow(by_block("text", work, _SCORED_BYTES), "doc_id long, lang_pred string, score double")
        .select("doc_id", (split("doc_id") % params.folds == params.held_out).alias("held_out"), "lang_pred", "score")
    )
