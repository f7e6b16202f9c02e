"""Benchmark decontamination by a broadcast set of hashed word windows.

Words are runs of digits, letters after lower-casing A-Z, and everything outside ASCII. A
window is ``window`` consecutive words of a benchmark item, or all words of a shorter one.
Tasks scan all windows of whole documents against the set and verify every hit on its
words. The set is broadcast in parts of at most ``most_windows`` windows, one scan for
each part, so a benchmark of any size is searched whole.

Null, empty and wordless texts have no words and no hits; items without words or without an id have
no windows; repeated items count once by id; repeated documents are rows of their own; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ledgerscope.llm.text_bytes import U64, Words, by_block, byte_class, texts_of, window_hashes
from ledgerscope.session import land

WORD_BYTES = byte_class((48, 57), (97, 122), (128, 255))
_BITS = 20
_LOW = U64((1 << _BITS) - 1)
_ITEMS = "items found so far"
_MARKS = [
    StructField("hit words so far", ArrayType(IntegerType())),
    StructField(_ITEMS, ArrayType(StringType())),
]


@dataclass(frozen=True)
class LeakParams:
    window: int = 10
    most_windows: int = 1_000_000  # windows in one broadcast part
    most_share: float = 0.3  # documents with more hit words go, from others the hit words are cut


def _words(column: pa.Array) -> Words:
    """Words of the lower-cased texts, with the bytes as they were."""
    texts = texts_of(column)
    words = Words(texts.lowered(), WORD_BYTES)
    words.plain = texts.data
    return words


class WindowSet:
    """Hashed windows of one part of the benchmark, with their words and items."""

    def __init__(self, rows: list[tuple[int, int, str, list[str]]]):
        """``rows`` have the number of words, the hash, the words joined by blanks, and the items."""
        self.sizes = sorted({r[0] for r in rows})
        self.items: dict[int, dict[str, list[str]]] = {}
        for _, key, words, items in rows:
            self.items.setdefault(key, {})[words] = items
        self.keys = np.array(sorted(self.items), dtype=U64)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.keys & _LOW).astype(np.int64)] = True

    def hits(self, words: Words, hashes: np.ndarray, owners: np.ndarray):
        """``(text, first word, words, items)`` of each verified hit."""
        data = words.texts.data
        for size in self.sizes:
            found = window_hashes(hashes, size)
            maybe = np.flatnonzero(self.seen[(found & _LOW).astype(np.int64)])
            maybe = maybe[owners[maybe] == owners[maybe + size - 1]]
            at = np.minimum(np.searchsorted(self.keys, found[maybe]), len(self.keys) - 1)
            for i in maybe[self.keys[at] == found[maybe]].tolist():
                spans = zip(words.starts[i : i + size], words.ends[i : i + size], strict=True)
                text = b" ".join(data[s:e].tobytes() for s, e in spans).decode("utf-8", "replace")
                items = self.items[int(found[i])].get(text)
                if items:
                    yield int(owners[i]), i, size, items


def benchmark_windows(benchmark: DataFrame, params: LeakParams) -> DataFrame:
    """``size, key, words, items``: every window of the benchmark and the items it is of."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        words = _words(block.column("text"))
        hashes = words.hashes()
        ids = block.column("item_id").to_pylist()
        rows = []
        for k, (start, stop) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            size = min(params.window, int(stop - start))
            if not size or ids[k] is None:
                continue
            spans = list(zip(words.starts[start:stop], words.ends[start:stop], strict=True))
            tokens = [words.texts.data[s:e].tobytes().decode("utf-8", "replace") for s, e in spans]
            for j, key in enumerate(window_hashes(hashes[start:stop], size).view(np.int64).tolist()):
                rows.append((size, key, " ".join(tokens[j : j + size]), ids[k]))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["size", "key", "words", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return (
        items.mapInArrow(by_block("text", work), "size int, key long, words string, item string")
        .groupBy("size", "key", "words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _parts(benchmark: DataFrame, params: LeakParams) -> Iterator[WindowSet]:
    """The benchmark as sets of bounded size, one at a time."""
    windows = benchmark_windows(benchmark, params)
    count = windows.count()
    parts = max(1, -(-count // params.most_windows))
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(parts)))
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).drop("part").collect()
        yield WindowSet([(r["size"], r["key"] & (2**64 - 1), r["words"], r["items"]) for r in rows])


def _marks(block: pa.RecordBatch, words: Words, part: WindowSet) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are hit, and the items found in each text, earlier parts included."""
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in range(block.num_rows)]
    for text, first, size, found in part.hits(words, words.hashes(), words.owners()):
        mark[first] += 1
        mark[first + size] -= 1
        items[text].update(found)
    hit = np.cumsum(mark[:-1]) > 0
    if block.schema.names[-1] == _ITEMS:
        for i, (spans, found) in enumerate(zip(*map(pa.Array.to_pylist, block.columns[-2:]), strict=True)):
            hit[words.first[i] + np.array(spans, dtype=np.int64)] = True
            items[i].update(found)
    return hit, items


def _scan(
    docs: DataFrame, benchmark: DataFrame, params: LeakParams, finish: Callable, schema: str | StructType
) -> DataFrame:
    """Scan ``docs`` with each part of the benchmark; ``finish(block, words, hit, items)`` makes rows.

    Hits of all but the last part are written with the documents, so one part is broadcast at a time.
    """
    context = docs.sparkSession.sparkContext
    marked = StructType([*docs.schema, *_MARKS])

    def carry(block: pa.RecordBatch, part: WindowSet) -> pa.RecordBatch:
        words = _words(block.column("text"))
        hit, items = _marks(block, words, part)
        places = [np.flatnonzero(hit[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        rows = block.select(range(len(marked) - 2))
        return pa.RecordBatch.from_arrays(
            [
                *rows.columns,
                pa.array(places, pa.list_(pa.int32())),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ],
            [*rows.schema.names, *(f.name for f in _MARKS)],
        )

    def end(block: pa.RecordBatch, part: WindowSet) -> pa.RecordBatch:
        words = _words(block.column("text"))
        return finish(block, words, *_marks(block, words, part))

    def run(frame: DataFrame, work: Callable, part: WindowSet, schema: str | StructType) -> DataFrame:
        sent = context.broadcast(part)
        return frame.mapInArrow(by_block("text", lambda block: work(block, sent.value)), schema)

    parts = _parts(benchmark, params)
    part = next(parts)
    for following in parts:
        docs = land(run(docs, carry, part, marked), "marked")
        part = following
    return run(docs, end, part, schema)


def _summed(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(hit), first))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items``."""

    def finish(block: pa.RecordBatch, words: Words, hit: np.ndarray, items: list[set[str]]):
        n_hit = _summed(hit, words.first)
        return pa.RecordBatch.from_arrays(
            [
                block.column("doc_id"),
                pa.array(words.counts.astype(np.int64)),
                pa.array(n_hit.astype(np.int64)),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([digest(x) for x in items], pa.string()),
                pa.array(n_hit > 0),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )

    return _scan(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        benchmark,
        params,
        finish,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
        "contaminated boolean, items array<string>",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut from the texts, and documents that
    are mostly benchmark go. All columns of ``docs`` are kept; an ``n_chars`` column follows the text."""
    names = docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("bigint", "int") else None

    def finish(block: pa.RecordBatch, words: Words, hit: np.ndarray, items: list[set[str]]):
        n_hit = _summed(hit, words.first)
        keep = n_hit <= params.most_share * words.counts
        touched = np.flatnonzero((n_hit > 0) & keep).tolist()
        arrays = list(block.columns[: len(names)])
        if touched:
            new = arrays[at].to_pylist()
            for i in touched:
                new[i] = _without(words, hit, i)
            if counted is not None:
                sizes = arrays[counted].to_pylist()
                for i in touched:
                    sizes[i] = len(new[i])
                arrays[counted] = pa.array(sizes, arrays[counted].type)
            arrays[at] = pa.array(new, arrays[at].type)
        return pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(keep))

    return _scan(docs, benchmark, params, finish, docs.schema)


def _without(words: Words, hit: np.ndarray, i: int) -> str:
    """Text ``i`` without the bytes from the first to the last word of each hit span."""
    data, offsets = words.plain, words.texts.offsets
    first, last = words.first[i], words.first[i + 1]
    inside = np.concatenate([[False], hit[first:last], [False]])
    begin = np.flatnonzero(inside[1:-1] & ~inside[:-2]) + first
    end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + first
    pieces, done = [], offsets[i]
    for b, e in zip(begin, end, strict=True):
        pieces.append(data[done : words.starts[b]])
        done = words.ends[e]
    pieces.append(data[done : offsets[i + 1]])
    return b"".join(p.tobytes() for p in pieces).decode("utf-8", "replace")
