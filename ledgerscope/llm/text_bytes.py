"""Vectorised work on the bytes of many texts at once, for use inside tasks.

A column of texts is one buffer of UTF-8 bytes with offsets. Words are found by a
look-up table of bytes, and hashed eight bytes at a time for all words together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
BLOCK_BYTES = 4 << 20  # working memory of a task is a small multiple of this or of its longest text
BLOCK_ROWS = 1 << 15  # fewer than 16 bits, so a row's number fits into them

_MUL_1 = U64(0x9E3779B97F4A7C15)
_MUL_2 = U64(0xD6E8FEB86659FD93)
_SHIFT = U64(32)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that is true inside the given inclusive spans of bytes."""
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


def split(doc_id: str) -> Column:
    """crc32 of the id as text, for the fixed folds. A null id is taken as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that equal inputs only give equal outputs."""
    x = x * _MUL_1
    x ^= x >> _SHIFT
    x *= _MUL_2
    x ^= x >> _SHIFT
    return x


class Texts:
    """Bytes of several texts, one after the other; ``offsets`` has one entry more than texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def texts_of(column: pa.Array) -> Texts:
    """The texts of an Arrow column of strings; null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + n + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    return Texts(raw, offsets - low)


def blocks(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text and ``BLOCK_ROWS`` rows, or one row."""
    ends = texts_of(batch.column(text)).offsets
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), start + BLOCK_ROWS, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def by_block(
    text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = BLOCK_BYTES
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that applies ``work`` to blocks of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text, most):
                yield work(block)

    return run


class Words:
    """Maximal runs of word bytes: ``starts`` and ``ends`` in the buffer, ``first`` word per text."""

    def __init__(self, texts: Texts, is_word: np.ndarray):
        self.texts = texts
        inside = is_word[texts.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[texts.offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, texts.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The number of its text for each word."""
        return np.repeat(np.arange(len(self.texts)), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.texts.data, self.starts, self.ends)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    chunks = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    out = mix((chunks[starts] & _MASKS[np.minimum(sizes, 8)]) ^ (sizes.astype(U64) * _MUL_2))
    done, left = 8, np.flatnonzero(sizes > 8)
    while len(left):
        part = chunks[starts[left] + done] & _MASKS[np.minimum(sizes[left] - done, 8)]
        out[left] = mix(out[left] * _MUL_2 + part)
        done += 8
        left = left[sizes[left] > done]
    return out


def hash_text(text: str) -> int:
    """The hash that ``hash_spans`` gives the bytes of this text."""
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0])


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n] + U64(size)
    for j in range(1, size):
        out = out * _MUL_1 + words[j : n + j]
    return mix(out)


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; 0 where a text has none."""
    total = np.zeros(len(bounds) - 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    if values.dtype == bool:
        hits = np.flatnonzero(values)
        return np.diff(np.searchsorted(hits, bounds))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        total[full] = np.add.reduceat(values, bounds[:-1][full], dtype=total.dtype)
    return total
