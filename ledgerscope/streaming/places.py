"""Dropping repeated rows that have a place in a file, by stretches of the file.

With one key per row, each row is shuffled by itself and its key is held in state with all of its text. Here neighbours go
through the shuffle as one compressed piece (an Arrow stream) for each stretch of 262,144 places, and a stretch has one row of
state: the set of its places, sorted, as compressed differences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ledgerscope.session import ship_package

BITS = 18  # of a place within its stretch
STRETCH, ROWS = "_stretch", "_rows"


def drop_seen_places(stream: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Rows of ``stream`` without those whose ``keys``, of which ``place`` is a whole number, have come before.

    A key that repeats keeps the first row that arrives, and nulls are alike, as with ``dropDuplicates``. Rows in any order
    come out right; what is saved comes from neighbours that arrive together.
    """
    ship_package(stream.sparkSession)
    others = [key for key in keys if key != place]
    names = [f"_key_{i}" for i in range(len(others))]
    fields = [StructField(name, stream.schema[key].dataType) for name, key in zip(names, others)]
    packed = StructType([*fields, StructField(STRETCH, LongType()), StructField(ROWS, BinaryType())])
    return (
        stream.mapInArrow(_packer(others, place), packed)
        .groupBy(*names, STRETCH)
        .applyInPandasWithState(
            _keeper(stream.columns.index(place)),
            outputStructType=f"{ROWS} binary",
            stateStructType="places binary, count int",
            outputMode="append",
            timeoutConf=GroupStateTimeout.NoTimeout,
        )
        .mapInArrow(_unpack, stream.schema)
    )


def _packer(others: Sequence[str], place: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _pieces(batch, others, place)

    return pack


def _pieces(batch: pa.RecordBatch, others: Sequence[str], place: str) -> pa.RecordBatch:
    """One row for each run of rows of one stretch."""
    known = batch.column(place).is_valid().to_numpy(zero_copy_only=False)
    stretch = _numbers(batch.column(place)) >> BITS
    first = np.ones(batch.num_rows, bool)
    first[1:] = (stretch[1:] != stretch[:-1]) | (known[1:] != known[:-1])
    for key in others:
        first[pc.run_end_encode(batch.column(key)).run_ends.to_numpy()[:-1]] = True
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], batch.num_rows)
    rows = []
    for start, stop in zip(starts.tolist(), stops.tolist()):
        piece = batch.slice(start, stop - start)
        for key in others:  # of one value each
            piece = piece.set_column(batch.schema.get_field_index(key), key, _repeated(piece.column(key)))
        rows.append(_dumped(piece))
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(key).take(pa.array(starts)) for key in others),
            pa.array(stretch[starts], mask=~known[starts]),
            pa.array(rows, pa.binary()),
        ],
        [*(f"_key_{i}" for i in range(len(others))), STRETCH, ROWS],
    )


def _keeper(place: int) -> Callable:
    def keep(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = _loaded(*state.get) if state.exists else np.empty(0, np.uint32)
        before = len(seen)
        for frame in pieces:
            kept = []
            for piece in frame[ROWS].array:
                places = _places(piece, place)
                if np.array_equal(places, seen):  # the whole piece once more
                    continue
                found, at = _distinct(places)
                new = np.sort(at[~np.isin(found, seen, assume_unique=True)]) if len(seen) else np.sort(at)
                if len(new) == len(places):
                    kept.append(piece)
                elif len(new):
                    rows = pa.ipc.open_stream(piece).read_all().take(pa.array(new))
                    kept.append(_dumped(rows.combine_chunks().to_batches()[0]))
                if len(new):
                    seen = np.union1d(seen, found) if len(seen) else found
            if kept:
                yield pd.DataFrame({ROWS: kept})
        if len(seen) > before:
            state.update(_stored(seen))

    return keep


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in batch.column(0):
            for rows in pa.ipc.open_stream(piece.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)):
                plain = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in rows.columns]
                yield pa.RecordBatch.from_arrays(plain, rows.schema.names)


def _repeated(column: pa.Array) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(column), np.int32)), column[:1])


def _numbers(places: pa.Array) -> np.ndarray:
    places = places.cast(pa.int64())
    return (pc.fill_null(places, 0) if places.null_count else places).to_numpy()


def _places(piece: bytes, place: int) -> np.ndarray:
    """Places within their stretch; those that are null have a stretch of their own. Other columns stay compressed."""
    only = pa.ipc.IpcReadOptions(included_fields=[place], use_threads=False)
    column = pa.ipc.open_stream(piece, options=only).read_next_batch().column(0)
    return (_numbers(column) & ((1 << BITS) - 1)).astype(np.uint32)


def _distinct(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in order, and where each comes first."""
    if (places[1:] > places[:-1]).all():
        return places, np.arange(len(places))
    return np.unique(places, return_index=True)


def _dumped(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _stored(seen: np.ndarray) -> tuple[bytes, int]:
    steps = np.diff(seen, prepend=np.uint32(0)).astype(np.uint32)
    return pa.compress(steps.tobytes(), codec="zstd", asbytes=True), len(seen)


def _loaded(places: bytes, count: int) -> np.ndarray:
    steps = pa.decompress(places, decompressed_size=4 * count, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(steps, np.uint32), dtype=np.uint32)
