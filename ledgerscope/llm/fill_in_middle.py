"""Fill-in-middle examples from texts stored as seekable frames.

A text of n units (lines) is cut after two of them, chosen by a hash of its id, into prefix, middle and suffix. The
cuts are found through the cumulative unit counts of the frames: only the frames that are cut are decompressed,
all others go into the output as they are, in another order and with sentinels between. Digests and the way back
go through the frames of the output one after the other.

Texts without units or with a sentinel in them stay as they are (form ``plain``). Null texts are taken as empty, a
null id as an empty text where ids are hashed. Rows are kept one by one, whatever their id; extra columns are ignored;
an empty table gives an empty one. Working memory is one batch of texts and their frames.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.frames import Cut, FrameParams, between, cut_after, store

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Sentinels in the order in which they stand in the output.
ORDER = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}


@dataclass(frozen=True)
class MiddleParams:
    rate: int = 100  # per cent of texts that are cut
    suffix_first: int = 50  # per cent of these in the form spm
    seed: str = "7"
    frames: FrameParams = FrameParams()


def _numbers(params: MiddleParams) -> list[Column]:
    """Four unsigned 32-bit numbers from a hash of the id."""
    name = F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def planned(stored: DataFrame, params: MiddleParams = MiddleParams()) -> DataFrame:
    """``stored`` with ``first, second`` (units before each cut) and ``form``."""
    h1, h2, h3, h4 = _numbers(params)
    places = F.col("n_units") + 1
    plain = (F.col("n_units") == 0) | (F.size("holds") > 0) | (h3 % 100 >= params.rate)
    form = F.when(plain, PLAIN).when(h4 % 100 < params.suffix_first, SPM).otherwise(PSM)
    return stored.select(
        "*", F.least(h1 % places, h2 % places).alias("first"), F.greatest(h1 % places, h2 % places).alias("second"),
        form.alias("form"),
    )


def fill_in_middle(docs: DataFrame, params: MiddleParams = MiddleParams()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``; the output is an array of compressed frames.

    ``text_of`` gives the text of an output, ``restored`` the text it was made from.
    """
    rows = planned(store(docs, SENTINELS, params.frames), params)

    def one(row: dict) -> dict:
        frames, n, chars = row["frames"], row["n_units"], row["n_chars"]
        out = {"doc_id": row["doc_id"], "n": n, "form": row["form"], "prefix_chars": None, "middle_chars": None}
        if row["form"] == PLAIN:
            return out | {"output": [f["data"] for f in frames]}
        start, stop = Cut(0, 0, 0), Cut(len(frames), 0, chars)
        first, second = (cut_after(frames, row[c], n, chars) for c in ("first", "second"))
        parts = {PREFIX: (start, first), MIDDLE: (first, second), SUFFIX: (second, stop)}
        press = zstandard.ZstdCompressor(level=params.frames.level)
        output: list[bytes] = []
        for sentinel in ORDER[row["form"]]:
            output.append(press.compress(sentinel.encode()))
            output += between(frames, *parts[sentinel], params.frames)
        return out | {"prefix_chars": first.chars, "middle_chars": second.chars - first.chars, "output": output}

    kinds = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
         ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.slice(at, 256).to_pylist()], schema=kinds)

    return rows.mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
    )


def _opened(output: Sequence[bytes]) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return (unpack.decompress(data) for data in output)


def text_of(output: Sequence[bytes]) -> str:
    return b"".join(_opened(output)).decode()


def _found(output: Sequence[bytes]) -> dict[str, int]:
    """Where in the bytes of the output each sentinel stands first, going through the frames once."""
    places: dict[str, int] = {}
    before, tail = 0, b""
    for piece in _opened(output):
        window = tail + piece
        for sentinel in SENTINELS:
            if sentinel not in places and (at := window.find(sentinel.encode())) >= 0:
                places[sentinel] = before - len(tail) + at
        before += len(piece)
        tail = window[-2:]
    return places


def restored(output: Sequence[bytes], form: str) -> Iterator[bytes]:
    """The pieces of the text from which an output of this form was made, in order."""
    if form == PLAIN:
        yield from _opened(output)
        return
    places = _found(output)
    order = ORDER[form]
    spans = {}
    for sentinel, following in zip(order, (*order[1:], None), strict=True):
        spans[sentinel] = (places[sentinel] + len(sentinel), places.get(following) if following else None)
    for sentinel in (PREFIX, MIDDLE, SUFFIX):
        low, high = spans[sentinel]
        at = 0
        for piece in _opened(output):
            stop = len(piece) if high is None else min(len(piece), high - at)
            if stop > max(0, low - at):
                yield piece[max(0, low - at) : stop]
            at += len(piece)
            if high is not None and at >= high:
                break


def _digest(parts: Iterable[bytes]) -> str:
    state = hashlib.sha256()
    for part in parts:
        state.update(part)
    return state.hexdigest()


def middle_digests(docs: DataFrame, params: MiddleParams = MiddleParams()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = batch.column("output"), batch.column("form").to_pylist()
            whole, back = [], []
            for i, form in enumerate(forms):
                output = outputs[i].as_py()
                whole.append(_digest(_opened(output)))
                back.append(_digest(restored(output, form)))
            arrays = [batch.column(c) for c in kept] + [pa.array(whole, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "output_sha256", "restored_sha256"])

    return fill_in_middle(docs, params).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    )
