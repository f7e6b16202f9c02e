"""Texts as seekable compressed frames.

A text is cut into pieces of at most ``frame_bytes`` bytes, never within a code point, and each piece is
a zstandard frame of its own. With a frame stand the units (ends of lines) and code points before it, so a place
given in units is found by its number, and one frame is decompressed to cut there. Whatever needs the whole text goes
through its frames in order and holds one piece at a time.

A row of the store is ``doc_id, n_units, n_chars, holds, frames``; ``holds`` names the watched strings
that occur in the text. A null text is stored as an empty one, which has no frames and no units. Rows are
kept one by one, whatever their id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.text_bytes import by_block, texts_of
from ledgerscope.session import land

FRAMES = "array<struct<units:bigint,chars:bigint,data:binary>>"
FRAMES_ARROW = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))


@dataclass(frozen=True)
class FrameParams:
    frame_bytes: int = 64 << 10
    level: int = 3


def code_points(piece: bytes) -> int:
    return len(piece.decode("utf-8", "replace"))


def framed(text: bytes, params: FrameParams = FrameParams()) -> list[dict]:
    """The frames of one text in UTF-8."""
    press = zstandard.ZstdCompressor(level=params.level)
    frames, start, units, chars = [], 0, 0, 0
    while start < len(text):
        stop = min(len(text), start + params.frame_bytes)
        while stop < len(text) and text[stop] & 0xC0 == 0x80:  # at most three steps back
            stop -= 1
        if stop == start:
            raise ValueError("frame_bytes must be 4 or more")
        piece = text[start:stop]
        frames.append({"units": units, "chars": chars, "data": press.compress(piece)})
        units += piece.count(b"\n")
        chars += code_points(piece)
        start = stop
    return frames


def pieces(frames: Iterable[dict]) -> Iterator[bytes]:
    """The text piece by piece."""
    unpack = zstandard.ZstdDecompressor()
    for frame in frames:
        yield unpack.decompress(frame["data"])


@dataclass(frozen=True)
class Cut:
    """A place in a text: so many bytes into a frame, after so many code points of the text."""

    frame: int
    offset: int
    chars: int


def cut_after(frames: Sequence[dict], unit: int, n_units: int, n_chars: int) -> Cut:
    """The place after the first ``unit`` units; decompresses one frame at most."""
    if unit <= 0 or not frames:
        return Cut(0, 0, 0)
    if unit >= n_units:
        return Cut(len(frames), 0, n_chars)
    low, high = 0, len(frames)  # the last frame with fewer units before it
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if frames[middle]["units"] < unit else (low, middle)
    piece = next(pieces([frames[low]]))
    offset = -1
    for _ in range(unit - frames[low]["units"]):
        offset = piece.index(b"\n", offset + 1)
    return Cut(low, offset + 1, frames[low]["chars"] + code_points(piece[: offset + 1]))


def between(frames: Sequence[dict], start: Cut, stop: Cut, params: FrameParams = FrameParams()) -> list[bytes]:
    """Compressed frames of the text between two places. Whole frames are taken as they are."""
    out: list[bytes] = []
    for i in range(start.frame, min(stop.frame + 1, len(frames))):
        low, high = (start.offset if i == start.frame else 0), (stop.offset if i == stop.frame else None)
        if low == 0 and high is None:
            out.append(frames[i]["data"])
        elif high is None or high > low:
            piece = next(pieces([frames[i]]))[low:high]
            if piece:
                out.append(zstandard.ZstdCompressor(level=params.level).compress(piece))
    return out


def store(docs: DataFrame, watched: Sequence[str] = (), params: FrameParams = FrameParams()) -> DataFrame:
    """``doc_id, n_units, n_chars, holds, frames`` of every row of ``docs``; written to the shared folder."""
    marks = [w.encode() for w in watched]

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(block.column("text"))
        columns: list[list] = [[], [], [], []]
        for i in range(len(texts)):
            text = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
            frames = framed(text, params)
            open_end = bool(text) and not text.endswith(b"\n")
            row = (
                text.count(b"\n") + open_end, code_points(text),
                [w for w, mark in zip(watched, marks, strict=True) if mark in text], frames,
            )
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), FRAMES_ARROW)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([block.column("doc_id"), *arrays], ["doc_id", "n_units", "n_chars", "holds", "frames"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, n_units long, n_chars long, holds array<string>, frames {FRAMES}"
    return land(rows.mapInArrow(by_block("text", work), schema), "frames")
