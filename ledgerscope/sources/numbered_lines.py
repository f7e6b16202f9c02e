"""Text lines with an id that a repeated delivery repeats: the file's name and the byte at which the line begins.

Spark's own file streams give lines without a place. Here a Python data source lists the folder, cuts files into byte ranges
(a task has one or, if they are small, several; a line belongs to the range it begins in) and hands lines to Spark in Arrow
batches; fields are then parsed by Spark's ``from_csv``. The offset of a stream is the number of bytes taken of every file in the folder, so a run
that starts again from its checkpoint reads the same ranges and gives the same ids. Files that are done may be moved
away: the offset names only what is there.

Files are read through ``pyarrow.fs``: local and shared folders, ``s3a://`` and what else pyarrow reaches.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ledgerscope.schemas import RAW_TRANSACTION
from ledgerscope.sources.files import CSV_OPTIONS, empty_as_text, with_bad_line

SCHEMA = "file string, line_start bigint, line string"
BLOCK = 1 << 20  # bytes read at once
SPLIT = 64 << 20  # bytes of one range
TASKS_PER_CORE = 4
DELIVERY = "([^/]+)$"  # the name without its folder
WHOLE = "(?s)(.*)"


@dataclass
class ByteRange:
    """Lines of ``file`` that begin from ``start`` to before ``stop``; none goes beyond ``end``."""

    file: str
    start: int
    stop: int
    end: int
    line_under_way: bool  # whether byte ``start`` may lie within a line of the range before


@dataclass
class Ranges(InputPartition):
    """What one task reads. Starting one costs about as much as reading some megabytes, so small ranges go together."""

    ranges: list[ByteRange]


class _Folder:
    """What both readers share: the files of the folder and how their bytes become lines."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.header = options.get("header", "true") == "true"
        self.growing = options.get("growing", "false") == "true"
        self.split = int(options.get("split", SPLIT))
        self.tasks = int(options.get("tasks", 1))

    def _open(self) -> tuple[fs.FileSystem, str]:
        path = self.path.replace("s3a://", "s3://", 1)
        if path.startswith("file:"):
            path = "/" + path[len("file:"):].lstrip("/")
        return fs.FileSystem.from_uri(path)

    def _ends(self) -> dict[str, int]:
        """Bytes to take of every file. Names that begin with a dot or an underscore are not data, as elsewhere in Spark."""
        system, root = self._open()
        ends = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            name = info.path[len(root):].lstrip("/")
            if info.type == fs.FileType.File and not any(part[0] in "._" for part in name.split("/")):
                ends[name] = self._last_line_end(system, info) if self.growing else info.size
        return ends

    @staticmethod
    def _last_line_end(system: fs.FileSystem, info: fs.FileInfo) -> int:
        with system.open_input_file(info.path) as file:
            stop = info.size
            while stop:
                start = max(0, stop - BLOCK)
                cut = file.read_at(stop - start, start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                stop = start
        return 0

    def _tasks(self, starts: dict[str, int], ends: dict[str, int]) -> list[Ranges]:
        """All ranges in about ``tasks`` tasks, or more: none has more than ``SPLIT`` bytes and one range."""
        ranges = self._ranges(starts, ends)
        most = min(sum(part.stop - part.start for part in ranges) // self.tasks, SPLIT)
        tasks, size = [], 0
        for part in ranges:
            if not tasks or size >= most:
                tasks.append(Ranges([]))
                size = 0
            tasks[-1].ranges.append(part)
            size += part.stop - part.start
        return tasks

    def _ranges(self, starts: dict[str, int], ends: dict[str, int]) -> list[ByteRange]:
        ranges = []
        for name, end in sorted(ends.items()):
            first = starts.get(name, 0)
            if end < first:
                raise ValueError(f"{name} had {first} bytes and now has {end}: files may grow, not be rewritten")
            if 0 < first < end and not self._ends_line(name, first):
                raise ValueError(f"the last line of {name} was taken before it was whole: read with growing=True")
            for start in range(first, end, self.split):
                ranges.append(ByteRange(name, start, min(start + self.split, end), end, start > first))
        return ranges

    def _ends_line(self, name: str, at: int) -> bool:
        system, root = self._open()
        with system.open_input_file(f"{root}/{name}") as file:
            return file.read_at(1, at - 1) == b"\n"

    def read(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        system, root = self._open()
        for part in task.ranges:
            yield from self._read_range(system, root, part)

    def _read_range(self, system: fs.FileSystem, root: str, part: ByteRange) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(f"{root}/{part.file}") as file:
            for begin, text in _whole_lines(file, part):
                starts, lines = _split_lines(text)
                starts += begin
                kept = starts < part.stop
                if self.header:
                    kept &= starts != 0
                starts, lines = starts[kept], lines.filter(pa.array(kept))
                if len(starts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(part.file), len(starts)), pa.array(starts), _as_text(lines)],
                        ["file", "line_start", "line"],
                    )


def _split_lines(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """Where the lines that are not blank begin, and these lines without their ends."""
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == ord("\n"))
    starts, stops = np.append(0, ends + 1), np.append(ends, len(text))
    stops = stops - ((stops > starts) & (data[stops - 1] == ord("\r")))
    full = stops > starts
    starts, stops = starts[full], stops[full]
    # Lines and what lies between them take turns.
    borders = np.append(np.column_stack([starts, stops]).ravel(), len(text)).astype(np.int64)
    pieces = pa.Array.from_buffers(
        pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.tobytes()), pa.py_buffer(text)]
    )
    return starts.astype(np.int64), pieces.take(pa.array(np.arange(0, len(borders) - 1, 2))).cast(pa.binary())


def _as_text(lines: pa.Array) -> pa.Array:
    try:
        return lines.cast(pa.string())
    except pa.ArrowInvalid:
        # Bytes that are no UTF-8 become the replacement character, as in Spark's CSV reader.
        return pa.array([line.decode("utf-8", "replace") for line in lines.to_pylist()], pa.string())


def _whole_lines(file: pa.NativeFile, part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """Pieces of some whole lines each, with the byte they begin at, until all lines that begin in the range are there."""
    # From one byte before: a line that begins exactly at ``start`` is this range's own.
    begin = read_to = part.start - 1 if part.line_under_way else part.start
    skip = part.line_under_way
    file.seek(begin)
    unfinished: list[bytes] = []
    while begin < part.stop:
        block = file.read(min(BLOCK, part.end - read_to))
        read_to += len(block)
        cut = block.rfind(b"\n") + 1
        if block and not cut:
            unfinished.append(block)
            continue
        text = b"".join([*unfinished, block[:cut]])
        unfinished = [block[cut:]]
        if skip and text:
            skip = False
            first = text.find(b"\n") + 1 or len(text)
            begin, text = begin + first, text[first:]
        if text and begin < part.stop:
            yield begin, text
        begin += len(text)
        if not block:
            return


class _BatchReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return self._tasks({}, self._ends())


class _StreamReader(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._ends(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return self._tasks(json.loads(start["files"]), json.loads(end["files"]))

    def commit(self, end: dict) -> None:
        """Nothing is held for offsets that are done."""


class NumberedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _options(spark: SparkSession, header: bool, growing: bool, split: int) -> dict[str, str]:
    # By value: the processes that plan and read need not find this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.dataSource.register(NumberedLines)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    tasks = str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return {"header": str(header).lower(), "growing": str(growing).lower(), "split": str(split), "tasks": tasks}


def read_lines(
    spark: SparkSession, path: str, header: bool = True, growing: bool = False, split: int = SPLIT
) -> DataFrame:
    """Lines of all files below a folder: ``file`` (below the folder), ``line_start`` (bytes) and ``line``.

    Blank lines and, with ``header``, the first line of each file are left out. ``growing`` is for files that are still
    written to: a last line without its end is left for later. An empty folder has no lines. A task holds a few
    blocks of ``BLOCK`` bytes, or one line if it is longer.
    """
    return spark.read.format("numbered_lines").options(**_options(spark, header, growing, split)).load(path)


def stream_lines(
    spark: SparkSession, path: str, header: bool = True, growing: bool = False, split: int = SPLIT
) -> DataFrame:
    """Like `read_lines`, as a stream: each batch has the new files and what others have grown by."""
    return spark.readStream.format("numbered_lines").options(**_options(spark, header, growing, split)).load(path)


def delivered_lines(lines: DataFrame, delivery: str = DELIVERY) -> DataFrame:
    """Numbered lines with the part of the file's name that a repeated delivery repeats in place of ``file``.

    ``drop_seen(delivered_lines(lines), ["file", "line_start"], place="line_start")`` keeps each line of repeated deliveries once, before
    its fields are parsed. ``numbered_transactions`` then takes the whole of ``file``: ``delivery=WHOLE``.
    """
    return lines.withColumn("file", F.regexp_extract("file", delivery, 1))


def numbered_transactions(lines: DataFrame, delivery: str = DELIVERY) -> DataFrame:
    """Transactions as by ``read_transactions``, with ``message_id``, from numbered lines.

    ``delivery`` is a pattern whose first group is the part of a file's name that a repeated delivery repeats. The id
    is that part, a colon and the line's first byte. By default it is the name without its folder.
    """
    fields = with_bad_line(RAW_TRANSACTION)
    ddl = ", ".join(f"{field.name} string" for field in fields)
    options = {name: value for name, value in CSV_OPTIONS.items() if name != "header"}
    record = F.from_csv("line", ddl, options).alias("record")
    delivered = F.col("file") if delivery == WHOLE else F.regexp_extract("file", delivery, 1)
    message_id = F.concat_ws(":", delivered, "line_start").alias("message_id")
    rows = lines.select(record, message_id).select("message_id", "record.*")
    return empty_as_text(rows)
