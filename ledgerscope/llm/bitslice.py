"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to whole numbers. The index keeps blocks of rows; in a block, bit b of
component d of all rows is one bitmap. For a query the bitmaps are added as numbers are added in columns,
a full adder for three bitmaps at a time, which leaves the scores of all rows as bitmaps again. The
top rows are selected from the most significant bitmap downward; rows that tie at the boundary are
resolved by id, and the few selected rows are scored once more as whole numbers.

Every row is indexed, so the result is exact and recall is 1. Queries are met in groups with every block;
their copies, not the blocks', travel. Null vectors, vectors with a null or non-finite
component, and rows without an id take no part. Vectors with a component of ``wide`` or more, whose scores may not fit 64 bits, are
not in the bitmaps: they are met in blocks as well and scored in whole numbers of any size. Ranks follow the
exact scores; a score beyond 64 bits is given as the largest or smallest such number. Shorter vectors count as filled up with
zeros. An empty table on either side gives no rows; extra columns are ignored. Repeated ids are rows of their own, and so are repeated queries: each has its own k best rows. A query is
never matched with rows of its own id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.session import land

U64 = np.uint64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

@dataclass(frozen=True)
class SearchParams:
    k: int = 5
    scale: int = 256
    block_rows: int = 16_384
    chunk_queries: int = 256  # queries in one row
    group_queries: int = 4_096  # queries that a task takes with a block
    wide: float = 65_536.0  # components from here on go the way of whole numbers of any size; 24 bits in the bitmaps
    wide_rows: int = 1_024  # rows of a block there


class Block:
    """Rows of one block, as numbers and as bitmaps, sorted by id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        n, width = values.shape
        self.words = -(-n // 64)
        codes = self.values - (self.values.min(0) if n else 0)
        self.bits = int(codes.max()).bit_length() if codes.size else 0
        self.slices = np.zeros((width, self.bits, self.words), U64)
        for b in range(self.bits):
            self.slices[:, b] = self._bitmaps(((codes >> b) & 1).T)
        self.all = self._bitmaps(np.ones((1, n), np.int64))[0]

    @classmethod
    def restored(cls, row: dict) -> Block:
        """The block of a row of the index."""
        self = cls.__new__(cls)
        n, width = row["n"], row["width"]
        self.words, self.bits = -(-n // 64), row["bits"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.values = np.frombuffer(row["numbers"], np.int32).reshape(n, width).astype(np.int64)
        self.slices = np.frombuffer(row["slices"], U64).reshape(width, self.bits, self.words)
        self.all = self._bitmaps(np.ones((1, n), np.int64))[0]
        return self

    def _bitmaps(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(flags), self.words * 64), np.uint8)
        padded[:, : flags.shape[1]] = flags
        return np.packbits(padded, axis=1, bitorder="little").view(U64)

    def summed(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the scores of all rows, up to a constant, least significant first.

        A negative weight takes the complement, which counts down from the largest code.
        """
        columns: dict[int, list[np.ndarray]] = {}
        size = np.abs(weights)
        for bit in range(int(size.max()).bit_length() if len(size) else 0):
            has = (size >> bit) & 1 == 1
            for b in range(self.bits):
                rows = self.slices[:, b]
                parts = [rows[has & (weights > 0)], ~rows[has & (weights < 0)]]
                columns.setdefault(bit + b, []).extend(p for p in parts if len(p))
        out: list[np.ndarray] = []
        place = 0
        while any(p >= place for p in columns):
            stack = columns.pop(place, [])
            bitmaps = np.concatenate(stack) if stack else np.zeros((0, self.words), U64)
            carries = []
            while len(bitmaps) > 2:
                third = len(bitmaps) // 3
                a, b, c = bitmaps[:third], bitmaps[third : 2 * third], bitmaps[2 * third : 3 * third]
                either = a ^ b
                carries.append((a & b) | (c & either))
                bitmaps = np.concatenate([either ^ c, bitmaps[3 * third :]])
            if len(bitmaps) == 2:
                carries.append((bitmaps[0] & bitmaps[1])[None])
                bitmaps = (bitmaps[0] ^ bitmaps[1])[None]
            if carries:
                columns.setdefault(place + 1, []).extend(carries)
            out.append(bitmaps[0] if len(bitmaps) else np.zeros(self.words, U64))
            place += 1
        return out

    def top(self, query: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of the block ; the smaller id wins a tie."""
        width = self.values.shape[1]
        weights = np.zeros(width, np.int64)
        weights[: min(width, len(vector))] = vector[:width]
        open_rows = self.all.copy()
        first, last = np.searchsorted(self.ids, [query, query + 1])
        for row in range(first, last):
            open_rows[row >> 6] &= ~(U64(1) << U64(row & 63))
        sure = np.zeros(self.words, U64)
        for bitmap in reversed(self.summed(weights)):
            upper = open_rows & bitmap
            count = int(np.bitwise_count(sure | upper).sum())
            if count > k:
                open_rows = upper
            else:
                sure |= upper
                open_rows &= ~bitmap
                if count == k:
                    open_rows[:] = 0
                    break
        chosen = _places(sure)
        tied = _places(open_rows)[: k - len(chosen)]  # rows lie in the order of ids
        rows = np.concatenate([chosen, tied])
        return self.ids[rows], self.values[rows] @ weights


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def taking_part(vectors: DataFrame, params: SearchParams, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x, wide, row``: every vector that takes part, numbered; written."""
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return land(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("x"))
        .where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(
            "vec_id", "x", F.exists("x", lambda x: F.abs(x) >= params.wide).alias("wide"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "vectors",
    )


def _quantised(rows: DataFrame, params: SearchParams) -> DataFrame:
    """``vec_id, v, row`` of the vectors that are not wide."""
    v = F.transform("x", lambda x: F.floor(x * params.scale).cast("long"))
    return rows.where("not wide").select("vec_id", v.alias("v"), "row")


def whole_number(x: float, scale: int) -> int:
    """floor(scale * x) without rounding; ``scale`` is a power of two."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def ordered_bytes(score: int) -> bytes:
    """Bytes that sort as the numbers do, whatever their size."""
    size = (abs(score).bit_length() + 7) // 8
    digits = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + digits if score >= 0 else b"\0" + bytes(255 - b for b in digits)


def _found(rows: list[int], queries: list[int], ids: list[int], scores: list[int]) -> pa.Table:
    fitting = [min(max(s, _LEAST), _MOST) for s in scores]
    columns = [pa.array(c, pa.int64()) for c in (rows, queries, ids, fitting)]
    return pa.table([*columns, pa.array(map(ordered_bytes, scores), pa.binary())], _FOUND_NAMES)


_FOUND_NAMES = ["query_row", "query_id", "vec_id", "score", "exact"]
_FOUND = "query_row long, query_id long, vec_id long, score long, exact binary"


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of a sorted partition, by the number in their first column."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if stop > start:
                if held and numbers[start] != now:
                    yield now, pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = int(numbers[start])
                held.append(batch.slice(start, stop - start))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks())


_BLOCK = "block int, n int, width int, bits int, ids binary, numbers binary, slices binary"
_CHUNK = "chunk int, n int, asked binary, ids binary, numbers binary"


def _pack_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, table in _runs(batches):
        block = Block(*_vectors(table))
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "block": number, "n": len(block.ids), "width": block.values.shape[1], "bits": block.bits,
                    "ids": block.ids.tobytes(), "numbers": block.values.astype(np.int32).tobytes(),
                    "slices": block.slices.tobytes(),
                }
            ],
            schema=pa.schema(
                [(c, pa.int32()) for c in ("block", "n", "width", "bits")]
                + [(c, pa.binary()) for c in ("ids", "numbers", "slices")]
            ),
        )


def _pack_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, table in _runs(batches):
        ids, values = _vectors(table)
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "chunk": number, "n": len(ids), "asked": table.column("row").to_numpy().tobytes(),
                    "ids": ids.tobytes(), "numbers": values.astype(np.int32).tobytes(),
                }
            ],
            schema=pa.schema(
                [("chunk", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("asked", "ids", "numbers")]
            ),
        )


def _dealt(rows: DataFrame, name: str, parts: int) -> DataFrame:
    """Written rows dealt evenly to ``parts`` numbers by their own number, and sorted by these."""
    number = F.pmod("row", F.lit(parts)).cast("int")
    return rows.withColumn(name, number).repartition(parts, name).sortWithinPartitions(name).select(name, *rows.columns)


def build_index(rows: DataFrame, n_blocks: int) -> DataFrame:
    """One row per block of quantised vectors, with its bitmaps; written to the shared folder."""
    return land(_dealt(rows, "block", n_blocks).mapInArrow(_pack_blocks, _BLOCK), "index")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    params: SearchParams = SearchParams(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best of ``vectors`` for every row of ``queries``."""
    rows = taking_part(vectors, params, id_col, vector_col)
    asked = taking_part(queries, params, id_col, vector_col)
    local = _by_bitmaps(_quantised(rows, params), _quantised(asked, params), params)
    if not rows.where("wide").isEmpty():
        local = local.unionByName(_by_numbers(rows.where("wide"), asked, params))
    if not asked.where("wide").isEmpty():
        local = local.unionByName(_by_numbers(rows.where("not wide"), asked.where("wide"), params))
    order = Window.partitionBy("query_row").orderBy(F.desc("exact"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= params.k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _by_bitmaps(rows: DataFrame, asked: DataFrame, params: SearchParams) -> DataFrame:
    """The k best of each block for every query, through the index."""
    n_asked = asked.count()
    n_blocks = max(1, -(-rows.count() // params.block_rows))
    n_chunks = max(1, -(-n_asked // params.chunk_queries))
    n_groups = max(1, -(-n_asked // params.group_queries))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    tasks = n_blocks * n_groups
    index = (
        build_index(rows, n_blocks).withColumn("part", every_group).repartition(tasks, "block", "part")
    )
    chunks = (
        _dealt(asked, "chunk", n_chunks)
        .mapInArrow(_pack_chunks, _CHUNK)
        .withColumn("part", F.pmod("chunk", F.lit(n_groups)))
        .withColumn("block", every_block)
        .repartition(tasks, "block", "part")
    )

    def search(of_block: pa.Table, of_chunks: pa.Table) -> pa.Table:
        found: list[list[int]] = [[], [], [], []]
        for row in of_block.to_pylist():
            block = Block.restored(row)
            for chunk in of_chunks.to_pylist():
                ids = np.frombuffer(chunk["ids"], np.int64)
                vectors = np.frombuffer(chunk["numbers"], np.int32).reshape(len(ids), -1).astype(np.int64)
                numbers = np.frombuffer(chunk["asked"], np.int64).tolist()
                for number, query, vector in zip(numbers, ids.tolist(), vectors, strict=True):
                    best, score = block.top(query, vector, params.k)
                    for column, values in zip(found, ([number] * len(best), [query] * len(best), best.tolist(), score.tolist()), strict=True):
                        column += values
        return _found(*found)

    return index.groupBy("block", "part").cogroup(chunks.groupBy("block", "part")).applyInArrow(search, _FOUND)


def _by_numbers(rows: DataFrame, asked: DataFrame, params: SearchParams) -> DataFrame:
    """The k best of each block for every query, scored in whole numbers of any size."""
    n_blocks = max(1, -(-rows.count() // params.wide_rows))
    n_groups = max(1, -(-asked.count() // params.group_queries))
    blocks = rows.select(
        F.pmod("row", F.lit(n_blocks)).cast("int").alias("block"), "vec_id", "x",
        F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("part"),
    )
    parts = asked.select(
        F.pmod("row", F.lit(n_groups)).cast("int").alias("part"), "vec_id", "x", "row",
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
    )
    scale, k = params.scale, params.k

    def numbers(table: pa.Table) -> list[list[int]]:
        return [[whole_number(x, scale) for x in v] for v in table.column("x").to_pylist()]

    def search(of_block: pa.Table, of_queries: pa.Table) -> pa.Table:
        ids, vectors = of_block.column("vec_id").to_pylist(), numbers(of_block)
        found: list[list[int]] = [[], [], [], []]
        asked_rows, asked_ids = of_queries.column("row").to_pylist(), of_queries.column("vec_id").to_pylist()
        for number, query, vector in zip(asked_rows, asked_ids, numbers(of_queries), strict=True):
            scored = (
                (-sum(a * b for a, b in zip(vector, other, strict=False)), i)
                for i, other in zip(ids, vectors, strict=True) if i != query
            )
            for negated, i in heapq.nsmallest(k, scored):
                for column, value in zip(found, (number, query, i, -negated), strict=True):
                    column.append(value)
        return _found(*found)

    return blocks.groupBy("block", "part").cogroup(parts.groupBy("block", "part")).applyInArrow(search, _FOUND)
