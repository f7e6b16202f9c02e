"""Runs of repeated words (maximal repetitions) and texts without them.

A run is a stretch of words with smallest period q and at least ``exponent`` times q words that cannot be made
longer with that period. The words of a text are sorted by suffix (prefix doubling on arrays, all texts of a block
together), and the suffixes are united by decreasing length of the prefix they share (LCP), as Kruskal's
method adds edges: a union-find structure over classes, each with its positions in order, the smaller one put into the
larger. Two positions of different classes that become neighbours at a distance d within their LCP start with
the same d words twice: they seed a run. Every run is seeded by its own first position, with its
smallest period, so seeds that could start a word earlier are left out and nothing has to be merged. Uniting
stops at the LCP below which no run can be long enough.

Words are runs of anything but blank and the control characters 9 to 13. Null and empty texts and texts without
words have no runs. Rows are kept one by one, whatever their id; a null id is taken as an empty text where ids are
hashed; extra columns are ignored or, in ``collapse_runs``, kept; an empty table gives an empty one. Texts are whole: working
memory is some arrays over the words of a block of texts or of one longer text, one more each time the
longest repeat doubles. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.text_bytes import Texts, Words, by_block, byte_class, texts_of

WORD_BYTES = byte_class((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))


@dataclass(frozen=True)
class RunParams:
    exponent: int = 4  # how often the period must fit
    words: int = 6  # least length

    def long_enough(self, period, length):
        return (length >= self.words) & (length >= self.exponent * period)

    @property
    def least_lcp(self) -> int:
        """The smallest LCP that can seed a run."""
        return min(max(self.words - d, (self.exponent - 1) * d) for d in range(1, self.words + 1))


class Positions:
    """Positions in order, in pieces of bounded length, so that one more costs little in a large class."""

    PIECE = 1_000

    def __init__(self, position: int):
        self.pieces, self.tops, self.size = [[position]], [position], 1

    def _at(self, position: int) -> tuple[int, int]:
        i = min(bisect_left(self.tops, position), len(self.pieces) - 1)
        return i, bisect_left(self.pieces[i], position)

    def add(self, position: int) -> None:
        i, j = self._at(position)
        piece = self.pieces[i]
        piece.insert(j, position)
        self.tops[i] = piece[-1]
        self.size += 1
        if len(piece) > 2 * self.PIECE:
            self.pieces[i : i + 1] = [piece[: self.PIECE], piece[self.PIECE :]]
            self.tops[i : i + 1] = [piece[self.PIECE - 1], piece[-1]]

    def neighbours(self, position: int) -> tuple[int | None, int | None]:
        """The positions before and after one that is in here."""
        i, j = self._at(position)
        piece = self.pieces[i]
        before = piece[j - 1] if j else (self.pieces[i - 1][-1] if i else None)
        if j + 1 < len(piece):
            return before, piece[j + 1]
        return before, (self.pieces[i + 1][0] if i + 1 < len(self.pieces) else None)

    def __iter__(self):
        for piece in self.pieces:
            yield from piece


def sorted_suffixes(words: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, within their texts, and ranks by their first 1, 2, 4, ... words.

    Two suffixes have equal ranks on a level exactly if these words are the same, in the same text.
    """
    n = len(words)
    order = np.lexsort((words, owners))
    change = np.ones(n, dtype=bool)
    change[1:] = (words[order[1:]] != words[order[:-1]]) | (owners[order[1:]] != owners[order[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    places = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(change, places, 0))
    ends = np.searchsorted(owners, owners, side="right") if n else places
    levels, span = [rank], 1
    while True:
        single = change & np.append(change[1:], True)
        still = places[~single]
        if not len(still):
            return order, levels
        at = order[still]
        nexts = np.where(at + span < ends[at], rank[np.minimum(at + span, n)], -1)
        by = np.lexsort((nexts, rank[at]))
        at, nexts = at[by], nexts[by]
        order[still] = at
        new = np.ones(len(at), dtype=bool)
        new[1:] = (rank[at[1:]] != rank[at[:-1]]) | (nexts[1:] != nexts[:-1])
        change[still] = new
        finer = rank.copy()
        finer[at] = still[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank = finer
        levels.append(rank)
        span *= 2


def shared_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the order of suffixes and the number of words they share, where it is ``least`` or more."""
    a, b = order[:-1], order[1:]
    floor = max(least.bit_length() - 1, 0)  # the greatest level that all of these share
    if floor >= len(levels):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    near = levels[floor][a] == levels[floor][b]
    a, b = a[near], b[near]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared[levels[k][a + shared] == levels[k][b + shared]] += 1 << k
    enough = shared >= least
    return a[enough], b[enough], shared[enough]


def seeds(a: np.ndarray, b: np.ndarray, shared: np.ndarray, params: RunParams) -> list[tuple[int, int, int]]:
    """``position, distance, lcp`` of positions that become neighbours within their LCP, longest LCP first."""
    found: list[tuple[int, int, int]] = []
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x] = x
            classes[x] = Positions(x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in np.argsort(-shared, kind="stable").tolist():
        lcp = int(shared[k])
        large, small = root(int(a[k])), root(int(b[k]))
        if classes[large].size < classes[small].size:
            large, small = small, large
        parent[small] = large
        into, moved = classes[large], classes.pop(small)
        for x in moved:
            into.add(x)
        own = None if moved.size == 1 else set(moved)
        for x in moved:
            before, after = into.neighbours(x)
            for low, high in ((before, x), (x, after)):
                if low is None or high is None or high - low > lcp:
                    continue
                other = low if high == x else high
                if own is not None and other in own:
                    continue
                if params.long_enough(high - low, lcp + high - low):
                    found.append((low, high - low, lcp))
    return found


def runs(words: np.ndarray, owners: np.ndarray, params: RunParams = RunParams()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs, by start and then period. ``owners`` ascends."""
    nothing = np.zeros(0, np.int64)
    if not len(words):
        return nothing, nothing, nothing
    found = seeds(*shared_prefixes(*sorted_suffixes(words, owners), params.least_lcp), params)
    if not found:
        return nothing, nothing, nothing
    start, period, lcp = np.array(found, np.int64).T
    before = np.maximum(start - 1, 0)
    first = (start == 0) | (owners[before] != owners[start]) | (words[before] != words[before + period])
    start, period, length = start[first], period[first], (lcp + period)[first]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def planted(words: Words, ids: list[int | None]) -> np.ndarray:
    """Which word stands at each place once one text in ten has been made periodic from some word on.

    Which texts, from where and with what period follows from the crc32 of the id.
    """
    source = np.arange(len(words))
    for i, doc_id in enumerate(ids):
        h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        low, high = int(words.first[i]), int(words.first[i + 1])
        n, g = high - low, h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[low + a : high] = low + a + np.arange(n - a) % p
    return source


def _texts(texts: Texts, words: Words, source: np.ndarray, dropped: np.ndarray) -> list[bytes]:
    """Kept words of every text, with a blank between."""
    out = []
    for i in range(len(texts)):
        low, high = int(words.first[i]), int(words.first[i + 1])
        split = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().split()
        places = (source[low:high] - low)[~dropped[low:high]]
        same = len(places) == len(split) and bool((places == np.arange(len(places))).all())
        out.append(b" ".join(split if same else [split[k] for k in places.tolist()]))
    return out


def _repeats(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that some run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:-1]) > 0


def periodic_runs(docs: DataFrame, params: RunParams = RunParams()) -> DataFrame:
    """One row per run: ``doc_id, start, length, period``, in words, numbered from 0."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(texts_of(block.column("text")), WORD_BYTES)
        owners = words.owners()
        start, length, period = runs(words.hashes(), owners, params)
        of = owners[start]
        columns = [block.column("doc_id").take(pa.array(of)), *map(pa.array, (start - words.first[of], length, period))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "period"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(by_block("text", work), "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame, params: RunParams = RunParams()) -> DataFrame:
    """``docs`` with every run cut down to its first period. Texts without runs stay as they are."""
    at = docs.columns.index("text")

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(block.column(at))
        words = Words(texts, WORD_BYTES)
        owners = words.owners()
        found = runs(words.hashes(), owners, params)
        new = block.column(at).to_pylist()
        collapsed = _texts(texts, words, np.arange(len(words)), _repeats(len(words), *found))
        for i in np.unique(owners[found[0]]).tolist():
            new[i] = collapsed[i].decode("utf-8", "replace")
        arrays = list(block.columns)
        arrays[at] = pa.array(new, arrays[at].type)
        return pa.RecordBatch.from_arrays(arrays, block.schema.names)

    return docs.mapInArrow(by_block("text", work), docs.schema)


def run_report(docs: DataFrame, params: RunParams = RunParams()) -> DataFrame:
    """One row per row of ``docs``, with one text in ten made periodic first (``planted``): ``doc_id, n_runs``, the longest
    run's ``start, length, period, exponent_milli``, and digests ``runs_sha256, collapsed_sha256``.
    """
    names = ["n_runs", "start", "length", "period", "exponent_milli"]

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(block.column("text"))
        words = Words(texts, WORD_BYTES)
        source = planted(words, block.column("doc_id").to_pylist())
        owners = words.owners()
        start, length, period = runs(words.hashes()[source], owners, params)
        collapsed = _texts(texts, words, source, _repeats(len(words), start, length, period))
        cuts = np.searchsorted(start, words.first)
        columns: dict[str, list] = {name: [] for name in [*names, "runs_sha256"]}
        for i in range(len(texts)):
            here = slice(int(cuts[i]), int(cuts[i + 1]))
            own = list(zip((start[here] - words.first[i]).tolist(), length[here].tolist(), period[here].tolist(), strict=True))
            best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
            milli = 1000 * best[1] // best[2] if own else None
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in own)
            row = (len(own), *best, milli, hashlib.sha256(lines.encode()).hexdigest())
            for name, value in zip(columns, row, strict=True):
                columns[name].append(value)
        arrays = [pa.array(columns[name], pa.int64()) for name in names]
        digests = [hashlib.sha256(text).hexdigest() for text in collapsed]
        arrays += [pa.array(columns["runs_sha256"], pa.string()), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(
            [block.column("doc_id"), *arrays], ["doc_id", *names, "runs_sha256", "collapsed_sha256"]
        )

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in names) + ", runs_sha256 string, collapsed_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_block("text", work), schema)
