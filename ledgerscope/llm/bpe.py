"""Byte-level BPE: speculate and verify.

Texts are cut into pieces by the tokenizer's pattern. For every new piece a greedy longest
match proposes tokens. A sequence of tokens is what merging by rank would give exactly if no merge
ever crosses a border between neighbours, and that can be read off each pair of neighbours
alone: some part on the right edge of the left token and some part on the left edge of the right one
would have to merge before either is merged inside its own token. All pairs are tested at
once on arrays; only pieces with a failing pair are merged step by step.

Null is an empty text: no tokens, and the digests of nothing. Rows are kept one by one, whatever
their id; extra columns are ignored by ``encoded`` and kept by ``with_tokens``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.text_bytes import by_block

MOST_PIECES = 400_000  # pieces remembered by a worker before it starts anew
_NEVER = np.int32(2**31 - 1)

# Letters and numbers of Unicode versions after 16, which the pattern takes as neither.
NEWER_CHARACTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686
16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479
3D000-3FC3F
"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges by rank, and the edges of every token's merge tree, as plain arrays."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.key = hashlib.sha256(json.dumps([stored["model"], pattern]).encode()).hexdigest()
        letters = byte_letters()
        names = stored["model"]["vocab"]
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.pattern, self.special = pattern, special
        self.spelling: list[bytes] = [b""] * (1 + max([*names.values(), *special.values()]))
        for name, i in names.items():
            self.spelling[i] = bytes(letters[c] for c in name)
        for name, i in special.items():
            self.spelling[i] = name.encode()
        self.ids = {self.spelling[i]: i for name, i in names.items() if name not in special}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        size = len(self.spelling)
        self.size = size
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(stored["model"]["merges"]):
            a, b = names[left], names[right]
            self.merges[a, b] = rank, names[left + right]
            made.setdefault(names[left + right], (a, b, rank))
        self.right = self._edge(made, 1)
        self.left = self._edge(made, 0)
        keys = np.array([a * size + b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.arange(len(keys), dtype=np.int32)[order]
        self.made = np.array([token for _, token in self.merges.values()], dtype=np.int64)  # by rank
        self.single = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.sizes: dict[bytes, list[int]] = {}
        for spelling in self.ids:
            self.sizes.setdefault(spelling[:2], []).append(len(spelling))
        self.sizes = {k: sorted(set(v), reverse=True) for k, v in self.sizes.items()}
        for spelling in self.ids:  # a last byte alone, or a pair that no token starts with
            if len(spelling) == 1:
                self.sizes.setdefault(spelling, [1])
        lengths = np.array([len(s) for s in self.spelling])
        self.bytes = np.frombuffer(b"".join(self.spelling), dtype=np.uint8)
        self.byte_ends = np.concatenate([[0], np.cumsum(lengths)])

    def _edge(self, made: dict[int, tuple[int, int, int]], side: int) -> tuple[np.ndarray, np.ndarray]:
        """Parts along one edge of each token, from the whole inwards, and the rank that ends each part."""
        chains = []
        for token in range(self.size):
            chain, limit = [], int(_NEVER)
            while True:
                chain.append((token, limit))
                if token not in made:
                    break
                limit = made[token][2]
                token = made[token][side]
            chains.append(chain)
        depth = max(map(len, chains))
        parts = np.full((self.size, depth), -1, np.int32)
        limits = np.zeros((self.size, depth), np.int32)
        for i, chain in enumerate(chains):
            parts[i, : len(chain)] = [c[0] for c in chain]
            limits[i, : len(chain)] = [c[1] for c in chain]
        return parts, limits

    def rank_of(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], _NEVER)


def compatible(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each pair of neighbouring tokens stays apart under merging by rank."""
    parts_l, limits_l = vocabulary.right
    parts_r, limits_r = vocabulary.left
    apart = np.ones(len(left), dtype=bool)
    for i in range(parts_l.shape[1]):
        rows = np.flatnonzero(apart & (parts_l[left, i] >= 0))
        if not len(rows):
            break
        for j in range(parts_r.shape[1]):
            rows = rows[parts_r[right[rows], j] >= 0]
            if not len(rows):
                break
            x, y = parts_l[left[rows], i], parts_r[right[rows], j]
            rank = vocabulary.rank_of(x.astype(np.int64) * vocabulary.size + y)
            # of equal ranks the leftmost merges first
            crosses = (rank < limits_l[left[rows], i]) & (rank <= limits_r[right[rows], j])
            crosses &= rank < _NEVER
            apart[rows[crosses]] = False
    return apart


def longest_match(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    ids, sizes = vocabulary.ids, vocabulary.sizes
    whole = ids.get(piece)
    if whole is not None:
        return [whole]
    out, at, end = [], 0, len(piece)
    while at < end:
        for size in sizes.get(piece[at : at + 2], (1,)):
            token = ids.get(piece[at : at + size]) if at + size <= end else None
            if token is not None:
                break
        else:
            size, token = 1, ids[piece[at : at + 1]]
        out.append(token)
        at += size
    return out


def merge_exactly(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Merging by rank, leftmost first, with a heap."""
    merges = vocabulary.merges
    tokens: list[int] = [vocabulary.ids[piece[i : i + 1]] for i in range(len(piece))]
    n = len(tokens)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = merges.get((tokens[i], tokens[i + 1]))
        if found:
            heap.append((found[0], i, tokens[i], tokens[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if tokens[i] != a or j >= n or tokens[j] != b:
            continue
        tokens[i], tokens[j] = merges[a, b][1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                found = merges.get((tokens[k], tokens[after[k]]))
                if found:
                    heapq.heappush(heap, (found[0], k, tokens[k], tokens[after[k]]))
    return [t for t in tokens if t >= 0]


def merge_together(vocabulary: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Merging by rank, one merge in every piece at a time; pieces much longer than usual go alone."""
    out: list[list[int]] = [[]] * len(pieces)
    sizes = np.array([len(p) for p in pieces])
    for low, high in ((0, 12), (12, 24), (24, 64)):
        rows = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(rows):
            for row, tokens in zip(rows.tolist(), _merge_rows(vocabulary, [pieces[r] for r in rows]), strict=True):
                out[row] = tokens
    for row in np.flatnonzero(sizes > 64).tolist():
        out[row] = merge_exactly(vocabulary, pieces[row])
    return out


def _merge_rows(vocabulary: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    sizes = np.array([len(p) for p in pieces])
    n, width = len(pieces), int(sizes.max())
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    inside = np.arange(width) < sizes[:, None]
    tokens = np.full((n, width + 1), -1, np.int64)  # one column more, so that "after the last" has a place
    tokens[:, :width][inside] = vocabulary.single[flat]
    after = np.tile(np.arange(1, width + 2), (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    ranks = np.full((n, width + 1), _NEVER, np.int32)
    ranks[:, :width] = vocabulary.rank_of(tokens[:, :-1] * vocabulary.size + tokens[:, 1:])
    ranks[:, :width][(tokens[:, :-1] < 0) | (tokens[:, 1:] < 0)] = _NEVER
    live = np.arange(n)

    def renew(rows: np.ndarray, at: np.ndarray, following: np.ndarray) -> None:
        a, b = tokens[rows, at], tokens[rows, following]
        found = vocabulary.rank_of(a * vocabulary.size + b)
        ranks[rows, at] = np.where((a >= 0) & (b >= 0), found, _NEVER)

    while len(live):
        at = ranks[live].argmin(1)
        rank = ranks[live, at]
        left = rank < _NEVER
        live, at, rank = live[left], at[left], rank[left]
        gone = after[live, at]
        tokens[live, at] = vocabulary.made[rank]
        tokens[live, gone] = -1
        ranks[live, gone] = _NEVER
        following = np.minimum(after[live, gone], width)
        after[live, at] = following
        before[live, following] = at
        renew(live, at, following)
        previous = before[live, at]
        some = previous >= 0
        renew(live[some], previous[some], at[some])
    kept = tokens >= 0
    return [row.tolist() for row in np.split(tokens[kept], np.cumsum(kept.sum(1))[:-1])]


class Encoder:
    """Encodes many texts at a time and remembers pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.spans = regex.compile(vocabulary.pattern).finditer
        spans = [[chr(int(c, 16)) for c in span.split("-")] for span in NEWER_CHARACTERS.split()]
        self.newer = re.compile("[" + "".join(f"{s[0]}-{s[-1]}" for s in spans) + "]")
        self.late = re.compile(f"[{spans[0][0]}-\U0010ffff]")  # a quick test before the exact one
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.repaired = self.seen = 0
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        if self.vocabulary.special:
            self._remember(list(self.vocabulary.special), [[i] for i in self.vocabulary.special.values()])

    def _remember(self, pieces: list[str], tokens: list[list[int]]) -> None:
        start = len(self.rows)
        self.rows.update(zip(pieces, range(start, start + len(pieces)), strict=True))
        self.counts.append(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        self.parts.append(np.array([t for row in tokens for t in row], dtype=np.uint32))

    def _ordinary(self, text: str) -> list[str]:
        if not self.late.search(text) or not self.newer.search(text):
            return self.find(text)
        masked = self.newer.sub("", text)
        return [text[m.start() : m.end()] for m in self.spans(masked)]

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self._ordinary(text)
        out = []
        for part in self.cut.split(text):
            out += [part] if part in self.vocabulary.special else self._ordinary(part)
        return out

    def _learn(self, pieces: list[str]) -> None:
        spelled = [p.encode() for p in pieces]
        tokens = [longest_match(self.vocabulary, s) for s in spelled]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.array([t for row in tokens for t in row], dtype=np.int64)
        owner = np.repeat(np.arange(len(tokens)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        size = self.vocabulary.size
        pairs, place = np.unique(flat[inner] * size + flat[inner + 1], return_inverse=True)
        apart = compatible(self.vocabulary, pairs // size, pairs % size)
        failing = np.unique(owner[inner[~apart[place]]])
        merged = merge_together(self.vocabulary, [spelled[i] for i in failing.tolist()])
        for i, row in zip(failing.tolist(), merged, strict=True):
            tokens[i] = row
        self.seen += len(pieces)
        self.repaired += len(failing)
        self._remember(pieces, tokens)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and where each text's begin and end."""
        if len(self.rows) > MOST_PIECES:
            self._forget()
        flat, ends = [], [0]
        for text in texts:
            if text:
                flat += self.pieces(text)
            ends.append(len(flat))
        new = set(flat) - self.rows.keys()
        if new:
            self._learn(sorted(new))
        if not flat:
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        rows = np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))
        self.counts, self.parts = [np.concatenate(self.counts)], [np.concatenate(self.parts)]
        tokens, of_piece = _gather(self.parts[0], self.counts[0], rows)
        return tokens, of_piece[np.array(ends)]


def _gather(values: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ragged rows of ``values`` in the order of ``rows``, and where each begins; one more for the end."""
    starts = np.cumsum(counts) - counts
    taken = counts[rows]
    ends = np.concatenate([[0], np.cumsum(taken)])
    place = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[rows], taken)
    return values[place], ends


def decode_bytes(vocabulary: Vocabulary, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their borders."""
    out, of_token = _gather(vocabulary.bytes, np.diff(vocabulary.byte_ends), tokens.astype(np.int64))
    return out, of_token[ends]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker process, so that pieces stay known from task to task."""
    if vocabulary.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.key] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.key]


def _digests(data: np.ndarray, ends: np.ndarray) -> list[str]:
    view = memoryview(np.ascontiguousarray(data).view(np.uint8))
    width = data.dtype.itemsize
    borders = (ends * width).tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(borders, borders[1:], strict=False)]


def tokenized(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of ``docs`` with ``input_ids`` and ``decoded`` put at the end (whatever is called so
    before is left out)."""
    added = {"input_ids", "decoded"}
    docs = docs.select(*[c for c in docs.columns if c not in added])
    schema = T.StructType(
        [*docs.schema, T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(sent.value)
        tokens, ends = encoder.encode(block.column("text").to_pylist())
        data, borders = decode_bytes(encoder.vocabulary, tokens, ends)
        decoded = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(borders, borders[1:], strict=False)]
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.view(np.int32)))
        return pa.RecordBatch.from_arrays(
            [*block.columns, ids, pa.array(decoded, pa.string())], [*block.schema.names, "input_ids", "decoded"]
        )

    return docs.mapInArrow(by_block("text", work), schema)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(sent.value)
        tokens, ends = encoder.encode(block.column("text").to_pylist())
        data, borders = decode_bytes(encoder.vocabulary, tokens, ends)
        return pa.RecordBatch.from_arrays(
            [
                block.column("doc_id"),
                pa.array(np.diff(ends)),
                pa.array(_digests(tokens.astype("<u4"), ends), pa.string()),
                pa.array(_digests(data, borders), pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return docs.mapInArrow(
        by_block("text", work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
