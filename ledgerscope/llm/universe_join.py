"""Exact Jaccard self-join of shingle sets by partitions of the universe.

Sets are compared within bands of sizes. In a band every token belongs to one of ``m`` segments, by a hash; a set
is cut into the subsets of its tokens in each segment. Two similar sets differ in at most H tokens, so
in any K segments at most H subsets differ: they share a whole subset if more than H are posted. This
gives three rounds, each exact for the pairs left to it (equal sets are one node all along):

1. Every set posts its first H + 1 subsets and a few more. Empty subsets and those that a sample shows to be very frequent
   are passed over, on both sides alike, and the next segments taken instead. Lists of more than ``list_size``
   sets are hot. A set with more hot lists than its few extra subsets allow for, or with too few subsets, is left over.
   Any pair with a set that is not left over shares a list that is not hot.
2. Left-over sets with more tokens of their own (held by no other left-over set) than any partner may differ in are done.
   The others are cut into fewer, larger segments, and post whole subsets and their one-deletion neighbourhoods
   (the subset without one token each). The cost of a segment is the length of its lists: it is skipped if the whole
   subset is hot, rules out one differing token if only that is posted, and two with its neighbourhood, if none of these
   lists is hot. Segments are taken in order until more than H differing tokens are ruled out.
3. Sets for which all segments are too hot share most of what they have with many others. Among themselves they
   post their first H + 1 subsets, whatever the length of the lists.

Lists are not expanded into pairs. Each links its members to its first one; links are verified on the full sets and give
components. What is left are members outside the largest component of a list: pairs of these with
the rest, as far as sizes and tokens of one's own allow, are verified too. So no link is lost that would join two components.
Before full sets are fetched, pairs are tested on parity sketches: one bit for each of about twice as many
segments as tokens, whether it holds an odd number. Every bit in which two sketches are unlike is a token in which the sets differ,
so pairs with too many of these are out for certain.

Null texts and texts without words have no shingles and are linked with nothing; sets of fewer tokens than can differ
in one are linked with equal ones only. Rows without an id take no part, their component is null. Rows of one id are
documents of their own with that id. Texts are whole, of any length: a task works on one block of texts or one longer
text. Extra columns are ignored, an empty table gives an empty one. Hashes stand for shingles (64 bits) and for sets (128 bits).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.components import components
from ledgerscope.llm.labelled import in_share
from ledgerscope.llm.near_dedup import shingle_sets
from ledgerscope.llm.text_bytes import U64, by_block, mix
from ledgerscope.session import land

_SET = ["n_shingles", "set_a", "set_b"]
_LARGEST = 1 << 31  # tokens of a set
_BLOCK_TOKENS = 400_000


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    similarity: int = 80  # per cent
    band: float = 1.5  # ratio of sizes in one band
    fine: float = 0.45  # segments of the first round for each token of the largest sets of a band
    coarse: float = 0.25  # segments of the second round
    list_size: int = 16  # longer lists are hot
    sketch: float = 2.0  # bits of a sketch for each token of the largest sets of a band
    extra: int = 32  # one more subset for so many tokens
    sample: int = 20_000  # sets on which very frequent subsets are found
    frequent: float = 0.002  # share of the sample
    passed_over: int = 200_000  # most frequent subsets that are passed over; what is not is hot at most

    def __post_init__(self):
        if not 1.25 <= self.band or not 80 <= self.similarity < 100:
            raise ValueError("bands must be at least as wide as sizes of similar sets can differ: 1.25, and similarity 80 or more")

    def differ(self, a, b):
        """Most tokens in which similar sets of these sizes differ."""
        return (100 - self.similarity) * (a + b) // (100 + self.similarity)

    def most(self, n):
        """The same for the largest partner of a set of ``n`` tokens."""
        return self.differ(n, 100 * n // self.similarity)

    def bands(self) -> np.ndarray:
        """The largest size of each band."""
        tops = [1]
        while tops[-1] < _LARGEST:
            tops.append(max(tops[-1] + 1, int((tops[-1] + 1) * self.band)))
        return np.array(tops, np.int64)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Segments:
    """Subsets of many sets by segment, in the band of each set and in the one below, if it has partners there.

    ``part`` is a pair of a set and a band. Slots are the segments of all parts, one part after the other.
    """

    def __init__(self, sets: list[np.ndarray], density: float, least: int, round_: int, params: JoinParams, multiple: int = 1):
        sizes = np.array([len(s) for s in sets], np.int64)
        tops = params.bands()
        own = np.searchsorted(tops, sizes)
        smallest = -(-params.similarity * sizes // 100)
        below = np.flatnonzero((own > 0) & (smallest <= tops[np.maximum(own - 1, 0)]))
        self.part_set = np.concatenate([np.arange(len(sets)), below])
        self.band = np.concatenate([own, own[below] - 1])
        self.n = sizes[self.part_set]
        segments = np.maximum(least, np.ceil(density * tops[self.band]).astype(np.int64))
        segments = -(-segments // multiple) * multiple
        self.first = np.concatenate([[0], np.cumsum(segments)])
        flat = np.concatenate(sets) if sets else np.zeros(0, U64)
        starts = np.cumsum(sizes) - sizes
        self.token = flat[_spans(starts[self.part_set], self.n)]
        self.token_part = np.repeat(np.arange(len(self.n)), self.n)
        salt = mix((self.band.astype(U64) << U64(8)) + U64(round_))
        where = mix(self.token ^ salt[self.token_part]) >> U64(33)
        self.slot = self.first[self.token_part] + (where % segments[self.token_part].astype(U64)).astype(np.int64)
        self.part = np.repeat(np.arange(len(self.n)), segments)
        self.segment = np.arange(self.first[-1]) - self.first[self.part]
        self.count = np.bincount(self.slot, minlength=self.first[-1])
        self.mixed = mix(self.token + U64(1))
        self.sums = np.zeros(self.first[-1], U64)
        np.add.at(self.sums, self.slot, self.mixed)
        self.salt = mix(salt[self.part] + self.segment.astype(U64))

    def whole(self) -> np.ndarray:
        """A number for the subset in each slot."""
        return mix(self.sums + self.salt)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Slot and number of each subset without one of its tokens; no empty ones."""
        tokens = np.flatnonzero(self.count[self.slot] > 1)
        at = self.slot[tokens]
        return at, mix(self.sums[at] - self.mixed[tokens] + self.salt[at])

    def leading(self, usable: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``wanted`` usable slots of each part, and the number that are usable at all."""
        before = np.concatenate([[0], np.cumsum(usable)])
        place = before[:-1] - before[self.first[self.part]]
        return np.flatnonzero(usable & (place < wanted[self.part])), np.diff(before[self.first])


def _known(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _posts(nodes: list[int], segments: Segments, slots: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    of = np.array(nodes, np.int64)[segments.part_set[segments.part[slots]]]
    return pa.RecordBatch.from_arrays([pa.array(of), pa.array(values.view(np.int64))], ["node", "value"])


def prints(docs: DataFrame, params: JoinParams) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b`` of ``docs(doc_id, text)``."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(block.column("text"), params.words)
        counts, keys = _set_keys(sets)
        arrays = [block.column("doc_id"), pa.array(counts), *[pa.array(keys[:, i].view(np.int64).copy()) for i in (0, 1)]]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *_SET])

    return docs.mapInArrow(by_block("text", work), "doc_id long, n_shingles long, set_a long, set_b long")


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(s) for s in sets], np.int64)
    keys = np.zeros((len(sets), 2), U64)
    full = np.flatnonzero(counts)
    if len(full):
        flat = np.concatenate(sets)
        starts = (np.cumsum(counts) - counts)[full]
        keys[full, 0] = np.add.reduceat(mix(flat), starts)
        keys[full, 1] = np.add.reduceat(mix(flat ^ U64(0x5BD1E995)), starts)
    return counts, keys


def _sets_of(block: pa.RecordBatch, params: JoinParams) -> tuple[list[int], list[np.ndarray]]:
    """Nodes of a block of texts and their sets; rows of the id that are another set, or the same once more, are left out."""
    sets = shingle_sets(block.column("text"), params.words)
    _, keys = _set_keys(sets)
    same = (keys[:, 0].copy().view(np.int64) == block.column("set_a").to_numpy()) & (
        keys[:, 1].copy().view(np.int64) == block.column("set_b").to_numpy()
    )
    nodes = block.column("node").to_pylist()
    rows = {nodes[i]: i for i in np.flatnonzero(same).tolist()}
    return list(rows), [sets[i] for i in rows.values()]


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``text, node, set_a, set_b`` for ``nodes(node, first_doc, set_a, set_b)``."""
    keyed = nodes.select(F.col("first_doc").alias("doc_id"), "node", "set_a", "set_b")
    return docs.join(keyed, "doc_id").select("text", "node", "set_a", "set_b")


def _frequent(docs: DataFrame, nodes: DataFrame, params: JoinParams) -> np.ndarray:
    """Numbers of subsets that many sets of a bounded sample have."""
    picked = nodes.where(in_share(F.xxhash64("set_a", "set_b"), params.sample, nodes.count()))

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, sets = _sets_of(block, params)
        segments = Segments(sets, params.fine, 16, 1, params)
        slots = np.flatnonzero(segments.count > 0)
        return _posts(ids, segments, slots, segments.whole()[slots])

    counts = (
        _texts_of(docs, picked).mapInArrow(by_block("text", work), "node long, value long")
        .groupBy("value").agg(F.count("*").alias("n"))
        .where(F.col("n") >= max(8, int(params.frequent * params.sample)))
        .orderBy(F.desc("n"), "value").limit(params.passed_over)
    )
    return np.sort(counts.select("value").toArrow().column("value").to_numpy().view(U64))


def first_round(docs: DataFrame, nodes: DataFrame, params: JoinParams) -> DataFrame:
    """``node, value, size, left_over``: posts in lists of two or more, and a row for each set with too few subsets."""
    skipped = docs.sparkSession.sparkContext.broadcast(_frequent(docs, nodes, params))

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, sets = _sets_of(block, params)
        segments = Segments(sets, params.fine, 16, 1, params)
        values = segments.whole()
        wanted = params.most(segments.n) + 1 + segments.n // params.extra
        slots, usable = segments.leading((segments.count > 0) & ~_known(values, skipped.value), wanted)
        few = np.unique(segments.part_set[usable < wanted])
        marked = -1 - np.array(ids, np.int64)[few]
        out = _posts(ids, segments, slots, values[slots])
        node = np.concatenate([out.column("node").to_numpy(), marked])
        value = np.concatenate([out.column("value").to_numpy(), mix(marked.view(U64)).view(np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(value)], ["node", "value"])

    posts = _texts_of(docs, nodes).mapInArrow(by_block("text", work), "node long, value long")
    size = F.count("*").over(Window.partitionBy("value"))
    kept = posts.withColumn("size", size).where("size > 1 or node < 0")
    left_over = F.col("node") < 0
    return land(
        kept.select(F.when(left_over, -1 - F.col("node")).otherwise(F.col("node")).alias("node"), "value", "size", left_over.alias("left_over")),
        "first-round",
    )


def _array(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def full_sets(docs: DataFrame, nodes: DataFrame, params: JoinParams) -> DataFrame:
    """``node, shingles`` for ``nodes(node, first_doc, set_a, set_b)``; written."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, sets = _sets_of(block, params)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _array(sets)], ["node", "shingles"])

    rows = _texts_of(docs, nodes).mapInArrow(by_block("text", work), "node long, shingles array<long>")
    return land(rows, "sets")


def _unique_sets(block: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
    column = block.column("shingles")
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(U64)  # offsets of a slice still count from the start of these
    return block.column("node").to_pylist(), [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _sliced(work):
    """Blocks of a bounded number of tokens, or one set."""

    def run(batches):
        for batch in batches:
            ends, start = batch.column("shingles").offsets.to_numpy(), 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(ends, ends[start] + _BLOCK_TOKENS, side="right")) - 1
                stop = min(max(stop, start + 1), batch.num_rows)
                yield work(batch.slice(start, stop - start))
                start = stop

    return run


def _with_partners(sets: DataFrame, params: JoinParams) -> DataFrame:
    """``node, n, own, shingles`` of sets whose tokens of their own (``own`` many) leave room for a partner among ``sets``."""
    alone = (
        sets.select("node", F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
        .where("node = last").groupBy("node").agg(F.count("*").alias("own"))
    )
    counted = sets.join(alone, "node", "left").select(
        "node", F.size("shingles").cast("long").alias("n"), F.coalesce("own", F.lit(0)).cast("long").alias("own"), "shingles"
    )
    return land(counted.where(F.col("own") <= _most(F.col("n"), params)), "partners")


def _most(n: Column, params: JoinParams) -> Column:
    s = params.similarity
    return F.floor((100 - s) * (n + F.floor(100 * n / s)) / (100 + s)).cast("long")


def second_round(sets: DataFrame, params: JoinParams) -> tuple[DataFrame, DataFrame]:
    """Posts ``node, value, whole`` of lists that are not hot, and ``node`` of sets for which that is not enough."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, parts = _unique_sets(block)
        segments = Segments(parts, params.coarse, 8, 2, params)
        full = np.flatnonzero(segments.count > 0)
        slots, values = segments.deletions()
        at = np.concatenate([full, slots])
        value = np.concatenate([segments.whole()[full], values])
        node = np.array(ids, np.int64)[segments.part_set[segments.part[at]]]
        whole = np.arange(len(at)) < len(full)
        columns = [node, segments.band[segments.part[at]].astype(np.int32), segments.segment[at].astype(np.int32), whole, value.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "band", "segment", "whole", "value"])

    posts = land(
        sets.select("node", "shingles").mapInArrow(_sliced(work), "node long, band int, segment int, whole boolean, value long"),
        "second-round",
    )
    sizes = posts.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    listed = land(posts.join(sizes, "value").select("node", "band", "segment", "whole", "value", "size"), "listed")
    hot = F.col("size") > params.list_size
    # a segment without a shared list costs nothing; which have one is known from their rows in ``listed``
    costs = listed.groupBy("node", "band", "segment").agg(
        F.max(F.col("whole") & hot).alias("hot"), F.max(~F.col("whole") & hot).alias("hot_around")
    )
    segments = posts.where("whole").groupBy("node", "band", "segment").agg(F.count("*").alias("_")).drop("_")
    several = posts.where("not whole").select("node", "band", "segment").distinct().withColumn("several", F.lit(True))
    key = ["node", "band", "segment"]
    units = F.when(F.coalesce("hot", F.lit(False)), 0).when(
        F.coalesce("several", F.lit(False)) & ~F.coalesce("hot_around", F.lit(False)), 2
    ).otherwise(1)
    in_order = Window.partitionBy("node", "band").orderBy("segment")
    allotted = (
        segments.join(several, key, "left").join(costs, key, "left").withColumn("units", units)
        .join(sets.select("node", "n").distinct(), "node")
        .withColumn("sum", F.sum("units").over(in_order))
        .withColumn("needed", _most(F.col("n"), params) + 1)
    )
    allotted = land(allotted.select(*key, "units", "sum", "needed"), "allotted")
    taken = allotted.where("sum - units < needed").select(*key)
    cold = listed.where(~hot).join(taken, key).select("node", "value", "whole")
    short = (
        allotted.groupBy("node", "band").agg(F.max("sum").alias("sum"), F.max("needed").alias("needed"))
        .where("sum < needed").select("node").distinct()
    )
    return cold, short


def third_round(sets: DataFrame, params: JoinParams) -> DataFrame:
    """Posts ``node, value`` of the first H + 1 subsets; a set that has fewer also posts in which segments it has tokens."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, parts = _unique_sets(block)
        segments = Segments(parts, params.fine, 16, 3, params)
        wanted = params.most(segments.n) + 1
        slots, usable = segments.leading(segments.count > 0, wanted)
        few = np.flatnonzero((usable < wanted)[segments.part] & (segments.count > 0))
        values = np.concatenate([segments.whole()[slots], mix(segments.salt[few] ^ U64(0x2545F491))])
        return _posts(ids, segments, np.concatenate([slots, few]), values)

    return sets.select("node", "shingles").mapInArrow(_sliced(work), "node long, value long")


def sketches(docs: DataFrame, nodes: DataFrame, params: JoinParams) -> DataFrame:
    """``node, n, band, own, below``: parities of the segments in the set's band and the one below; written."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, sets = _sets_of(block, params)
        segments = Segments(sets, params.sketch, 64, 4, params, multiple=64)
        bits = np.packbits((segments.count & 1).astype(np.uint8), bitorder="little").view(np.int64)
        first = segments.first // 64
        own = [bits[first[i] : first[i + 1]] for i in range(len(sets))]
        below: list[np.ndarray | None] = [None] * len(sets)
        for i in range(len(sets), len(segments.band)):
            below[int(segments.part_set[i])] = bits[first[i] : first[i + 1]]
        kind = pa.list_(pa.int64())
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
            pa.array(segments.band[: len(sets)].astype(np.int32)), pa.array(own, kind), pa.array(below, kind),
        ]
        return pa.RecordBatch.from_arrays(columns, ["node", "n", "band", "own", "below"])

    rows = _texts_of(docs, nodes).mapInArrow(
        by_block("text", work), "node long, n long, band int, own array<long>, below array<long>"
    )
    return land(rows, "sketches")


def possible(pairs: DataFrame, sketched: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs ``a, b`` whose sketches leave it open that they are similar."""
    joined = pairs.join(_side(sketched, "a"), "a").join(_side(sketched, "b"), "b")
    return joined.where(_alike(params)).select("a", "b")


def _side(sketched: DataFrame, end: str, *more: str) -> DataFrame:
    return sketched.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "band", "own", "below", *more)])


def _alike(params: JoinParams) -> Column:
    """Whether the sketches of ``a`` and ``b`` leave it open that they are similar."""
    of_a = F.when(F.col("band_a") > F.col("band_b"), F.col("below_a")).otherwise(F.col("own_a"))
    of_b = F.when(F.col("band_b") > F.col("band_a"), F.col("below_b")).otherwise(F.col("own_b"))
    unlike = F.aggregate(
        F.zip_with(of_a, of_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x
    )
    s = params.similarity
    most = F.floor((100 - s) * (F.col("n_a") + F.col("n_b")) / (100 + s))
    return (F.size(of_a) == F.size(of_b)) & (unlike <= most)


def _fits(a: Column, b: Column, params: JoinParams) -> Column:
    return 100 * F.least(a, b) >= params.similarity * F.greatest(a, b)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = full_sets(docs, nodes.join(ends, "node", "left_semi"), params)
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("in_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("in_b"))
    common = F.size(F.array_intersect("in_a", "in_b"))
    return (
        pairs.join(of_a, "a").join(of_b, "b")
        .select("a", "b", common.alias("both"), (F.size("in_a") + F.size("in_b")).alias("total"))
        .where(100 * F.col("both") >= params.similarity * (F.col("total") - F.col("both")))
        .select("a", "b")
    )


def _stars(posts: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs of the first member of each list with the others."""
    heads = posts.groupBy("value").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("size")).where("size > 1")
    return (
        posts.join(heads.select("value", "head"), "value")
        .where((F.col("node") != F.col("head.node")) & _fits(F.col("n"), F.col("head.n"), params))
        .select(F.col("head.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )


def _across(posts: DataFrame, found: DataFrame, sketched: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs of different components in one list that their sizes, own tokens and sketches allow.

    In hot lists the sketches travel with the members, so that what they rule out never becomes a row, and so do the numbers of
    the lists that a member is in: a pair is put out in the smallest list that both are in.
    ``room`` is the part of a set in the tokens that may differ less those that are its own: the sum for a pair must not be negative.
    """
    s = params.similarity
    labelled = (
        posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        .withColumn("room", (100 - s) * F.col("n") - (100 + s) * F.col("own"))
    )
    labelled = land(labelled.select("value", "node", "n", "whole", "component", "room"), "labelled")
    groups = labelled.groupBy("value", "component").agg(F.count("*").alias("size"), F.max("room").alias("room"))
    mixed = land(
        groups.groupBy("value")
        .agg(F.max(F.struct("size", "component")).alias("major"), F.max("room").alias("most"), F.count("*").alias("parts"), F.sum("size").alias("size"))
        .where("parts > 1").select("value", F.col("major.component").alias("major"), "most", (F.col("size") > params.list_size).alias("hot")),
        "mixed",
    )
    members = land(
        labelled.join(mixed, "value").where(F.col("room") + F.col("most") >= 0)
        .select("value", "hot", "node", "n", "whole", "component", "room", (F.col("component") != F.col("major")).alias("minor")),
        "members",
    )

    def ends(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        a = rows.where("minor").select("value", F.col("node").alias("a"), *[F.col(c).alias(f"{c}_1") for c in ("n", "whole", "component", "room")])
        return a, rows.withColumnRenamed("node", "b")

    allowed = (
        (F.col("component_1") != F.col("component"))
        & (~F.col("minor") | (F.col("a") < F.col("b")))
        & (F.col("whole_1") | F.col("whole"))
        & (F.col("room_1") + F.col("room") >= 0)
        & _fits(F.col("n_1"), F.col("n"), params)
    )
    in_order = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    a, b = ends(members.where("not hot"))
    cold = possible(a.join(b, "value").where(allowed).select(*in_order).distinct(), sketched, params)
    a, b = ends(members.where("hot"))
    lists = members.where("hot").groupBy("node").agg(F.collect_set("value").alias("lists"))
    carried = land(lists.join(sketched, "node"), "carried")

    def side(end: str) -> DataFrame:
        return _side(carried, end, "lists")

    once = F.col("value") == F.array_min(F.array_intersect("lists_a", "lists_b"))
    hot = a.join(side("a"), "a").join(b.join(side("b"), "b"), "value").where(allowed & _alike(params) & once).select(*in_order).distinct()
    return cold.unionByName(hot)


def _renamed(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links between components instead of nodes."""
    label = found.select(F.col("node").alias("at"), F.col("component").alias("label"))
    for end in ("a", "b"):
        other = "b" if end == "a" else "a"
        links = links.join(label, links[end] == label["at"], "left").select(F.coalesce("label", end).alias(end), other)
    return links.distinct()


def similar_documents(docs: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = land(prints(docs, params), "prints")
    nodes = land(
        every.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*_SET).agg(F.min("doc_id").alias("first_doc"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    known = docs.where("doc_id is not null")
    linkable = nodes.where(_most(F.col("n_shingles"), params) > 0)

    first = first_round(known, linkable, params)
    over = (
        first.groupBy("node").agg(F.max("left_over").alias("few"), F.count_if(F.col("size") > params.list_size).alias("hot"))
        .join(linkable, "node")
        .where(F.col("few") | (F.col("hot") > F.floor(F.floor(F.col("n_shingles") * params.similarity / 100) / params.extra)))
        .select(*nodes.columns)
    )
    left_over = _with_partners(full_sets(known, land(over, "left-over"), params), params)
    cold, short = second_round(left_over, params)
    hot_sets = land(left_over.join(land(short, "short"), "node", "left_semi"), "hot-sets")

    sizes = nodes.select("node", F.col("n_shingles").alias("n"))
    counted = left_over.select("node", "n", "own").distinct()
    posts = (
        first.where((F.col("size") <= params.list_size) & ~F.col("left_over")).join(sizes, "node")
        .select("value", "node", "n", F.lit(True).alias("whole"), F.lit(0).cast("long").alias("own"))
        .unionByName(cold.join(counted, "node").select("value", "node", "n", "whole", "own"))
        .unionByName(third_round(hot_sets, params).join(counted, "node").select("value", "node", "n", F.lit(True).alias("whole"), "own"))
    )
    posts = land(posts, "posts")
    sketched = sketches(known, nodes.join(posts.select("node").distinct(), "node", "left_semi"), params)
    near = land(possible(_stars(posts, params), sketched, params), "near")
    found = components(verified(near, known, nodes, params))
    far = land(_across(posts, found, sketched, params), "far")
    rest = land(verified(far, known, nodes, params), "rest")
    joined = components(_renamed(rest, found)).select(F.col("node").alias("at"), F.col("component").alias("joined"))
    placed = (
        nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        .join(joined, F.col("component") == F.col("at"), "left")
        .select(*_SET, "first_doc", F.coalesce("joined", "component").alias("component"))
    )
    placed = land(placed, "placed")
    smallest = placed.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    classes = placed.join(smallest, "component").select(*_SET, "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return every.join(classes, _SET, "left").select("doc_id", "n_shingles", own.alias("component_id"))
