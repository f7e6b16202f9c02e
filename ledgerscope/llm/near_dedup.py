"""Near-duplicate documents by a signature-coordinate inverted join.

1. Every document gets a MinHash signature. A pair (coordinate, value) is a posting key.
2. Two documents count as a candidate pair if at least ``matches`` of the ``coordinates``
   agree. By the prefix principle they then share a key among the first
   ``coordinates - matches + 1`` keys of either, in the order of rarity; keys of one document
   only are in that prefix but post nothing. Longer lists are skipped: what agrees there is
   read off the two signatures.
3. Lists are not expanded into pairs. Each list links its members to its most central one; links
   are confirmed on full shingle sets and give components.
4. What is left are pairs across components of one list. They are searched by an exact prefix
   join of the full sets of those documents, so no link between different texts is lost beyond
   the chance that a true pair agrees in fewer than ``matches`` coordinates (below 1e-7
   for a pair at the threshold itself).

Copies of one shingle set are one node throughout and are joined back at the end.
Nulls and texts without words have no shingles and are linked with nothing. Rows with a null id
take no part: their component is null and they are kept. Rows of one id are one document; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.components import components
from ledgerscope.llm.text_bytes import U64, Words, by_block, byte_class, mix, texts_of, window_hashes
from ledgerscope.session import land

# Words are runs of anything but blank and the control characters 9 to 13.
WORD_BYTES = byte_class((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
PARITY_BITS = 2048  # a power of two; sets of many more shingles than this are told apart less well, never wrongly
HOT_LIST = 32


@dataclass(frozen=True)
class NearParams:
    words: int = 5
    similarity: int = 75  # per cent
    coordinates: int = 64
    matches: int = 26
    seed: int = 7
    band: float = 1.1  # ratio of set sizes in one band of the exact join


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one shingle if there are fewer words."""
    found = Words(texts_of(column).lowered(), WORD_BYTES)
    hashes = found.hashes()
    windows = window_hashes(hashes, words)
    sets = []
    for start, stop in zip(found.first[:-1], found.first[1:], strict=True):
        if stop - start >= words:
            sets.append(np.unique(windows[start : stop - words + 1]))
        else:
            sets.append(window_hashes(hashes[start:stop], stop - start)[:1])
    return sets


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def fingerprints(docs: DataFrame, params: NearParams) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, signature`` of ``docs(doc_id, text)``."""
    size, words = params.coordinates, params.words
    rng = np.random.default_rng(params.seed)
    factors = rng.integers(0, 2**31, size).astype(np.uint32) * 2 + 1
    shifts = rng.integers(0, 2**32, size).astype(np.uint32)

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(block.column("text"), words)
        counts = np.array([len(s) for s in sets], dtype=np.int64)
        full = np.flatnonzero(counts)
        signature = np.zeros((len(sets), size), np.uint32)
        ids = np.zeros((len(sets), 2), U64)
        if len(full):
            flat = np.concatenate(sets)
            starts = (np.cumsum(counts) - counts)[full]
            base = (flat >> U64(32)).astype(np.uint32)
            for k in range(size):
                signature[full, k] = np.minimum.reduceat((base ^ shifts[k]) * factors[k], starts)
            ids[full, 0] = np.add.reduceat(mix(flat), starts)
            ids[full, 1] = np.add.reduceat(mix(flat ^ U64(0x5BD1E995)), starts)
        rows = [signature[i].view(np.int32) if counts[i] else np.zeros(0, np.int32) for i in range(len(sets))]
        return pa.RecordBatch.from_arrays(
            [
                block.column("doc_id"),
                pa.array(counts),
                pa.array(ids[:, 0].view(np.int64)),
                pa.array(ids[:, 1].view(np.int64)),
                _list_array(rows, pa.int32()),
            ],
            ["doc_id", "n_shingles", "set_a", "set_b", "signature"],
        )

    return docs.mapInArrow(
        by_block("text", work),
        "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>",
    )


def full_sets(docs: DataFrame, params: NearParams) -> DataFrame:
    """``node, shingles, parity`` of ``docs(doc_id, text)``; ``parity`` has a bit per place with an odd number of shingles."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(block.column("text"), params.words)
        odd = [np.bincount((mix(s) & U64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1 for s in sets]
        parity = [np.packbits(o.astype(np.uint8), bitorder="little").view(np.int64) for o in odd]
        return pa.RecordBatch.from_arrays(
            [
                block.column("doc_id"),
                _list_array([s.view(np.int64) for s in sets], pa.int64()),
                _list_array(parity, pa.int64()),
            ],
            ["node", "shingles", "parity"],
        )

    return docs.mapInArrow(by_block("text", work), "node long, shingles array<long>, parity array<long>")


def _sizes_fit(a: Column, b: Column, params: NearParams) -> Column:
    return 100 * F.least(a, b) >= params.similarity * F.greatest(a, b)


def _prefixes(nodes: DataFrame, params: NearParams) -> DataFrame:
    """Posts ``node, n, token, weight`` of the rarity prefixes, shared keys only.

    ``weight`` grows with how many others share the document's keys.
    """
    posts = nodes.select("node", "n", F.posexplode("signature").alias("k", "value")).select(
        "node",
        "n",
        F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(
            F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        ).alias("token"),
    )
    shared = land(posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    prefix = params.coordinates - params.matches + 1
    return (
        posts.join(shared, "token")
        .groupBy("node", "n")
        .agg(
            F.sort_array(F.collect_list(F.struct("df", "token"))).alias("keys"),
            F.sum(F.log2("df")).alias("weight"),
        )
        # keys of this document only come first in the order of rarity
        .withColumn("room", prefix - (params.coordinates - F.size("keys")))
        .where("room > 0")
        .select("node", "n", "weight", F.explode(F.slice("keys", F.lit(1), F.col("room"))).alias("key"))
        .select("node", "n", "weight", F.col("key.token").alias("token"))
    )


def _stars(posts: DataFrame, params: NearParams) -> DataFrame:
    """Pairs ``a < b`` of each list's most central member with the others."""
    hubs = land(
        posts.groupBy("token")
        .agg(
            F.max(F.struct("weight", (-F.col("node")).alias("order"), "n")).alias("hub"),
            F.count("*").alias("members"),
        )
        .where("members > 1")
        .select("token", (-F.col("hub.order")).alias("hub"), F.col("hub.n").alias("hub_n")),
        "hubs",
    )
    return (
        posts.join(hubs, "token")
        .where((F.col("node") != F.col("hub")) & _sizes_fit(F.col("n"), F.col("hub_n"), params))
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )


def _matching(pairs: DataFrame, nodes: DataFrame, params: NearParams) -> DataFrame:
    """Pairs whose signatures agree in enough coordinates."""
    of_a = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"))
    of_b = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    return pairs.join(of_a, "a").join(of_b, "b").where(agree >= params.matches).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, params: NearParams) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(of_a, "a")
        .join(of_b, "b")
        .select("a", "b", common.alias("both"), (F.size("set_a") + F.size("set_b")).alias("total"))
        .where(100 * F.col("both") >= params.similarity * (F.col("total") - F.col("both")))
        .select("a", "b")
    )


def _unlike(a: Column, b: Column) -> Column:
    """Bits in which two parity sketches are unlike: at most the shingles in which the sets differ."""
    return reduce(add, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITY_BITS // 64)])


def _across(posts: DataFrame, found: DataFrame, sets: DataFrame, params: NearParams) -> DataFrame:
    """Candidate pairs of different components that share a list.

    In a list the members outside its largest component are the minority. Any
    such pair has one of them. Full sets are compared by the prefix principle
    within bands of set sizes: shingles in the order of rarity, each document posting as many
    as its size and the partner's band leave room for, and a match at
    a late position is not a candidate. In lists of more than ``HOT_LIST`` documents parity sketches travel with the
    members, and pairs they rule out never become rows.
    """
    labelled = posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = land(labelled.groupBy("token", "component").agg(F.count("*").alias("size")), "groups")
    mixed = land(
        groups.groupBy("token")
        .agg(F.max(F.struct("size", "component")).alias("most"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("token", F.col("most.component").alias("major")),
        "mixed",
    )
    members = (
        labelled.join(mixed, "token")
        .groupBy("node", "component")
        .agg(F.max(F.col("component") != F.col("major")).alias("minor"))
    )
    shingles = land(
        members.join(sets, "node").select(
            "node", "component", "minor", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")
        ),
        "shingles",
    )
    shared = land(shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    t = params.similarity / 100
    step = float(np.log(params.band))

    def band(n: Column) -> Column:
        return F.floor(F.log(n) / step).cast("int")

    ranked = (
        shingles.join(shared, "shingle")
        .groupBy("node", "component", "minor", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ranked"))
        .where(100 * F.size("ranked") >= params.similarity * F.col("n"))
        .withColumn("own", band(F.col("n")))
        .withColumn(
            "other", F.explode(F.sequence(band(F.ceil(F.col("n") * t)), band(F.floor(F.col("n") / t))))
        )
        .withColumn("low", F.floor(F.pow(F.lit(params.band), F.col("other"))))
        .withColumn(
            "overlap",
            F.ceil(
                F.greatest((F.col("n") + F.col("low")) * (t / (1 + t)), F.col("n") * t, F.col("low") * t) - 1e-9
            ),
        )
        .withColumn("alone", F.col("n") - F.size("ranked"))
        .withColumn("room", (F.col("n") - F.col("overlap") + 1 - F.col("alone")).cast("int"))
        .where("room > 0")
        .select(
            "node", "component", "minor", "n", "alone",
            F.least("own", "other").alias("low_band"),
            F.greatest("own", "other").alias("high_band"),
            F.posexplode(F.slice("ranked", F.lit(1), F.col("room"))).alias("at", "key"),
        )
        .select(
            "node", "component", "minor", "n", "low_band", "high_band",
            (F.col("n") - F.col("alone") - F.col("at")).alias("rest"),
            F.col("key.shingle").alias("shingle"), F.col("key.df").alias("df"),
        )
    )
    table = land(ranked, "ranked")
    key = ["shingle", "low_band", "high_band"]
    needed = (F.col("n_1") + F.col("n")) * (t / (1 + t)) - 1e-9
    allowed = (
        (F.col("component_1") != F.col("component"))
        & (~F.col("minor") | (F.col("node_1") < F.col("node")))
        & _sizes_fit(F.col("n_1"), F.col("n"), params)
        & (F.least("rest_1", "rest") >= needed)
    )

    def pairs(rows: DataFrame, carried: tuple[str, ...], test: Column) -> DataFrame:
        left = rows.where("minor").select(
            *key, *[F.col(c).alias(f"{c}_1") for c in ("node", "component", "n", "rest", *carried)]
        )
        found = left.join(rows, key).where(allowed & test)
        return found.select(F.least("node_1", "node").alias("a"), F.greatest("node_1", "node").alias("b"))

    # The number of documents is one per shingle, so no list lies in both parts.
    hot = table.where(F.col("df") > HOT_LIST).join(sets.select("node", "parity"), "node")
    most = F.floor((100 - params.similarity) * (F.col("n_1") + F.col("n")) / (100 + params.similarity))
    alike = _unlike(F.col("parity_1"), F.col("parity")) <= most
    cold = table.where(F.col("df") <= HOT_LIST)
    return pairs(cold, (), F.lit(True)).unionByName(pairs(hot, ("parity",), alike)).distinct()


def near_duplicates(
    docs: DataFrame, params: NearParams = NearParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = land(fingerprints(docs, params), "prints")
    key = ["n_shingles", "set_a", "set_b"]
    real = prints.where("n_shingles > 0 and doc_id is not null")
    nodes = land(
        real.groupBy(*key)
        .agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
        .withColumn("n", F.col("n_shingles")),
        "nodes",
    )
    posts = land(_prefixes(nodes, params), "posts")
    wanted = posts.select(F.col("node").alias("doc_id")).distinct()
    once = docs.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = land(full_sets(once, params), "sets")
    near = land(_matching(_stars(posts, params), nodes, params), "near")
    found = components(_confirmed(near, sets, params))
    rest = land(_confirmed(_across(posts, found, sets, params), sets, params), "rest")

    label = found.select(F.col("node").alias("at"), F.col("component").alias("label"))
    for end in ("a", "b"):
        rest = rest.join(label, rest[end] == label["at"], "left").select(
            *[F.coalesce("label", end).alias(end) if c == end else F.col(c) for c in ("a", "b")]
        )
    joined = components(rest.distinct()).select(
        F.col("node").alias("at"), F.col("component").alias("joined")
    )
    classes = land(
        nodes.select(*key, "node")
        .join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(joined, F.col("component") == F.col("at"), "left")
        .select(*key, F.coalesce("joined", "component").alias("component")),
        "classes",
    )
    linked = prints.select("doc_id", *key).join(classes, key, "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return linked.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component; of repeated rows of one id, one.

    Columns of ``docs`` may have any names; rows without an id are all kept; an empty table stays empty.
    """
    found = land(near_duplicates(docs, params), "found")
    taken = {c.lower() for c in docs.columns}
    special, again = (next(n for i in range(len(taken) + 1) if (n := f"{word}_{i}") not in taken) for word in ("special", "again"))
    gone = found.where("not kept").select("doc_id")
    repeated = (
        found.where("kept and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.count("*").alias("rows"))
        .where("rows > 1")
        .select("doc_id")
    )
    apart = gone.unionByName(repeated).distinct().select(F.col("doc_id").alias(special))
    once = docs.join(repeated.select(F.col("doc_id").alias(again)), F.col("doc_id") == F.col(again), "left_semi")
    return docs.join(apart, F.col("doc_id") == F.col(special), "left_anti").unionByName(once.dropDuplicates(["doc_id"]))
