"""Near duplicates against brute force over all pairs."""

from __future__ import annotations

import random
import re

from ledgerscope.llm import near_dedup
from ledgerscope.llm.near_dedup import NearParams, keep_one, near_duplicates
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text: str | None) -> set:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df) -> dict[int, tuple[int, int]]:
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    result = QUERIES["op1_minhash_near_dedup"](spark, SF)
    assert got(result) == brute([tuple(r) for r in rows])
    assert result.where("kept <> (doc_id = component_id)").isEmpty()


def test_mutated_groups_lose_no_link(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    for size in (60, 40, 5, 2, 1, 1):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((30, 60, 120)))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            cut = rng.randint(0, 8)
            rows.append((doc, " ".join(words[cut:])))
            doc += 1
    rng.shuffle(rows)
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_exact_join_alone_finds_what_stars_miss(spark):
    """With every pair left to the stars' first rounds or the exact join, any banding is complete."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(50):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words) - 6)
            words[at] = rng.choice(["x", "y", "z"])
        rows.append((i, " ".join(words[rng.randint(0, 20) :])))
    for band in (1.02, 1.5):
        params = NearParams(matches=12, band=band)
        assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA), params)) == brute(rows)


def test_odd_rows(spark):
    long_text = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, long_text),
        (7, long_text + " end"), (7, long_text + " end"), (8, "É é É é É"), (9, "é é é é é"),
        (10, "a text that comes twice"), (10, "a text that comes twice"), (11, None), (11, None),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", node string, component int")
    expected = brute(rows)
    assert got(near_duplicates(frame)) == expected
    assert near_duplicates(frame).count() == len(rows)
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 9, 10, 11]


def test_null_id_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], SCHEMA)
    rows = near_duplicates(frame).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [
        ("3", "3", True), ("None", "None", True),
    ]
    assert near_duplicates(frame.limit(0)).count() == 0


def test_hot_lists_put_out_no_pairs_that_sketches_rule_out(spark):
    """Variants of one text that share every shingle with some other variant: only pairs that may be similar become rows."""
    rng = random.Random(3)
    rows = []
    for i in range(200):
        changed = rng.sample(range(2, 97, 5), 4)
        rows.append((i, " ".join(f"v{j}" if j in changed else f"s{j}" for j in range(100))))
    params = NearParams()
    frame = spark.createDataFrame(rows, SCHEMA)
    sets = near_dedup.full_sets(frame, params).cache()
    posts = sets.selectExpr("node", "1L as token")
    found = spark.createDataFrame([], "node long, component long")
    pairs = {tuple(r) for r in near_dedup._across(posts, found, sets, params).collect()}
    of = {r.node: set(r.shingles) for r in sets.collect()}
    every = [(a, b) for a in of for b in of if a < b]
    similar = {(a, b) for a, b in every if 100 * len(of[a] & of[b]) >= 75 * len(of[a] | of[b])}
    assert similar <= pairs
    assert len(pairs) <= len(similar) + len(every) // 20, (len(pairs), len(similar))
