"""The exact join against all pairs, with every round made to work."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from ledgerscope.llm.universe_join import JoinParams, Segments, similar_documents

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, size: int = 5) -> frozenset:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def by_hand(rows, similarity: int = 80) -> list[tuple]:
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    usable = [i for i, (doc_id, _) in enumerate(rows) if doc_id is not None and sets[i]]
    by_size = sorted(usable, key=lambda i: len(sets[i]))
    for at, i in enumerate(by_size):
        for j in by_size[at + 1 :]:
            if 100 * len(sets[i]) < similarity * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    smallest: dict[int, int] = {}
    for i in usable:
        smallest[root(i)] = min(smallest.get(root(i), 1 << 62), rows[i][0])
    own = [smallest[root(i)] if i in set(usable) else rows[i][0] for i in range(len(rows))]
    return sorted(((r[0] is None, r[0] or 0), len(s), (c is None, c or 0)) for r, s, c in zip(rows, sets, own, strict=True))


def joined(spark, rows, params=JoinParams()):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar_documents(docs, params).collect()
    return sorted(((r[0] is None, r[0] or 0), r[1], (r[2] is None, r[2] or 0)) for r in got)


def families(rng: random.Random, count: int, copies: int, common: int) -> list[tuple[int, str]]:
    words = [f"w{i}" for i in range(5_000)]
    shared = " ".join(rng.choices(words, k=common))
    rows = []
    for _ in range(count):
        base = rng.choices(words, k=rng.choice([5, 8, 12, 40, 150]))
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 12)):
                change = rng.random()
                at = rng.randrange(len(own))
                if change < 0.4:
                    own[at] = rng.choice(words)
                elif change < 0.7:
                    del own[at : at + rng.randrange(1, 4)]
                else:
                    own[at:at] = rng.choices(words, k=2)
                own = own or ["x"]
            rows.append((len(rows) * 3 % 1_009 + 1, " ".join(own) + (" " + shared if rng.random() < 0.5 else "")))
    return rows


@pytest.mark.parametrize(
    "params",
    [JoinParams(), JoinParams(list_size=2, extra=1_000), JoinParams(list_size=1, frequent=0.0005), JoinParams(list_size=3, passed_over=0)],
    ids=["as it is", "short lists", "all lists hot", "nothing passed over"],
)
def test_families(spark, params):
    rows = families(random.Random(params.list_size), 60, 9, 12)
    assert joined(spark, rows, params) == by_hand(rows)


def test_one_large_family(spark):
    rng = random.Random(4)
    rows = families(rng, 1, 260, 3)[:1] * 3
    base = rng.choices([f"v{i}" for i in range(400)], k=130)
    for i in range(240):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10_000)}"
        rows.append((1_000 + i, " ".join(own)))
    assert joined(spark, rows, JoinParams(list_size=8)) == by_hand(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (None, "one two"), (7, "a b c d e"),
        (7, "a b c d e"), (7, "something else that is not the same at all"), (8, "A b c d e"), (9, long), (10, long + " end"), (11, "é à"),
        (12, "q r s t u v w x"), (12, "q r s t u v w x y"), (13, "q r s t u v w x y z"),
    ]
    assert joined(spark, rows) == by_hand(rows)
    assert joined(spark, rows[:0]) == []
    docs = spark.createDataFrame([(1, "a b c d e", 0, 0)], "doc_id long, text string, node int, value int")
    assert similar_documents(docs).count() == 1


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert joined(spark, rows) == by_hand(rows)


def test_neighbourhoods_find_one_token_more():
    rng = np.random.default_rng(3)
    tokens = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
    one = Segments([tokens, tokens[:-1]], 0.25, 8, 2, JoinParams())
    own = one.part_set[one.part]
    at, values = one.deletions()
    assert set(values[own[at] == 0].tolist()) & set(one.whole()[own == 1].tolist())
    assert not set(one.whole()[(own == 0) & (one.count == 0)].tolist()) & set(values.tolist())
