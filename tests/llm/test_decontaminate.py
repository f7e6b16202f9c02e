"""Benchmark decontamination against brute force."""

from __future__ import annotations

import hashlib
import re

from ledgerscope.llm.decontaminate import LeakParams, contamination, decontaminate
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words = words_of(text)
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                here = windows.get(tuple(words[i : i + size]))
                if here:
                    hit |= set(range(i, i + size))
                    found |= here
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def got(df):
    rows = df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted(map(tuple, rows), key=str)


def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    return [tuple(r) for r in docs], [tuple(r) for r in items]


def test_given_documents(spark):
    result = got(QUERIES["op6_benchmark_decontamination"](spark, SF))
    assert result == brute(*tables(spark))
    assert any(r[-1] for r in result)


DOCS = [
    (1, None), (2, ""), (3, "..."), (4, "one two three"), (5, "ONE-two; THREE four"),
    (6, "x " * 30_000 + "a b c d e f g h i j k l"), (6, "é ß one two three"), (None, "one two three"),
    (8, "a b c d e f g h i j"), (9, "z a b c d e f g h i"),
]
ITEMS = [(1, "one two three"), (2, "A b c d e f g h i j k"), (3, None), (4, "!"), (2, "one two three"), (11, "one two three")]


def test_odd_rows_and_parts(spark):
    docs = spark.createDataFrame([(*d, "w", 5) for d in DOCS], "doc_id long, text string, items string, n_words int")
    items = spark.createDataFrame([(*i, "w") for i in ITEMS], "item_id long, text string, doc_id string")
    expected = brute(DOCS, ITEMS)
    assert got(contamination(docs, items)) == expected
    assert got(contamination(docs, items, LeakParams(most_windows=1))) == expected
    assert contamination(docs.limit(0), items).count() == 0
    assert got(contamination(docs, items.limit(0))) == brute(DOCS, [])


def test_spans_are_cut_and_documents_removed(spark):
    passage = "q0 q1 q2 q3 q4 q5 q6 q7 q8 q9"
    prose = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, f"{prose}. {passage.upper()}! {prose}", 1, "k"), (2, passage, 2, None), (3, prose, 3, "k"), (None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, items string")
    items = spark.createDataFrame([(7, passage), (8, "only this")], "item_id long, text string")
    for params in (LeakParams(), LeakParams(most_windows=1)):
        out = decontaminate(docs, items, params)
        assert out.schema == docs.schema
        left = {r.doc_id: (r.text, r.n_chars, r["items"]) for r in out.collect()}
        clean = f"{prose}. ! {prose}"
        assert left == {1: (clean, len(clean), "k"), 3: (prose, 3, "k"), None: (None, None, None)}
