"""Runs of repeated words against every period of every stretch, tried one by one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerscope.llm.periodic import Positions, RunParams, collapse_runs, periodic_runs, run_report, runs

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(words: list[str], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                found.setdefault((i, length), q)  # smaller periods come first
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def report_by_hand(doc_id: int | None, text: str | None) -> dict:
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return {
        "doc_id": doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
        "exponent_milli": 1000 * best[1] // best[2] if found else None,
        "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(kept.encode()).hexdigest(),
    }


def key(row: dict) -> tuple:
    return tuple((v is None, v) for v in row.values())


def random_words(rng: random.Random) -> list[str]:
    words = [rng.choice("abc") for _ in range(rng.randrange(0, 30))]
    for _ in range(rng.randrange(0, 3)):
        unit = [rng.choice("ab") for _ in range(rng.randrange(1, 6))]
        words += (unit * 9)[: rng.randrange(1, 9 * len(unit))]
        words += [rng.choice("abc") for _ in range(rng.randrange(0, 6))]
    return words


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 12)])
def test_random_words(exponent, least):
    rng = random.Random(exponent)
    many = [random_words(rng) for _ in range(400)]
    flat = np.array([ord(w) for words in many for w in words], np.uint64)
    owners = np.repeat(np.arange(len(many)), [len(w) for w in many])
    first = np.searchsorted(owners, np.arange(len(many)))
    got: dict[int, list] = {}
    for s, n, q in zip(*map(np.ndarray.tolist, runs(flat, owners, RunParams(exponent, least))), strict=True):
        got.setdefault(int(owners[s]), []).append((s - int(first[owners[s]]), n, q))
    for i, words in enumerate(many):
        assert got.get(i, []) == runs_by_hand(words, exponent, least), words


def test_positions_stay_in_order_in_pieces():
    rng = random.Random(5)
    numbers = rng.sample(range(100_000), 7_000)
    held = Positions(numbers[0])
    for x in numbers[1:]:
        held.add(x)
    ordered = sorted(numbers)
    assert list(held) == ordered and held.size == len(numbers)
    for i in range(0, len(ordered), 7):
        before, after = held.neighbours(ordered[i])
        assert before == (ordered[i - 1] if i else None)
        assert after == (ordered[i + 1] if i + 1 < len(ordered) else None)


def test_one_word_for_ever_and_a_long_text(spark):
    rng = random.Random(2)
    texts = ["a " * 60_000, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30_000)), "x y z " * 9_000 + "end"]
    rows = list(enumerate(texts, 1))
    got = {r["doc_id"]: r.asDict() for r in run_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["length"], got[1]["period"], got[1]["n_runs"]) == (60_000, 1, 1)
    assert got[3]["period"] == 3 and got[3]["length"] == 27_000
    assert got[2]["n_runs"] == 0 or got[2]["period"] < 5


def test_odd_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, "a b " * 9, "x"), (4, "go go go go go go", "x"), (4, "go go go go go", "x"),
        (5, "a b c " * 8, "x"), (4, "go go go go go go", "y"), (6, "éè \x00 " * 12, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string")
    got = sorted((r.asDict() for r in run_report(docs).collect()), key=key)
    assert got == sorted((report_by_hand(i, t) for i, t, _ in rows), key=key)
    assert run_report(docs.where("doc_id = 99")).count() == 0
    assert [tuple(r) for r in periodic_runs(docs.where("doc_id = 4")).collect()] == [(4, 0, 6, 1)] * 2
    left = collapse_runs(docs)
    assert left.columns == docs.columns
    assert sorted(r["text"] for r in left.where("doc_id = 4").collect()) == ["go", "go", "go go go go go"]
    assert left.where("doc_id = 1").first()["text"] is None and left.where("doc_id = 3").first()["text"] == " \t\n"


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in run_report(docs).collect()}
    assert len(got) == docs.count()
    for doc_id, text in docs.select("doc_id", "text").collect():
        assert got[doc_id] == report_by_hand(doc_id, text)
    assert any(r["n_runs"] for r in got.values())
