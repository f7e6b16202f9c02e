"""Frames and fill-in-middle outputs against plain strings."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from ledgerscope.llm.fill_in_middle import MiddleParams, fill_in_middle, middle_digests, restored, text_of
from ledgerscope.llm.frames import FrameParams, between, cut_after, framed, pieces

SF_DIR = "/root/testdata/sf0.001"
SMALL = MiddleParams(frames=FrameParams(frame_bytes=7))


def by_hand(doc_id: int | None, text: str | None) -> dict:
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "plain" if not text or any(s in text for s in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < 50 else "psm"
    output = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    plain = form == "plain"
    return {
        "doc_id": doc_id, "n": n, "form": form,
        "prefix_chars": None if plain else len(prefix), "middle_chars": None if plain else len(middle),
        "output_sha256": hashlib.sha256(output.encode()).hexdigest(),
        "restored_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def key(row: dict) -> tuple:
    return tuple((v is None, v) for v in row.values())


def random_text(rng: random.Random) -> str:
    return "".join(rng.choice(["\n", "a", "é", "中", "\U0001f600", "<", "S", "P", "<S", "\r"]) for _ in range(rng.randrange(0, 60)))


@pytest.mark.parametrize("size", [4, 5, 7, 1_000])
def test_frames_cut_like_strings(size):
    rng, params = random.Random(size), FrameParams(frame_bytes=size)
    for _ in range(200):
        text = random_text(rng)
        frames = framed(text.encode(), params)
        assert b"".join(pieces(frames)).decode() == text
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        cuts = [cut_after(frames, k, len(lines), len(text)) for k in range(len(lines) + 1)]
        for a in range(len(lines) + 1):
            assert cuts[a].chars == len("".join(lines[:a]))
            b = rng.randrange(a, len(lines) + 1)
            assert text_of(between(frames, cuts[a], cuts[b], params)) == "".join(lines[a:b])


@pytest.mark.parametrize("params", [SMALL, MiddleParams()])
def test_odd_and_random_rows(spark, params):
    rng = random.Random(3)
    rows = [(None, "a\nb\nc\n", 1), (1, None, 1), (2, "", 1), (3, "one <M> two\n", 1), (4, "\n\n\n", 1), (4, "\n\n\n", 2), (4, "x", 1)]
    rows += [(5, "no line end at all " * 9_000, 1), (6, "l\n" * 50_000, 1), (7, "\x00\r\n ", 1)]
    rows += [(i, random_text(rng), 1) for i in range(10, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, frames int")
    got = sorted((r.asDict() for r in middle_digests(docs, params).collect()), key=key)
    assert got == sorted((by_hand(i, t) for i, t, _ in rows), key=key)
    assert middle_digests(docs.where("doc_id = -1"), params).count() == 0


def test_outputs_give_back_the_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = fill_in_middle(docs, SMALL).collect()
    assert {r["form"] for r in rows} >= {"psm", "spm"}
    for row in rows:
        assert b"".join(restored(row["output"], row["form"])).decode() == texts[row["doc_id"]]
        assert len(text_of(row["output"])) == len(texts[row["doc_id"]]) + (0 if row["form"] == "plain" else 9)


def test_rate_leaves_texts_plain(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc") for i in range(300)], "doc_id long, text string")
    forms = [r["form"] for r in fill_in_middle(docs, MiddleParams(rate=40, suffix_first=0)).collect()]
    assert set(forms) == {"plain", "psm"} and 60 < forms.count("psm") < 180
