"""BPE against the tokenizers library, piece by piece and over whole tables."""

from __future__ import annotations

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerscope.llm.bpe import (
    Encoder,
    Vocabulary,
    compatible,
    decode_bytes,
    merge_exactly,
    merge_together,
    token_digests,
    tokenized,
)
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digest_rows(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append(
            (
                doc, len(ids),
                hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(back.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def test_every_token_encodes_to_itself(vocabulary):
    assert all(merge_exactly(vocabulary, s) == [i] for s, i in vocabulary.ids.items())


def test_pairs_stay_apart_exactly_when_merging_says_so(vocabulary):
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 50256, (2, 4000))
    short = [i for s, i in vocabulary.ids.items() if len(s) <= 3 and s.isalpha()]
    left = np.concatenate([left, rng.choice(short, 4000)])
    right = np.concatenate([right, rng.choice(short, 4000)])
    apart = compatible(vocabulary, left, right)
    for a, b, ok in zip(left.tolist(), right.tolist(), apart.tolist(), strict=True):
        merged = merge_exactly(vocabulary, vocabulary.spelling[a] + vocabulary.spelling[b])
        assert (merged == [a, b]) == ok
    assert 0 < apart.sum() < len(apart)


def test_merging_together_is_merging_one_by_one(vocabulary):
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"aabcdehilnorst \xc3\xa9") for _ in range(rng.randint(1, 90))) for _ in range(500)]
    assert merge_together(vocabulary, pieces) == [merge_exactly(vocabulary, p) for p in pieces]


def texts():
    rng = random.Random(6)
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    out = [None, "", " ", "\n\n  a  b\t\t", "don't I'LL we've '' 's", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|end", "x" * 30_000]
    out += ["aaaa" * 3000 + " " * 999, "　\x85  \x1c\x1d é", "à ١٢ ² Ⅷ 日本語 👩‍👩‍👧 \x00\x01"]
    out += ["".join(rng.choice(every) for _ in range(300)) for _ in range(60)]
    out += ["".join(rng.choice(every[:0x800]) for _ in range(300)) for _ in range(60)]
    return out


def test_odd_texts(vocabulary, library):
    given = texts()
    encoder = Encoder(vocabulary)
    tokens, ends = encoder.encode(given)
    data, borders = decode_bytes(vocabulary, tokens, ends)
    for i, text in enumerate(given):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert tokens[ends[i] : ends[i + 1]].tolist() == want
        assert data[borders[i] : borders[i + 1]].tobytes().decode() == library.decode(want, skip_special_tokens=False)
    again, _ = encoder.encode(given)
    assert (again == tokens).all() and 0 < encoder.repaired < encoder.seen


def test_every_character(vocabulary, library):
    """The pattern cuts every character as the library does, whatever Unicode version either has."""
    encoder = Encoder(vocabulary)
    for start in range(0, sys.maxunicode, 0x1000):
        text = "".join(f"a{chr(c)}a1{chr(c)}1! {chr(c)}" for c in range(start, start + 0x1000) if not 0xD800 <= c < 0xE000)
        cut = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert encoder.pieces(text) == cut


def test_given_documents(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op8_bpe_encoding"](spark, SF).collect()), key=str)
    assert got == digest_rows(library, [tuple(r) for r in rows])


def test_odd_rows(spark, library):
    rows = [(i % 5 or None, t) for i, t in enumerate(texts())]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in token_digests(frame, PATH, public_tokenizers.PATTERN).collect()), key=str)
    assert got == digest_rows(library, rows)
    assert token_digests(frame.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    whole = tokenized(frame, PATH, public_tokenizers.PATTERN)
    assert whole.columns == [*frame.columns, "input_ids", "decoded"]
    assert whole.where("decoded <> coalesce(text, '')").isEmpty()
    assert tokenized(whole, PATH, public_tokenizers.PATTERN).columns == whole.columns
