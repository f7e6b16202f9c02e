"""Toxicity on held-out rows, and its features."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from ledgerscope.llm.queries import QUERIES
from ledgerscope.llm.text_bytes import hash_text
from ledgerscope.llm.toxicity import Lexicon, ToxicityParams, features, toxicity

SF = "/root/testdata/sf0.1"
EMPTY = Lexicon(np.zeros(0, np.uint64), np.zeros(0))


def test_disguises_are_undone():
    texts = ["an 1d1ot here", "an i.d-i*o_t here", "an idiot here", "an oddity here", "an i d i o t here", "x i d", "i d i o"]
    x = features(pa.array(texts), EMPTY, ToxicityParams())
    assert x[:, 1].tolist() == [1, 1, 1, 0, 1, 0, 0]
    assert x[:, -2].tolist() == [1, 1, 0, 0, 1, 0, 0]  # of which disguised


def test_disguised_toxic_texts_score_like_plain_ones(spark):
    rng = np.random.default_rng(1)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    rows, marks = [], []
    for i in range(1200):
        text = list(rng.choice(words, 40))
        toxic = i % 4 == 0
        if toxic:
            text[5], text[20] = "idiot", "moron"
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    plain = " ".join(words[:40])
    rows += [(5000, f"{plain} you idiot moron"), (5001, f"{plain} you 1d1ot m0r0n"), (5002, f"{plain} you i-d-i-o-t m o r o n"), (5003, plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    assert [got[i] for i in (5000, 5001, 5002, 5003)] == [1, 1, 1, 0]


def test_second_person_is_near_in_the_same_text():
    far = "you " + "ww " * 20 + "idiot"
    x = features(pa.array(["you are an idiot", far, "idiot", "you"]), EMPTY, ToxicityParams())
    assert x[:, 7].tolist() == [1, 0, 0, 0]


def test_odd_texts():
    lexicon = Lexicon(np.array([hash_text("blorp")], np.uint64), np.array([3.0]))
    x = features(pa.array([None, "", "\n", "a b c d", "blorp " * 30_000]), lexicon, ToxicityParams())
    assert np.isfinite(x).all() and (x[0] == x[1]).all() and x[4, 3] == 30_000
    assert features(pa.array([], pa.string()), lexicon, ToxicityParams()).shape == (0, x.shape[1])


def test_held_out_rows(spark):
    rows = QUERIES["op4_toxicity"](spark, SF).toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    both = rows.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    hit = held[held.predicted == 1]
    print(len(held), held.toxic.sum(), len(hit), hit.toxic.sum())
    assert hit.toxic.mean() > 0.8 and hit.toxic.sum() > 0.6 * held.toxic.sum()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (1, "a", 1.0), (None, "b", 2.0), (4, "", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity(docs, labels).count() == 4
    assert toxicity(docs.limit(0), labels.limit(0)).count() == 0
