"""Boosted trees, and quality on held-out rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from ledgerscope.llm.boosting import BoostParams, fit_isotonic, fit_trees
from ledgerscope.llm.quality import keep_good, quality, statistics
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_trees_learn_and_walk_like_plain_code():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = fit_trees(x, y, BoostParams(trees=40, depth=3))
    score = model.score(x)
    assert auc(score, y) > 0.97
    for row in (0, 17, 2999):
        raw = model.start
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[row, feature[node]] > threshold[node] else 1)
            raw += leaf[node - len(feature)]
        assert abs(1 / (1 + np.exp(-raw)) - score[row]) < 1e-9
    constant = fit_trees(x, np.ones(3000))
    assert (constant.score(x) > 0.99).all()
    assert fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    score = np.round(rng.random(500), 2)
    y = (rng.random(500) < score**2).astype(float)
    fit = fit_isotonic(score, y)
    grid = fit(np.linspace(0, 1, 101))
    assert (np.diff(grid) >= 0).all() and abs(fit(score).mean() - y.mean()) < 0.05


def test_statistics_of_odd_texts():
    x = statistics(pa.array([None, "", " \n", "A b A b\nA b A b", "word" * 50_000]))
    assert np.isfinite(x).all() and len(x) == 5
    assert (x[0] == x[1]).all()
    alone = statistics(pa.array(["A b A b\nA b A b"]))
    assert np.allclose(alone[0], x[3])


def test_held_out_rows(spark):
    rows = QUERIES["op2_quality_classifier"](spark, SF)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = rows.toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    both = rows.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.8


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 3.0), (1, "a", 1.0), (None, "b", 2.0), (4, "", None)], "doc_id long, text string, score double"
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality(docs, labels).count() == 4
    assert quality(docs.limit(0), labels.limit(0)).count() == 0
    kept = keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() == 4
