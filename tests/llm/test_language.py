"""Language identification on held-out rows and odd texts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerscope.llm.language import LanguageModel, LanguageParams, Letters, Table, fit_language, language
from ledgerscope.llm.queries import QUERIES
from ledgerscope.llm.text_bytes import hash_spans, window_hashes

SF = "/root/testdata/sf0.01"


def test_letters():
    letters = Letters(pa.array(["Ab, c1d", None, "", "ÉÀ ß", "7 8"]))
    words = ["".join(map(chr, letters.points[a:b])) for a, b in zip(letters.starts, letters.ends, strict=True)]
    assert words == ["ab", "c", "d", "éà", "ß"]
    assert letters.owners().tolist() == [0, 0, 0, 3, 3]
    hashes, place = letters.grams(np.arange(5), 3)
    assert place.tolist() == [0, 0, 1, 2, 3, 3, 4] and len(set(hashes.tolist())) == 7
    assert len(letters.grams(np.arange(5), 1)[0]) == 7
    assert len(Letters(pa.array(["x" * 200_000])).starts) == 1


def test_backoff_goes_from_words_to_shorter_grams(spark):
    docs = spark.createDataFrame(
        [(1, "hello hello world", "en"), (3, "hallo welt", "de"), (5, "bonjour monde", "fr")] * 4,
        "doc_id long, text string, lang string",
    )
    model = fit_language(docs, LanguageParams(folds=4, held_out=9))
    assert model.languages == ["de", "en", "fr"]
    names, score = model.predict(pa.array(["hello", "weltlich", "bonj", "q", "", "123"]))
    assert names[:3] == ["en", "de", "fr"] and names[4:] == ["und", "und"]
    assert (score[4:] == 0).all() and ((score[:4] > 0) & (score[:4] <= 1)).all()
    empty = Table(np.zeros(0, np.uint64), np.zeros((0, 0)))
    assert LanguageModel([], empty, {}).predict(pa.array(["a"]))[0] == ["und"]


def test_held_out_rows(spark):
    rows = QUERIES["op7_language_id"](spark, SF).toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.9
    assert set(rows.lang_pred) <= {"en", "de", "fr", "es", "und"}


def plain_scores(model: LanguageModel, text: str | None) -> list[float]:
    """Summed log frequencies by language, a word and an n-gram at a time."""
    tables = {0: dict(zip(model.words.keys.tolist(), model.words.logs.tolist(), strict=True))}
    tables |= {n: dict(zip(t.keys.tolist(), t.logs.tolist(), strict=True)) for n, t in model.grams.items()}
    totals = [0.0] * len(model.languages)
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        points = np.array([ord(c) for c in word], np.uint32).view(np.uint8)
        row = tables[0].get(int(hash_spans(points, np.array([0]), np.array([len(points)]))[0]))
        for size in sorted(model.grams, reverse=True):
            if row is not None:
                break
            padded = f" {word} " if size > 1 else word
            hashes = window_hashes(np.array([ord(c) for c in padded], np.uint64), size).tolist()
            known = [tables[size][h] for h in hashes if h in tables[size]]
            row = np.mean(known, axis=0).tolist() if known else None
        totals = [t + x for t, x in zip(totals, row or [0.0] * len(totals), strict=True)]
    return totals


def test_scores_against_one_word_at_a_time(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language(docs, LanguageParams(words=2_000, grams=500))
    texts = [r.text for r in docs.orderBy("doc_id").limit(500).collect()]
    totals, _ = model.totals(Letters(pa.array(texts)))
    plain = np.array([plain_scores(model, t) for t in texts])
    assert np.allclose(totals, plain)
    names, _ = model.predict(pa.array(texts))
    assert names == [model.languages[i] if any(c.isalpha() for c in t or "") else "und" for t, i in zip(texts, plain.argmax(1), strict=True)]


def test_repeated_rows_do_not_fill_the_sample(spark):
    many = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "'la vie' as text", "'fr' as lang")
    few = spark.createDataFrame([(i, f"word{i} the house", "en") for i in range(50)], "doc_id long, text string, lang string")
    docs = many.unionByName(few)
    model = fit_language(docs, LanguageParams(folds=4, held_out=9, sample_rows=100))
    assert model.languages == ["en", "fr"] and len(model.words.keys) < 60


def test_odd_rows(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (None, "ab", None, 1), (3, "ab " * 50_000, "fr", 1), (3, "ab " * 50_000, "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language(docs).collect())
    assert [g[1] for g in got if g[0] in "12"] == ["und", "und"] and len(got) == 5
    assert language(docs.limit(0)).count() == 0


def test_rare_language_is_learned(spark):
    rows = [(i, f"hello good world {i}", "en") for i in range(4000)] + [(5000 + i, "bonjour le monde", "fr") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language(docs, LanguageParams(sample_rows=40))
    assert model.languages == ["en", "fr"]
    assert model.predict(pa.array(["good world", "bonjour monde"]))[0] == ["en", "fr"]


def test_share_of_any_number_of_rows(spark):
    from ledgerscope.llm.labelled import in_share

    for rows, total in ((8_000, 10**13), (20_000, 10**17), (5, 20), (7, 3), (3, 0)):
        bound = int(min(1, rows / max(1, total)) * 2**62)
        hashed = spark.createDataFrame([(bound - bound // 1000 - 1,), (min(bound + bound // 1000 + 1, 2**62 - 1),)], "h long")
        got = [r[0] for r in hashed.select(in_share(F.col("h"), rows, total)).collect()]
        assert got == [True, rows >= max(1, total)], (rows, total)
