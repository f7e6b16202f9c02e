"""Every stage of the pipeline on its own input, against plain Python or the operator's report."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from ledgerscope.llm.decontaminate import contamination
from ledgerscope.llm.near_dedup import near_duplicates
from ledgerscope.llm.quality import quality
from test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = table("documents")
    columns = docs.columns
    by_name = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        by_name[name] = (before, {r.doc_id: r for r in out.collect()}, docs)
        if name != "bpe":
            assert out.columns == columns
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]

    before, after, given = by_name["quality"]
    good = {r.doc_id for r in quality(given, table("labels")).where("predicted = 1").collect()}
    assert set(after) == good and 0 < len(good) < len(before)
    assert all(after[i].text == before[i] for i in good)

    before, after, _ = by_name["line_dedup"]
    assert all(set((r.text or "").split("\n")) <= set((before[i] or "").split("\n")) for i, r in after.items())
    lines = {line for t in before.values() for line in (t or "").split("\n") if len(line.split()) >= 5}
    left = [line for r in after.values() for line in set((r.text or "").split("\n")) if len(line.split()) >= 5]
    assert len(left) == len(set(left)) and set(left) <= lines

    before, after, given = by_name["near_dedup"]
    classes = brute(list(before.items()))
    assert set(after) == {i for i, (_, c) in classes.items() if i == c}
    assert near_duplicates(given).where("kept").count() == len(after)

    before, after, given = by_name["decontamination"]
    hit = {r.doc_id for r in contamination(given, table("benchmark")).where("contaminated").collect()}
    assert all(after[i].text == t for i, t in before.items() if i not in hit)

    before, after, _ = by_name["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for i, text in before.items():
        assert after[i].input_ids == library.encode(text or "", add_special_tokens=False).ids
        assert after[i].round_trip and after[i].n_tokens == len(after[i].input_ids)


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated ids, clashing columns and empty tables go through every stage."""
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    given = given.select("doc_id", "text", "lang", "source", "n_chars", *[given["n_chars"].alias(c) for c in ("again", "special", "row", "left", "dropped")])
    odd = spark.createDataFrame(
        [(None, None), (None, "a b c d e f g"), (1, None), (1, "same same"), (1, "same same"), (2, ""), (3, "long " * 60_000)], "doc_id long, text string"
    )
    every = given.unionByName(odd, allowMissingColumns=True)
    for docs, name in ((every, "odd"), (every.limit(0), "none")):
        for stage_name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}-{stage_name}"
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (name == "odd")
        if name == "odd":
            assert docs.where("doc_id = 1").count() <= 1 and docs.where("not round_trip").count() == 0
