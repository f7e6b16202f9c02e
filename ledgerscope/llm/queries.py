"""One query per operator over its whole table, and SQL twins where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerscope.llm.bitslice import top_k
from ledgerscope.llm.bpe import token_digests
from ledgerscope.llm.decontaminate import contamination
from ledgerscope.llm.fill_in_middle import middle_digests
from ledgerscope.llm.language import language
from ledgerscope.llm.line_templates import line_report
from ledgerscope.llm.near_dedup import near_duplicates
from ledgerscope.llm.periodic import run_report
from ledgerscope.llm.pii import personal_data
from ledgerscope.llm.quality import quality
from ledgerscope.llm.quotes import reply_order
from ledgerscope.llm.toxicity import toxicity
from ledgerscope.llm.universe_join import similar_documents
from ledgerscope.session import ship_package

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(_table(spark, sf_dir, "conversations"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(_table(spark, sf_dir, "documents"))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return token_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(_table(spark, sf_dir, "documents"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_language_id": op7_language_id,
    "op8_bpe_encoding": op8_bpe_encoding,
    "op9_pii": op9_pii,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op3_line_dedup": r"""
        with lines as (
            select doc_id, generate_subscripts(parts, 1) as pos, unnest(parts) as line
            from (select doc_id, string_split(text, chr(10)) as parts from documents)
        ),
        tokens as (
            select doc_id, pos, line, list_transform(
                regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
                lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as t
            from lines
        ),
        keyed as (
            select doc_id, pos, unnest(case when len(t) >= 16 then [
                ['all', len(t)::varchar, t::varchar],
                ['first', len(t)::varchar, t[:3]::varchar, list_filter(t, lambda x, i: i % 2 = 1)::varchar],
                ['second', len(t)::varchar, t[:3]::varchar, list_filter(t, lambda x, i: i % 2 = 0)::varchar]]
                else [['all', len(t)::varchar, t::varchar]] end) as key
            from tokens where len(t) >= 5
        ),
        recurring as (
            select key, min(doc_id) as first_doc from keyed
            group by key having count(distinct doc_id) >= 2
        ),
        dropped as (
            select distinct k.doc_id, k.pos from keyed k join recurring r using (key)
            where k.doc_id <> r.first_doc
        )
        select l.doc_id, count(l.pos) as n_lines, count(d.pos) as n_dropped,
            sha256(coalesce(string_agg(l.line, chr(10) order by l.pos) filter (d.pos is null), ''))
                as text_sha256
        from lines l left join dropped d using (doc_id, pos)
        group by l.doc_id
    """,
    "op10_exact_top_k": """
        with rows as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings
            where vec_id is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        scored as (
            select q.vec_id as query_id, r.vec_id, list_dot_product(q.v, r.v)::bigint as score
            from rows q join rows r on q.vec_id <> r.vec_id
            where q.vec_id % 50 = 0
        )
        select query_id, vec_id, score,
            (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank
        from scored qualify rank <= 5
    """,
    "op12_fill_in_middle": r"""
        with lines as (
            select doc_id, coalesce(text, '') as text,
                regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as l,
                sha256('7:' || coalesce(doc_id::varchar, '')) as h
            from documents
        ),
        numbers as (
            select doc_id, text, l, len(l) as n,
                list_transform([1, 9, 17, 25], lambda i: ('0x' || h[i:i + 7])::bigint) as h
            from lines
        ),
        cuts as (
            select doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1)) as a,
                greatest(h[1] % (n + 1), h[2] % (n + 1)) as b, l,
                case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
                    then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form
            from numbers
        ),
        parts as (
            select doc_id, text, n, form, array_to_string(l[1:a], '') as p,
                array_to_string(l[a + 1:b], '') as m, array_to_string(l[b + 1:], '') as s
            from cuts
        )
        select doc_id, n, form,
            case when form <> 'plain' then length(p) end as prefix_chars,
            case when form <> 'plain' then length(m) end as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
            sha256(case form when 'plain' then text else p || m || s end) as restored_sha256
        from parts
    """,
}

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
