"""Registered queries of the subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import ann, chunk_dedup, html_text, license_rules, ngram_join, pack, resample, sp_codec, toxic_pu, warc
from geoloom.llm.scratch import Scratch

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(table(spark, sf_dir, "pages"), Scratch(spark, "op1"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest,
       case when strlen(h) >= 100 and page_id > min(page_id) over (partition by h) then 'revisit' else 'response' end as record_type,
       case when strlen(h) >= 100 and page_id > min(page_id) over (partition by h) then min(page_id) over (partition by h) end as refers_to
from (select page_id, coalesce(html, '') as h from pages)
"""


def op2_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack.packed_pieces(table(spark, sf_dir, "documents"), Scratch(spark, "op2"), tokenizer_path("byte_bpe_50k.json"), special=True)
    return pack.piece_table(pieces)


def op3_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op4"))


def op5_ngram_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))


def op8_shared_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_pu.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op10"))


OP5_SQL = rf"""
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x20\x09-\x0D]+') as w from documents),
g as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from t),
n as (select doc_id, count(*) as n from g group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c.c >= 75 * (p.n + q.n - c.c)),
r(x, y) as (select x, y from l union select r.x, l.y from r join l on l.x = r.y)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select x, min(y) as m from r group by x) m on m.x = d.doc_id
"""
OP9_SQL = f"""
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text, ''), {UPPER_LOWER}) as t from documents)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": op1_warc_index,
    "op2_concat_and_cut": op2_concat_and_cut,
    "op3_tree_scoring": op3_tree_scoring,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_ngram_product": op5_ngram_product,
    "op6_signature_rules": op6_signature_rules,
    "op7_learned_partitions": op7_learned_partitions,
    "op8_shared_viterbi": op8_shared_viterbi,
    "op9_chunk_recipes": op9_chunk_recipes,
    "op10_positive_unlabelled": op10_positive_unlabelled,
}
ORACLE: dict[str, str] = {"op1_warc_index": OP1_SQL, "op5_ngram_product": OP5_SQL, "op9_chunk_recipes": OP9_SQL}
