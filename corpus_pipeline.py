"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before kept and is written before the
next one reads it. The stages up to packing return the columns of documents,
whatever they are named; an empty table passes through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import chunk_dedup, ngram_join, pack, resample, toxic_pu
from geoloom.llm.queries import table, tokenizer_path
from geoloom.llm.scratch import Scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op10 does not flag. Null and empty texts are judged as texts without words; a null doc_id is judged like any."""
    return toxic_pu.drop_toxic(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op4 selects. Null and empty texts have log weight 0; rows that repeat id and text share their fate."""
    return resample.drop_unselected(docs, table(spark, sf_dir, "labels"), Scratch(spark, "quality"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id (null is smallest). Null and empty texts are equal; rows that repeat its id and text stay."""
    return chunk_dedup.drop_copies(docs, Scratch(spark, "exact"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest doc_id. Texts without words stay; rows that repeat its id stay."""
    return ngram_join.drop_near_copies(docs, Scratch(spark, "near"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows. Null and empty texts are the end id alone; a null doc_id is kept."""
    return pack.piece_table(pack.packed_pieces(docs, Scratch(spark, "packing"), tokenizer_path("byte_bpe_50k.json"), special=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Trained scores and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left of ``documents``."""
    kept = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept.keep(stage(spark, docs, sf_dir), name)
    return docs
