"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text is normalised (A-Z to a-z) and cut where its own content says so: after
the first clause end beyond ``MIN_CHUNK`` characters, else after the first sign
or blank, else after the first of a few marker characters; only a run of
``MAX_CHUNK`` characters with none of these is cut by length. Each chunk is
named by its SHA-256, and a document is the ordered list of its chunks' names:
its recipe, made where the document is read.

Names are verified: every distinct chunk moves once to see that no name stands
for two contents (should one do, contents take the place of names). Documents
are then compared by their recipes alone, so that no text moves for it.

Defined cases: null text counts as empty; empty texts are equal to each other;
rows that repeat a doc_id and text are equal, and all rows that carry the
largest doc_id of their group are marked kept; a null doc_id is smaller than
any number; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.scratch import Scratch, free_name
from geoloom.llm.skew import attach

MIN_CHUNK, MAX_CHUNK = 256, 2048
#: Where a chunk may end, best first: clause ends, blanks and signs, frequent marker characters.
CUTS = (r"[.,;:!?]\s|[\n。！？；，、…।؟]", r"[^\p{L}\p{N}]", "[07jqxz的了在のはを이는]")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z to a-z and nothing else; null as empty. ASCII texts take the fast path."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def chunks(text: Column) -> Column:
    """The text as an array of content-defined chunks, whose concatenation it is."""
    ways = [rf".{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:{cut})" for cut in CUTS] + [rf".{{1,{MAX_CHUNK}}}"]
    return F.regexp_extract_all(text, F.lit(f"(?s)({'|'.join(ways)})"), F.lit(1))


def chunk_name(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def exact_groups(documents: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", name: Callable[[Column], Column] = chunk_name) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = documents.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    row = lambda names: docs.select("doc_id", F.sha2("t", 256).alias("sha"), F.transform(chunks(F.col("t")), names).alias("recipe"))
    pieces = docs.select(F.explode(chunks(F.col("t"))).alias("chunk")).select(name(F.col("chunk")).alias("name"), "chunk").distinct()
    unsound = pieces.groupBy("name").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")
    sound = not unsound.limit(1).count()
    rows = scratch.keep(row(name if sound else lambda c: F.encode(c, "UTF-8")), "recipes")
    groups = scratch.keep(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "groups")
    found = attach(rows, groups, "recipe", "group_size", rows.count())
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.when(single, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(documents: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which ``exact_groups`` says that they are kept; all columns stay.

    Rows that repeat both doc_id and text of a kept document stay with it; null
    and empty texts are one group; an empty table stays empty.
    """
    gone_id, gone_sha = free_name(documents, "gone_id"), free_name(documents, "gone_sha")
    gone = scratch.keep(exact_groups(documents, scratch, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct(), "gone")
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.sha2(normalised(F.col(text_col)), 256) == F.col(gone_sha))
    return documents.join(gone.hint("shuffle_hash"), same, "left_anti")
