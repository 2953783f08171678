"""Exact deduplication with DataFrame functions only.

Texts are equal when they are byte for byte equal after the characters ``[\\x20\\x09-\\x0D]`` are
deleted.  Rows are grouped by a 128-bit content hash *and* the normalised bytes themselves, so two
texts that share a hash never share a group.  The partial aggregate runs before the shuffle: of a
group that fills a third of the table, each task sends one row.  Rows then find their group by hash
and SHA-256 in an equi-join of narrow rows, which adaptive execution may split when a hash is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import text_or_empty, without_ids

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def content_hash(norm: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(norm))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of a group, the row with the most code points in its original text stays, then the one with
    the smallest id.  A null text counts as empty; empty texts form one group.  Rows that repeat an
    id count each; each repeats in the result, and all rows of the kept id are ``kept``.  Null ids
    sort after all others.  Other columns of ``docs`` are ignored, whatever they are called.
    An empty table gives an empty result.  ``hash_of`` may be weak: equal bytes decide.
    """
    raw = text_or_empty(text_col)
    norm = normalised(raw)
    rows = docs.select(
        F.col(id_col).alias("id"),
        hash_of(norm).alias("h"),
        F.sha2(norm, 256).alias("sha"),
        F.struct((-F.char_length(raw)).alias("shorter"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id")).alias("rank"),
        norm.alias("norm"),
    )
    groups = (
        rows.groupBy("h", "sha", "norm")
        .agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select(F.col("h").alias("gh"), F.col("sha").alias("gsha"), F.col("best.id").alias("keep_id"), "group_size")
    )
    return rows.select("id", "h", "sha").join(groups, (F.col("h") == F.col("gh")) & (F.col("sha") == F.col("gsha"))).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns, whatever these are
    called.  Null texts are copies of empty ones.  Rows that repeat a kept id all stay, those that repeat a
    dropped id all go; rows with a null id stay; an empty table stays empty."""
    dropped = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(id_col).distinct()
    return without_ids(docs, dropped, id_col)
