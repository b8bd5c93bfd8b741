"""Exact deduplication by content hash, with bytes compared inside every hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitcast.llm.common import SPACE, stage


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after every run of white space becomes one space; null counts as empty.
    A group's key is its 128-bit content hash. The first aggregate groups by the hash *and* the text, so Spark
    compares the bytes of every member with its group and combines copies before the shuffle: a text that a third
    of all rows share leaves each map task once. Texts that collide in 128 bits part by their SHA-256, and two
    texts that collide in both stop the job instead of merging. Only hashes and ids are joined back to the rows.

    Rows with a null id take part; an id that is null everywhere in a group keeps a null ``keep_id`` and the row.
    Rows that repeat an id and its text are all marked as kept when that id is the smallest; other columns are ignored.
    """
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    rows = docs.select("doc_id", text.alias("body")).select(
        "doc_id", "body", F.unhex(F.md5("body")).alias("content"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")
    )
    texts = rows.groupBy("content", "text_sha256", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = texts.groupBy("content", "text_sha256").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts")
    )
    checked = groups.select(
        "content", "text_sha256",
        F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("long")).alias("group_size"),
        "keep_id",
    )
    # read back from a table, so that adaptive execution can split a hot group of rows in this join
    return rows.drop("body").join(stage(checked, "groups"), ["content", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies, with all their columns; ids are taken as unique."""
    kept = exact_dedup(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")
