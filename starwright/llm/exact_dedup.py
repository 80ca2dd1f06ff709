"""Exact de-duplication by progressive refinement (DataFrame functions only).

Rows are grouped by the length of their normalised text, the groups of two or
more by a hash of a prefix, and what is left by a hash of the full text.  Only
rows that are still in a group after the first two steps have their full text
read again, so the text of documents without a copy is never hashed or moved.

Defined results: a null text counts as empty; empty texts are equal to each
other.  Of equal texts the row with the smallest id stays.  Rows that repeat
both id and text are one document, but ``group_size`` counts each of them.
Rows with a null id take no part.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwright.llm.common import Scratch, unused, whole_text

PREFIX_CHARS = 256
# Runs of white space other than a single space; a single space stays.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """Text with each run of ASCII white space replaced by one space."""
    return F.regexp_replace(whole_text(text), _RUNS, " ")


def text_hash(text: str | Column) -> Column:
    """SHA-256 (lowercase hex) of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, text_sha256, rows, keep_id, group_size) for each
    document that has a copy: ``keep_id`` is the smallest id among its copies,
    ``rows`` how often this id and text occur, ``group_size`` the rows of the
    group.  The steps are written to scratch tables."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    norm = normalised("text")
    features = scratch.write(docs.select(
        "doc_id", F.octet_length(norm).alias("n_bytes"),
        F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix_hash")), "features")
    # 1: lengths, 2: prefix hashes among rows of a repeated length.
    lengths = features.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes")
    same_length = features.join(lengths, "n_bytes", "left_semi")
    prefixes = same_length.groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n")).where("n > 1")
    survivors = scratch.write(
        same_length.join(prefixes.select("n_bytes", "prefix_hash"), ["n_bytes", "prefix_hash"], "left_semi")
        .select("doc_id"), "survivors")
    # 3: full text of the survivors only.
    full = scratch.write(
        docs.join(survivors, "doc_id", "left_semi").select("doc_id", text_hash("text").alias("text_sha256"))
        .groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows")), "full")
    groups = full.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    out = scratch.write(full.join(groups.where("group_size > 1"), "text_sha256"), "groups")
    scratch.drop("features", "survivors", "full")
    return out


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, kept or not: doc_id, keep_id, group_size, kept,
    text_sha256."""
    groups = copy_groups(docs, id_col, text_col).select("doc_id", "text_sha256", "keep_id", "group_size")
    every = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_sha256")).distinct()
    keep = F.coalesce("keep_id", "doc_id")
    return every.join(groups, ["doc_id", "text_sha256"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id") == keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the copies, columns as they are.  The rows
    meet one narrow table of what goes; of rows that repeat both id and text, if
    there are any, one comes back."""
    groups = copy_groups(docs, id_col, text_col)
    gone = groups.where("doc_id <> keep_id or rows > 1").select("doc_id", "text_sha256")
    sha = unused("text_sha256", docs)
    hashed = docs.withColumn(sha, text_hash(text_col))
    on = lambda left, other: (left[id_col] == other["doc_id"]) & (left[sha] == other["text_sha256"])
    kept = hashed.join(gone, on(hashed, gone), "left_anti").drop(sha)
    again = groups.where("doc_id = keep_id and rows > 1").select("doc_id", "text_sha256")
    if again.isEmpty():
        return kept
    once = hashed.join(again, on(hashed, again), "left_semi").dropDuplicates([id_col, sha])
    return kept.unionByName(once.drop(sha))
