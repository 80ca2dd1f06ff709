"""A filtering pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``;
the last packs what is left into sequences.

Nulls, empty and very long texts, ties, repeated rows, empty tables and further
columns are treated as each stage's operator states in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.llm import exact_dedup, ngram_join, packing, suffix_dedup, toxicity
from starwright.llm.common import Scratch, table
from starwright.llm.tokens import tokenizer_path

# Documents at or above this score are rejected: all that the query predicts
# toxic.
REJECT = toxicity.THRESHOLD
# The shortest repeated passage that is removed: over 50 words.
PASSAGE_WORDS = suffix_dedup.PASSAGE_WORDS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.  The model is learnt from
    the labelled documents of ``sf_dir``."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, model, REJECT)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their 5-word shingles at 0.8, over any path, the
    one with the smallest id stays."""
    return ngram_join.drop_near_copies(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or of 400 bytes that occur more than once
    go from the texts; every document stays, if need be with an empty text."""
    return suffix_dedup.remove_repeats(docs, words=PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", remove_repeats),
    ("best_fit_packing", pack),
]

# Compression lengths, trained models and tokenizers cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
