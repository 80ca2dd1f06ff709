"""Token ids of a corpus in compressed files, in ascending document order.

Format (a folder; every part is Parquet, so it can be written and read wherever
Spark reads and writes, and a lost task is simply run again):

* ``table``: one row, the symbol counts of the whole corpus (unsigned 64-bit);
* ``blocks``: one row per block: ``bucket`` and ``block`` (its place),
  ``first`` (number of ids before it: the checkpoint a reader can start from),
  ``runs`` (for each run of ids in it: the document, the number of ids before
  the document, the document's ids in earlier blocks, the length of the run,
  and whether it is the whole document) and ``payload``, a block of ``rans``,
  which carries its own checksums.

Blocks are independent.  A block holds whole documents, up to BLOCK ids; a
longer document takes blocks of its own.  Documents are dealt out by ranges of
their id, so that no task holds more than its range.

Defined results: null texts are empty documents (the end id alone); documents
of equal id are ordered by their ids' bytes; a null id sorts first; further
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.llm import rans
from starwright.llm.common import (Scratch, batch_limits, bucket_of, range_cuts, shuffle_partitions,
                                   whole_text)
from starwright.llm.tokens import word_encoder

BLOCK, END_ID = 1 << 17, 1
RUN = ("doc_id", "start", "skip", "length", "whole")
_RUN_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
BLOCKS = ("bucket int, block int, first long, runs array<struct<doc_id:long,start:long,skip:long,length:long,"
          "whole:boolean>>, payload binary")


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (packed 16-bit, end id included) of each document."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        encoder = word_encoder(tokenizer, "<u2")
        for batch in batches:
            ids = [x + end for x in encoder.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    batch_limits(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids binary")


def symbol_counts(ids: DataFrame) -> np.ndarray:
    """How often each symbol occurs in all documents (SYMBOLS numbers)."""

    def run(batches):
        counts = np.zeros(rans.SYMBOLS, np.int64)
        for batch in batches:
            packed = b"".join(batch.column(0).to_pylist())
            counts += np.bincount(np.frombuffer(packed, "<u2"), minlength=rans.SYMBOLS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["symbol", "n"])

    rows = ids.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(rans.SYMBOLS, np.int64)
    for symbol, n in rows:
        counts[symbol] = n
    return counts


def write_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = END_ID) -> None:
    """Encodes all documents into the folder ``path``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    ids = scratch.write(encode_documents(docs, tokenizer, id_col, text_col, end_id), "ids")
    counts = symbol_counts(ids)
    spark.createDataFrame([(bytearray(counts.astype("<u8").tobytes()),)], "counts binary").coalesce(1).write.parquet(
        f"{path}/table")
    buckets = shuffle_partitions(spark)
    bucket = bucket_of(F.col("doc_id"), range_cuts(ids, "doc_id", buckets))
    bucketed = ids.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(bucket).cast("int"))
    # Ids before each bucket: as many numbers as buckets.
    sizes = dict(bucketed.groupBy("bucket").agg(F.sum(F.length("ids") / 2).cast("long")).collect())
    first, before = {}, 0
    for b in range(buckets):
        first[b] = before
        before += sizes.get(b, 0)
    shared = spark.sparkContext.broadcast(counts)

    def run(batches):
        table = rans.Table(shared.value)
        at, block, bucket, runs, parts, size = 0, 0, None, [], [], 0

        def finished():
            symbols = np.concatenate(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([at - size]),
                 pa.array([[dict(zip(RUN, r)) for r in runs]], pa.list_(pa.struct(list(zip(RUN, _RUN_TYPES))))),
                 pa.array([rans.encode(symbols, table)], pa.binary())],
                ["bucket", "block", "first", "runs", "payload"])

        for batch in batches:
            for doc_id, packed, b in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    if size:
                        yield finished()
                    at, block, bucket, runs, parts, size = first[b], 0, b, [], [], 0
                symbols, start = np.frombuffer(packed, "<u2"), at
                for cut in range(0, len(symbols), BLOCK):
                    own = symbols[cut: cut + BLOCK]
                    if size and size + len(own) > BLOCK:
                        yield finished()
                        block, runs, parts, size = block + 1, [], [], 0
                    runs.append((doc_id, start, cut, len(own), len(own) == len(symbols)))
                    parts.append(own)
                    size += len(own)
                    at += len(own)
        if size:
            yield finished()

    (bucketed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
     .mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks"))
    scratch.drop("ids")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of ids, decoded block by block: doc_id, start, skip, length, whole
    and ids (packed unsigned 32-bit numbers)."""
    return _decoded(spark, _blocks(spark, path), path, lambda ids: ids.tobytes(), "ids", "binary", pa.binary())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as packed unsigned
    32-bit numbers) of each document, from the files.  Only documents of more
    than one block are put together again."""
    blocks = _blocks(spark, path)
    runs = _decoded(spark, blocks, path, zlib.crc32, "ids_crc32", "long", pa.int64())
    whole = runs.where("whole").select("doc_id", "start", F.col("length").alias("n_tokens"), "ids_crc32")
    cut = blocks.where(F.exists("runs", lambda r: ~r["whole"]))
    cut = _decoded(spark, cut, path, lambda ids: ids.tobytes(), "ids", "binary", pa.binary()).where("not whole")
    parts = F.sort_array(F.collect_list(F.struct("skip", "ids")))
    joined = cut.groupBy("doc_id", "start").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "doc_id", "start", "n_tokens",
        F.crc32(F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))).alias("ids_crc32"))
    return whole.unionByName(joined)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    batch_limits(spark)
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def _decoded(spark: SparkSession, blocks: DataFrame, path: str, value, name: str, sql_type: str, kind) -> DataFrame:
    counts = np.frombuffer(spark.read.parquet(f"{path}/table").first()["counts"], "<u8").astype(np.int64)
    shared = spark.sparkContext.broadcast(counts)
    types = [*_RUN_TYPES, kind]

    def run(batches):
        table = rans.Table(shared.value)
        for batch in batches:
            for runs, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                symbols, out, at = rans.decode(payload.as_py(), table).astype("<u4"), [], 0
                for r in runs:
                    out.append((*(r[k] for k in RUN), value(symbols[at: at + r["length"]])))
                    at += r["length"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*RUN, name])

    fields = ", ".join(f"{k} {'boolean' if k == 'whole' else 'long'}" for k in RUN)
    return blocks.select("runs", "payload").mapInArrow(run, f"{fields}, {name} {sql_type}")
