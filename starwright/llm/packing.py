"""Best-two-fit packing of documents into sequences of bounded length.

Every document becomes its token ids and an end id; only longer ones are cut
into pieces of the sequence length.  Lengths are whole numbers from 1 to
``capacity``, so the packing is planned on the histogram of lengths alone: the
driver sees ``capacity`` counts, however large the corpus is.  The plan is a
list of bin patterns, each with the number of bins it is used for:

1. fill greedily: take the longest length left that fits, until none fits;
2. if room is left, take the bin's smallest piece out again and put in the two
   unpacked lengths that fit the expanded gap most tightly, if they fill it
   better than the smallest piece did.

A pattern is repeated as long as the counts allow, so each pattern uses up a
length or leaves fewer of it than a bin holds; with capacity c there are at
most sum(c / l + 1 for l in 1..c) patterns.  Pieces then find their place by
their rank among the pieces of equal length: (rank within the task that wrote
the piece) + (pieces of that length in earlier tasks).  No length is gathered
in one task.

Defined results: null texts are empty documents (the end id alone); rows with
equal ids and texts are separate documents, also those with a null id; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starwright.llm.common import Scratch, batch_limits, whole_text
from starwright.llm.tokens import word_encoder

CAPACITY, END_ID = 2048, 0

PIECES = ("part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths of one bin, number of such bins) that pack
    ``counts[l]`` pieces of each length l; the capacity is the last index."""
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    at = np.arange(capacity + 1)
    out = []
    while left.any():
        free = left.copy()
        bin_, room = [], capacity
        while (fits := np.flatnonzero(free[: room + 1])).size:
            length = int(fits[-1])
            take = min(int(free[length]), room // length)
            bin_ += [length] * take
            free[length] -= take
            room -= take * length
        if room:
            two = _two_tightest(free, at, room + bin_[-1])
            if sum(two) > bin_[-1]:
                bin_[-1:] = two
        need = Counter(bin_)
        times = min(int(left[length]) // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
        out.append((bin_, times))
    return out


def _two_tightest(free: np.ndarray, at: np.ndarray, gap: int) -> list[int]:
    """The two free lengths of the largest sum within ``gap``, or nothing."""
    low = np.maximum.accumulate(np.where(free > 0, at, 0))  # longest free length up to an index
    x = np.flatnonzero(free[:gap])
    if not x.size:
        return []
    most = np.minimum(x, gap - x)
    y = low[most]
    lone = (y == x) & (free[x] < 2)  # the only piece of its length is no pair
    y[lone] = low[np.maximum(most[lone] - 1, 0)]
    y[low[most] == 0] = 0
    total = np.where(y > 0, x + y, 0)
    best = int(total.argmax())
    return [int(x[best]), int(y[best])] if total[best] else []


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
               text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the
    piece's task and rank among the task's pieces of its length.  To be written
    before use: task and rank hold for one run of the tasks."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()),
                        ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        encoder, ranks, part = word_encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, packed in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                packed += end
                for piece, start in enumerate(range(0, len(packed) // 4, capacity)):
                    own = packed[4 * start: 4 * (start + capacity)]
                    length = len(own) // 4
                    rows.append((part, ranks[length], doc_id, piece, start, length, zlib.crc32(own)))
                    ranks[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    batch_limits(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), whole_text(text_col).alias("text")).mapInArrow(run, PIECES)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    # Runs of places: pieces of one length with ranks from ``first`` go to the
    # sequences from ``sequence``, one each, at the same offset.
    taken, runs, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for lengths, times in best_two_fit(counts):
        offset = 0
        for length in lengths:
            runs.append((length, int(taken[length]), sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    runs = np.array(sorted(runs), np.int64).reshape(-1, 4)
    places = spark.sparkContext.broadcast((runs[:, 0] << 44 | runs[:, 1], runs))

    earlier = (pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
               .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")
                                                     .rowsBetween(Window.unboundedPreceding, -1)))
               .select("length", "part", F.coalesce("before", F.lit(0)).alias("before")))
    ranked = pieces.join(earlier, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches):
        keys, runs = places.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            own = runs[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(own[:, 2] + rank - own[:, 1]), pa.array(own[:, 3])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(cut_pieces(docs, tokenizer, capacity, id_col, text_col, end_id), "pieces")
    return place_pieces(pieces, capacity)
