"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (LZ78: each phrase is the longest
phrase known so far and one more character).  The phrases are hashed, and the
minimum of each of SLOTS hash functions over the phrase set is the signature.
Texts that compress alike have many phrases in common; the share of equal slots
estimates the Jaccard likeness of their phrase sets.  A fingerprint is the low
16 bits of each slot as hexadecimal text.

The dictionary starts anew after DICTIONARY phrases (the signature keeps what
was seen), so memory is bounded for texts of any length.

Defined results: null texts count as empty; the fingerprint of an empty text is
all ``f``, alike to another empty text (1.0) and unlike any other (0.0); of
documents with equal ids the order is that of their texts; rows with a null id
are left out; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.llm.common import batch_limits, bucket_of, range_cuts, shuffle_partitions, whole_text

SLOTS, DICTIONARY = 128, 1 << 18
_PRIME, _FACTOR = (1 << 40) - 87, 456_947
_EMPTY = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
_rng = np.random.default_rng(78)
_A = _rng.integers(1, 1 << 63, SLOTS, np.uint64)[:, None] | np.uint64(1)
_B = _rng.integers(0, 1 << 63, SLOTS, np.uint64)[:, None]


def _minimum(signature: np.ndarray, phrases) -> np.ndarray:
    """The signature with more phrase hashes taken in."""
    h = np.fromiter(phrases, np.uint64, len(phrases))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for i in range(0, len(h), 1024):  # stays in the processor's cache
        part = h[None, i:i + 1024] * _A + _B
        part ^= part >> np.uint64(32)
        signature = np.minimum(signature, part.min(axis=1))
    return signature


class Parse:
    """State of a parse: the phrases known, the phrase being read, and the
    signature of the phrases that are counted already."""

    __slots__ = ("known", "fresh", "node", "signature")

    def __init__(self):
        self.known, self.fresh, self.node, self.signature = set(), [], 0, _EMPTY

    def feed(self, text: str) -> "Parse":
        # A phrase is named by a hash of its characters, small enough for
        # short integers.
        node, known, fresh = self.node, self.known, self.fresh
        for c in text.encode() if text.isascii() else map(ord, text):
            node = (node + c + 1) * _FACTOR % _PRIME
            if node not in known:
                known.add(node)
                fresh.append(node)
                node = 0
                if len(known) >= DICTIONARY:
                    self._count()
                    known.clear()
        self.node = node
        return self

    def _count(self) -> None:
        if self.fresh:
            self.signature = _minimum(self.signature, self.fresh)
            self.fresh.clear()

    def fork(self) -> "Parse":
        self._count()
        other = Parse()
        other.known, other.node, other.signature = self.known.copy(), self.node, self.signature
        return other

    def result(self) -> np.ndarray:
        self._count()
        return (self.signature & np.uint64(0xFFFF)).astype(">u2")


def fingerprint(text: str | None) -> np.ndarray:
    return Parse().feed(text or "").result()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def with_edit(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of the text whose second half is replaced by
    the beginning of the following one, and that edited text."""
    half = len(text) // 2
    head = Parse().feed(text[:len(text) - half])
    edit = head.fork()
    put = following[:half]
    return head.feed(text[len(text) - half:]).result(), edit.feed(put).result(), text[:len(text) - half] + put


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t).tobytes().hex() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    batch_limits(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint next to that of its edited text, with the
    likeness of both and that to the next document (ascending id; after the
    last comes the first).

    Documents go to ranges of their id, one task each.  The first document of a
    range is also sent to the range before it, so that no text is joined."""
    spark = docs.sparkSession
    batch_limits(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).where(
        F.col("doc_id").isNotNull())
    buckets = shuffle_partitions(spark)
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), range_cuts(rows, "doc_id", buckets)).cast("int"))
    # As many numbers as ranges.
    firsts = sorted(rows.groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).collect())
    ahead = spark.createDataFrame(
        [(first["doc_id"], firsts[i - 1]["bucket"]) for i, first in enumerate(firsts)], "doc_id long, to int")
    copies = rows.join(F.broadcast(ahead), "doc_id").select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("ahead"))
    sent = rows.withColumn("ahead", F.lit(0)).unionByName(copies)

    def run(batches):
        waiting = None  # the last document read, with no successor yet
        done = False
        for batch in batches:
            out = []
            for doc_id, text, _, _ahead in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting is not None and not done:
                    out.append((*waiting, text))
                done = done or bool(_ahead)  # only the first of the next range counts
                waiting = (doc_id, text)
            yield _edits(out)

    return sent.repartitionById(buckets, "bucket").sortWithinPartitions("ahead", "doc_id", "text").mapInArrow(run, OUT)


def _edits(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    out, following = [], None
    own_of: dict[int, np.ndarray] = {}
    for i, (doc_id, text, after) in enumerate(rows):
        own, edited, edited_text = with_edit(text, after)
        own_of[i] = own
        out.append([doc_id, len(text), hashlib.sha256(edited_text.encode()).hexdigest(), own.tobytes().hex(),
                    edited.tobytes().hex(), likeness(own, edited), None])
    for i, row in enumerate(out):
        # The next row's own fingerprint, where it is of this batch.
        following = own_of[i + 1] if i + 1 < len(out) else fingerprint(rows[i][2])
        row[-1] = likeness(own_of[i], following)
    names = [f.split()[0] for f in OUT.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names)
