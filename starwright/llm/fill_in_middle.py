"""Fill-in-the-middle transformation of documents.

A text is cut at two unit boundaries into prefix, middle and suffix, and put
together anew with marks, so that a model learns to fill the middle.  Where to
cut and which form to take follow from a hash of a seed and the document's id.

The boundary after u units is found with a Fenwick tree over fixed blocks of the
text's bytes: each block counts the units and the code points that begin in it,
a binary-lifting descent finds the block in which unit u begins (adding up the
code points before it on the way), and only that block is searched.

Units are code points, words (with the white space that follows them) or lines
(with their line feed); each text is wholly cut into units from left to right.

Defined results: a null text is empty; an empty text, or one that holds a mark,
stays plain; a null id is hashed as the empty id; rows that repeat are
transformed alike, one output row per input row; further columns are ignored;
an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwright.llm.common import batch_limits, whole_text

# Bytes per block of the tree, and blocks that are counted at a time.
BLOCK, COUNTED = 512, 2048
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Infill:
    """How documents are transformed.  Marks must not hold each other's first
    character but at their start, so that they are found again."""

    seed: int = 1
    unit: str = "code_point"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed: int = 90  # per cent of the documents
    spm: int = 20  # per cent of the transformed ones

    def __post_init__(self):
        heads = {m[:1] for m in self.marks}
        if "" in heads or len(set(self.marks)) < 3 or any(h in m[1:] for h in heads for m in self.marks):
            raise ValueError("marks cannot be told apart")
        if self.unit not in UNITS:
            raise ValueError(f"unknown unit {self.unit}")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _code_points(data: np.ndarray) -> np.ndarray:
    return (data[1:] & 0xC0) != 0x80


def _words(data: np.ndarray) -> np.ndarray:
    space = (data == 0x20) | (data >= 0x09) & (data <= 0x0D)
    return space[:-1] & ~space[1:]


def _lines(data: np.ndarray) -> np.ndarray:
    return data[:-1] == 0x0A


# Which bytes begin a unit; the first byte given is the one before them.
UNITS = {"code_point": _code_points, "word": _words, "line": _lines}


class BlockTree:
    """Fenwick tree of the units and code points that begin in each block."""

    def __init__(self, text: bytes, unit: str = "code_point"):
        self.data = np.frombuffer(text, np.uint8)
        self.unit = unit
        self.blocks = -(-len(text) // BLOCK)
        self.tree = np.zeros((2, self.blocks + 1), np.int64)
        for lo in range(0, self.blocks, COUNTED):
            hi = min(lo + COUNTED, self.blocks)
            at = np.arange(0, (hi - lo) * BLOCK, BLOCK)
            for row, begins in enumerate(self._begins(lo, hi)):
                self.tree[row, lo + 1:hi + 1] = np.add.reduceat(begins, at, dtype=np.int64)
        self.n, self.n_chars = (int(x) for x in self.tree.sum(axis=1))
        step = 1
        while 2 * step <= self.blocks:  # node 2k * step adds the node step below it
            self.tree[:, 2 * step::2 * step] += self.tree[:, step:self.blocks + 1 - step:2 * step]
            step *= 2

    def _begins(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """For the bytes of some blocks: does a unit begin, does a code point."""
        own = self.data[max(lo * BLOCK - 1, 0):hi * BLOCK]
        if lo == 0:
            own = np.concatenate([own[:1], own])
        units, chars = UNITS[self.unit](own), _code_points(own)
        if lo == 0:  # the text's first byte begins a unit whatever it is
            units[0] = True
        return units, chars

    def cut(self, u: int) -> tuple[int, int]:
        """The byte at which unit ``u`` (from 0) begins, or the text ends, and
        the code points before it."""
        if u >= self.n:
            return len(self.data), self.n_chars
        block, chars, left = 0, 0, u
        step = 1 << (self.blocks.bit_length() - 1)
        while step:
            if block + step <= self.blocks and (units := int(self.tree[0, block + step])) <= left:
                block += step
                left -= units
                chars += int(self.tree[1, block])
            step >>= 1
        units, begin = self._begins(block, block + 1)
        at = int(np.flatnonzero(units)[left])
        return block * BLOCK + at, chars + int(np.count_nonzero(begin[:at]))


def draws(id_col: str | Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hash of a seed and an id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, how: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm),
    prefix_chars, middle_chars (code points; null if plain), output."""
    prefix, suffix, middle = (m.encode() for m in how.marks)

    def one(text: bytes, h1: int, h2: int, h3: int, h4: int):
        tree = BlockTree(text, how.unit)
        if not text or prefix in text or suffix in text or middle in text or h3 % 100 >= how.transformed:
            return tree.n, PLAIN, None, None, text
        (a, before), (b, until) = (tree.cut(u) for u in sorted((h1 % (tree.n + 1), h2 % (tree.n + 1))))
        head, body, tail = text[:a], text[a:b], text[b:]
        if h4 % 100 < how.spm:
            return tree.n, SPM, before, until - before, b"".join((suffix, tail, prefix, head, middle, body))
        return tree.n, PSM, before, until - before, b"".join((prefix, head, suffix, tail, middle, body))

    def run(batches):
        for batch in batches:
            numbers = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
            rows = [one(t.as_buffer().to_pybytes(), *h) for t, h in zip(batch.column(1), numbers)]
            if rows:
                n, form, before, between, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()),
                     pa.array(between, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    batch_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), *draws(id_col, how.seed))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, how: Infill = Infill()) -> Column:
    """The text of an output and its form."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in how.marks))
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return (F.when(form == PSM, F.concat(first, third, second))
            .when(form == SPM, F.concat(second, third, first)).otherwise(output))
