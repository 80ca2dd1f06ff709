"""Repeated-passage removal by a depth-limited radix sort of suffixes.

Every suffix of every text is a position; two suffixes are equal to depth
``depth`` when the next ``depth`` bytes are.  The sort goes by digits, most
significant first, and only groups of two or more go on to the next digit.
Order inside a digit is of no use here, so a digit's value is a hash and a pass
is a count by key.  As equality does not depend on the order in which the bytes
of the window are looked at, the most significant digit is chosen to make
neighbours share it:

1. *gram*: a window's leftmost smallest gram (by hash) of GRAM bytes.  Equal
   windows have equal grams at equal offsets.  Neighbouring suffixes share one
   gram and travel as one record, a run, so the first pass moves one record for
   about (depth - GRAM) / 2 suffixes.  A run that occurs again as a whole is
   done; a run whose gram occurs once is dropped.
2. *core*: runs left open are split by the gram's offset into parts of STEP
   suffixes at most; the digit is the bytes that all suffixes of a part share.
   Again, parts that occur again as a whole are done, parts with a unique core
   are dropped.
3. *full depth*: each suffix of the parts still open, with a hash of its
   ``depth`` bytes.  Equal groups are exactly the repeated windows.

Keys that decide (whole run, whole part, window) are 128-bit hashes; grams and
cores only choose candidates.  A digit that many suffixes share is counted
before it is shuffled and joined back to them with a join that Spark can split.

The same sort finds passages by words: a text's letters are then not its bytes
but 64-bit hashes of its words (runs of other than ASCII white space), WORD_BYTES
wide, so that white space between words does not matter.

Defined results: a null text is empty; texts shorter than ``depth`` bytes keep
every byte; a text is a row, so equal rows repeat each other; rows with a null
id take part like others; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.llm.common import Scratch, batch_limits, unused, whole_text

DEPTH, GRAM, STEP = 400, 64, 42
WORD_BYTES, WORD_GRAM, WORD_STEP = 8, 8, 6
# The shortest repeated passage that counts by its words: over 50 words.
PASSAGE_WORDS = 51
_WORD = re.compile(rb"\S+")
# Bytes looked at together; positions in a buffer take the low bits of a key.
BUFFER_BITS = 20
_BUFFER = 1 << BUFFER_BITS
_BASE = 0x9E3779B97F4A7C15 | 1

_ROW = ("doc_id", "text_key")  # names a row: its id and a hash of its text


# ---------------------------------------------------------------- positions

def _letters(data: bytes, width: int) -> bytes:
    """A text as letters of ``width`` bytes: its bytes, or hashes of its words."""
    return data if width == 1 else b"".join(map(xxhash.xxh3_64_digest, data.split()))


class _Grams:
    """Hashes of all grams of a buffer, by one multiplication per byte."""

    def __init__(self, gram: int):
        self.gram = gram
        powers = np.full(_BUFFER, _BASE, np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        inverse = np.full(_BUFFER, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        h = (sums[self.gram:] - sums[:-self.gram]) * self.inverse[: n - self.gram + 1]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def _runs_of(data: np.ndarray, ends: np.ndarray, grams: _Grams, depth: int):
    """Runs of suffixes that share a gram: first position, number, position of
    the gram, gram hash.  ``ends``: for each position the end of its text."""
    n = len(data)
    if n < depth:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = grams(data)
    low = np.uint64(_BUFFER - 1)
    keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
    own = (_sliding_min(keys, depth - grams.gram + 1) & low).astype(np.int64)
    at = np.arange(len(own))
    inside = at + depth <= ends[: len(own)]
    first = inside.copy()
    first[1:] &= (own[1:] != own[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(first)
    # A run ends where the next one begins or its text has no more suffixes.
    stop = np.minimum(np.append(starts[1:], len(own)), ends[starts] - depth + 1)
    return starts, stop - starts, own[starts], h[own[starts]]


def _buffers(rows, depth: int, width: int = 1):
    """Texts joined to buffers of at most _BUFFER letters; longer texts are cut
    with an overlap that gives each suffix to one buffer.  Yields the buffer,
    where its texts begin and end, and (row, offset of the buffer in it)."""
    parts, marks, size = [], [], 0
    for row, text in rows:
        for cut in range(0, max(len(text) // width - depth + 1, 1), _BUFFER - depth + 1):
            own = text[cut * width: (cut + _BUFFER) * width]
            n = len(own) // width
            if n < depth:
                continue
            if size + n > _BUFFER:
                yield b"".join(parts), marks
                parts, marks, size = [], [], 0
            marks.append((row, cut, size, size + n))
            parts.append(own)
            size += n
    if parts:
        yield b"".join(parts), marks


def _digest(view: memoryview, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit hashes of byte ranges, as two columns of 64 bits."""
    join = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist())])
    return np.frombuffer(join, "<i8").reshape(-1, 2)


def find_runs(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, width: int = 1) -> DataFrame:
    """Runs of all texts: doc_id, text_key, start, n (suffixes), gram_at (offset
    of the gram from the start), digit (the gram), whole_a, whole_b."""

    def run(batches):
        grams = _Grams(gram)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            texts = [_letters(t.as_buffer().to_pybytes(), width) for t in batch.column(2)]
            for data, marks in _buffers(enumerate(texts), depth, width):
                rows, cuts, begins, stops = (np.array(x) for x in zip(*marks))
                ends = np.repeat(stops, stops - begins)
                start, n, at, digit = _runs_of(np.frombuffer(data, f"<u{width}"), ends, grams, depth)
                if not start.size:
                    continue
                whole = _digest(memoryview(data), start * width, (start + n - 1 + depth) * width)
                own = np.searchsorted(begins, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows[own])), keys.take(pa.array(rows[own])),
                     pa.array((start - begins[own] + cuts[own]).astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array((at - start).astype(np.int32)), pa.array(digit.view(np.int64)),
                     pa.array(whole[:, 0]), pa.array(whole[:, 1])],
                    ["doc_id", "text_key", "start", "n", "gram_at", "digit", "whole_a", "whole_b"])

    return docs.mapInArrow(run, "doc_id long, text_key long, start int, n int, gram_at int, digit long, "
                                "whole_a long, whole_b long")


def split_runs(runs: DataFrame, depth: int = DEPTH, step: int = STEP, width: int = 1) -> DataFrame:
    """Parts of runs with their bytes: suffixes whose gram has an offset in one
    stretch of ``step``; digit is the hash of the bytes they all share."""

    def run(batches):
        for batch in batches:
            out, whole = [], []
            for i, (start, n, gram_at, data) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                # Offsets of the gram in the run's suffixes: gram_at down to gram_at - n + 1.
                for k in range((gram_at - n + 1) // step, gram_at // step + 1):
                    lo, hi = max(gram_at - (k + 1) * step + 1, 0), min(gram_at - k * step, n - 1)
                    core = data[(gram_at - k * step) * width: (gram_at - (k + 1) * step + 1 + depth) * width]
                    out.append((i, start + lo, hi - lo + 1, start, xxhash.xxh3_64_intdigest(core, k) - (1 << 63)))
                    whole.append(xxhash.xxh3_128_digest(data[lo * width: (hi + depth) * width]))
            if out:
                i, at, n, of, digit = zip(*out)
                whole = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(at, pa.int32()),
                     pa.array(n, pa.int32()), pa.array(of, pa.int32()), pa.array(digit, pa.int64()),
                     pa.array(whole[:, 0]), pa.array(whole[:, 1])],
                    ["doc_id", "text_key", "start", "n", "run", "digit", "whole_a", "whole_b"])

    return runs.select(*_ROW, "start", "n", "gram_at", "bytes").mapInArrow(
        run, "doc_id long, text_key long, start int, n int, run int, digit long, whole_a long, whole_b long")


def single_suffixes(parts: DataFrame, depth: int = DEPTH, width: int = 1) -> DataFrame:
    """Each suffix of parts, given with their run's start and bytes, with the
    hash of its window."""

    def run(batches):
        for batch in batches:
            rows, at, whole = [], [], []
            for i, (start, n, of, data) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                for p in range(start, start + n):
                    rows.append(i)
                    at.append(p)
                    whole.append(xxhash.xxh3_128_digest(data[(p - of) * width: (p - of + depth) * width]))
            whole = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())),
                 pa.array(at, pa.int32()), pa.array(whole[:, 0]), pa.array(whole[:, 1])],
                ["doc_id", "text_key", "start", "whole_a", "whole_b"])

    return parts.select(*_ROW, "start", "n", "run", "bytes").mapInArrow(
        run, "doc_id long, text_key long, start int, whole_a long, whole_b long")


# ---------------------------------------------------------------- passes

def _pass(records: DataFrame, scratch: Scratch, name: str, extra: str) -> tuple[DataFrame, DataFrame]:
    """One radix pass over written records: the records whose suffixes all
    occur again, and one record of each kind that shares its digit with another
    kind (also of a kind that is done: others may repeat a part of it)."""
    whole = ["whole_a", "whole_b"]
    differ = [F.min(c) != F.max(c) for c in whole]
    digits = records.groupBy("digit").agg((differ[0] | differ[1]).alias("shared")).where("shared")
    groups = records.groupBy(*whole).agg(
        F.count("*").alias("same"), F.min("digit").alias("digit"),
        F.min(F.struct(*_ROW, "start", "n", extra)).alias("one"))
    classes = scratch.write(groups.join(digits, "digit", "left").where("same > 1 or shared")
                            .select(*whole, "same", "shared", "one"), f"{name}-classes")
    repeated = records.join(classes.where("same > 1").select(*whole), whole).select(*_ROW, "start", "n")
    return repeated, classes.where("shared").select("one.*")


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def _spans(repeated: DataFrame, depth: int, width: int) -> DataFrame:
    """Ranges of letters per text that repeated suffixes cover."""
    return repeated.groupBy(*_ROW).agg(F.collect_list(F.struct(
        "start", (F.col("start") + F.col("n") - 1 + depth).alias("stop"), F.lit(width).alias("width"))).alias("spans"))


def _word_runs(texts: DataFrame) -> DataFrame:
    """The letters of runs of words; the last columns are text and runs."""

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i, (text, runs) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                data = _letters(text.as_buffer().to_pybytes(), WORD_BYTES)
                for r in runs:
                    rows.append(i)
                    out.append((r["start"], r["n"], r["gram_at"],
                                data[r["start"] * WORD_BYTES: r["stop"] * WORD_BYTES]))
            if out:
                start, n, gram_at, data = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                     *(pa.array(c, pa.int32()) for c in (start, n, gram_at)), pa.array(data, pa.binary())],
                    ["doc_id", "text_key", "start", "n", "gram_at", "bytes"])

    return texts.mapInArrow(run, "doc_id long, text_key long, start int, n int, gram_at int, bytes binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                   width: int = 1) -> DataFrame:
    """doc_id, text_key and spans (array of struct(start, stop, width), not
    merged): the letters covered by windows of ``depth`` letters that start more
    than once.  ``width`` 1: letters are bytes; WORD_BYTES: words."""
    gram, step = (GRAM, STEP) if width == 1 else (WORD_GRAM, WORD_STEP)
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    batch_limits(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    runs = scratch.write(find_runs(rows, depth, min(gram, depth), width), "runs")
    done, open_runs = _pass(runs, scratch, "gram", "gram_at")

    # The bytes of the open runs, read from their texts.
    wanted = open_runs.groupBy(*_ROW).agg(F.collect_list(F.struct("start", "n", "gram_at")).alias("runs"))
    wanted = wanted.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "runs")
    on = rows["doc_id"].eqNullSafe(wanted["own_id"]) & (rows["text_key"] == wanted["own_key"])
    if width == 1:
        data = rows.join(wanted, on).select(*_ROW, F.encode("text", "utf-8").alias("data"), F.explode("runs").alias("r")).select(
            *_ROW, "r.*", F.expr(f"substring(data, r.start + 1, r.n - 1 + {depth})").alias("bytes"))
    else:
        data = _word_runs(rows.join(wanted, on).select(*_ROW, "text", F.expr(
            f"transform(runs, r -> struct(r.start, r.n, r.gram_at, r.start + r.n - 1 + {depth} AS stop))").alias("runs")))
    open_bytes = scratch.write(data, "open")
    parts = scratch.write(split_runs(open_bytes, depth, step, width), "parts")
    done_parts, open_parts = _pass(parts, scratch, "core", "run")

    of = open_bytes.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"),
                           F.col("start").alias("of_start"), "bytes")
    on = (open_parts["doc_id"].eqNullSafe(of["of_id"]) & (open_parts["text_key"] == of["of_key"])
          & (open_parts["run"] == of["of_start"]))
    windows = scratch.write(single_suffixes(open_parts.join(of, on), depth, width), "windows")
    whole = ["whole_a", "whole_b"]
    again = windows.groupBy(*whole).agg(F.count("*").alias("same")).where("same > 1").select(*whole)
    done_windows = windows.join(again, whole).select(*_ROW, "start", F.lit(1).alias("n"))
    out = scratch.write(_spans(done.unionByName(done_parts).unionByName(done_windows), depth, width), "spans")
    scratch.drop("runs", "gram-again", "gram-classes", "open", "parts", "core-again", "core-classes", "windows")
    return out


def _all_spans(docs: DataFrame, id_col: str, text_col: str, depth: int, words: int | None) -> DataFrame:
    """Spans of ``depth`` bytes and, with ``words``, of so many words, in one row per text."""
    spans = repeated_spans(docs, id_col, text_col, depth)
    if words:
        spans = spans.unionByName(repeated_spans(docs, id_col, text_col, words, WORD_BYTES)).groupBy(*_ROW).agg(
            F.flatten(F.collect_list("spans")).alias("spans"))
    return spans


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _byte_ranges(data: bytes, spans) -> list[tuple[int, int]]:
    """Spans of bytes and of words as byte ranges."""
    out = [(s["start"], s["stop"]) for s in spans if s["width"] == 1]
    if len(out) < len(spans):
        words = [m.span() for m in _WORD.finditer(data)]
        out += [(words[s["start"]][0], words[s["stop"] - 1][1]) for s in spans if s["width"] > 1]
    return out


def _kept(batch, apart: bool = False):
    """(bytes of the text, merged spans, bytes kept, passages) for each row of a
    batch whose last columns are text and spans.  ``apart``: spans of words are
    not removed, but given as passages, merged."""
    for text, spans in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        gone = [s for s in spans or () if not apart or s["width"] == 1]
        merged = _merged(_byte_ranges(data, gone))
        passages = _merged(_byte_ranges(data, [s for s in spans or () if s["width"] > 1])) if apart else []
        at, kept = 0, []
        for start, stop in merged:
            kept.append(data[at:start])
            at = stop
        yield data, merged, b"".join([*kept, data[at:]]), passages


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                    words: int | None = None) -> DataFrame:
    """One row per text: doc_id, n_bytes, n_removed, n_spans (maximal removed
    ranges), kept_sha256 (of the bytes that stay).  With ``words``, n_passages
    and n_passage_bytes follow: the maximal ranges, and their bytes, covered by
    passages of so many words that occur more than once.  They are looked for in
    the texts as given and change nothing of what is removed."""
    rows = _rows(docs, id_col, text_col)
    spans = _all_spans(docs, id_col, text_col, depth, words)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["n_passages", "n_passage_bytes"] * bool(words)]

    def run(batches):
        for batch in batches:
            out = [(len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(),
                    len(passages), sum(stop - start for start, stop in passages))
                   for data, merged, kept, passages in _kept(batch, apart=True)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*out))][:len(names)], names)

    return rows.join(spans, _same_row(rows, spans), "left").select(rows["doc_id"], "text", "spans").mapInArrow(
        run, ", ".join(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in names))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                   words: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text, columns as they
    are.  Characters of which only some bytes are left are dropped with them.
    With ``words``, passages of so many words that occur more than once go too,
    however few bytes they have; both are looked for in the texts as given."""
    spans = _all_spans(docs, id_col, text_col, depth, words)
    key, cut_at = unused("text_key", docs), unused("spans", docs)
    keyed = docs.withColumn(key, F.xxhash64(whole_text(text_col)))
    spans = spans.select(F.col("doc_id").alias(unused("own_id", keyed)), F.col("text_key").alias(unused("own_key", keyed)),
                         F.col("spans").alias(cut_at))
    on = keyed[id_col].cast("long").eqNullSafe(spans[0]) & (keyed[key] == spans[1])
    joined = keyed.join(spans, on, "left")
    others = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in batches:
            kept = [data.decode("utf-8", "ignore") for _, _, data, _ in _kept(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(others)], pa.array(kept, pa.string())],
                                             [*others, text_col])

    clean = joined.where(F.col(cut_at).isNull()).select(*docs.columns)
    cut = joined.where(F.col(cut_at).isNotNull()).select(*others, text_col, cut_at)
    schema = docs.select(*others, text_col).schema
    return clean.unionByName(cut.mapInArrow(run, schema))
