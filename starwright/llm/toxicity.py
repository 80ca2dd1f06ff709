"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A text is cut into windows of WINDOW words (longer ones than WINDOW_BYTES, as in
text without white space, into overlapping windows of that length, so that the
dictionary stays in reach); each is compressed with either dictionary, and the
bytes that the toxic one saves are its evidence.  A logistic
curve turns the evidence of a document's windows into a calibrated score.  It is
fitted on all labelled documents of the sample, each part of them measured by
dictionaries made of the other parts; the dictionaries in use are made of all.

Training of the toxic dictionary: of all byte strings inside the words of toxic
documents, those are taken that are far more frequent there than in ordinary
ones (log-likelihood ratio; every string that a longer one explains is left
out).  Both dictionaries hold the same ordinary text, so that they differ by
these strings only; near copies among the training documents count once.  The
ordinary text is at most ORDINARY_BYTES: of as many ordinary documents of the
sample as fit, in the order of a hash of their text, TEXT_PIECES pieces of at
most PIECE_BYTES in whole words, one from each equal part of the text.

Training reads a bounded sample: at most MAX_TOXIC and MAX_ORDINARY labelled
documents of at most MAX_CHARS characters.  The toxic share is counted over all
labels, and the curve is fitted with class weights that restore it, so that
scores mean the same whether the bounds bind or not.  Scoring reads every whole
text.

Defined results: null and empty texts have no window and get the score of no
evidence, but a label of a null text is not learnt from; rows with a null id are
scored like any other and are neither learnt from nor marked held out
(``held_out`` is null in the query); without documents of both classes every score is the share of toxic
labels (0 without labels); several labels of one id count as the largest;
further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwright.llm.common import batch_limits, whole_text
from starwright.llm.labels import fit_logistic, labelled_sample

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 2000, 5000, 20_000
WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 8, 48_000, 4_000
TEXT_PIECES, PIECE_BYTES = 2, 200
WINDOW_BYTES = 4096
PARTS = 3  # of the sample: each is measured by dictionaries made of the others
STRING_LENGTHS, MIN_RATIO, MIN_EVIDENCE = range(4, 12), 25.0, 15.0
LEAST_SAVED = 2  # bytes; smaller savings are rounding
THRESHOLD = 0.3
# Both dictionaries end with these bytes and every window starts with them, so
# that a window is always stored compressed, never as it is.
_MARK = bytes([*range(1, 9), 11, 12, *range(14, 32), 127, 1, 2, 4])


@dataclass(frozen=True)
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()
    share: float = 0.0


def _words(text: str | None) -> list[bytes]:
    return [b" " + w for w in (text or "").lower().encode().split()]


def _windows(text: str | None) -> list[bytes]:
    words, shared = _words(text), max(STRING_LENGTHS)
    out = []
    for i in range(0, len(words), WINDOW):
        own = b"".join(words[i:i + WINDOW])
        out += [_MARK + own[k:k + WINDOW_BYTES] for k in range(0, max(len(own) - shared, 1), WINDOW_BYTES - shared)]
    return out


def _without_copies(texts: list[str]) -> list[str]:
    """Texts that share none of their smallest word-triple hashes with an
    earlier one."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = _words(text)
        low = sorted({xxhash.xxh3_64_intdigest(b"".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))})[:4]
        if not seen.intersection(low):
            out.append(text)
        seen.update(low)
    return out


def _strings(word: bytes) -> set[bytes]:
    return {word[i:i + n] for n in STRING_LENGTHS for i in range(len(word) - n + 1)}


def toxic_strings(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Byte strings that mark toxic text, the strongest first."""
    counts = []
    for texts in (toxic, ordinary):
        counts.append(Counter())
        for text in texts:
            counts[-1].update(set(_words(text)))
    here: Counter = Counter()
    for word, n in counts[0].items():
        for s in _strings(word):
            here[s] += n
    often = {s for s, n in here.items() if n >= 6}
    there: Counter = Counter()
    for word, n in counts[1].items():
        for s in often.intersection(_strings(word)):
            there[s] += n
    base = len(toxic) / (len(toxic) + len(ordinary))

    def evidence(s: bytes) -> float:
        a, b = here[s], there[s]
        share = a / (a + b)
        return a * np.log(share / base) + (b * np.log((1 - share) / (1 - base)) if b else 0.0)

    odds = len(ordinary) / len(toxic)
    strong = {s: e for s in often if here[s] * odds > MIN_RATIO * there[s] and (e := evidence(s)) > MIN_EVIDENCE}
    longer: Counter = Counter()
    for s in strong:
        for part in (s[1:], s[:-1]):
            longer[part] = max(longer[part], here[s])
    out: list[bytes] = []
    size = 0
    for s in sorted((s for s in strong if longer[s] < 0.7 * here[s]), key=lambda s: (-strong[s], s)):
        if size + len(s) <= TOXIC_BYTES and not any(s in t or t in s for t in out):
            out.append(s)
            size += len(s)
    return out


def ordinary_text(texts: list[str]) -> bytes:
    """Pieces of texts, chosen by hash, for both dictionaries."""
    out: list[bytes] = []
    size = 0
    for key, text in sorted((xxhash.xxh3_64_intdigest(t.encode()), t) for t in texts):
        data = b"".join(_words(text))
        part = len(data) // TEXT_PIECES
        if part <= PIECE_BYTES:
            pieces = [data[:TEXT_PIECES * PIECE_BYTES]]
        else:
            pieces = []
            for i in range(TEXT_PIECES):
                at = i * part + key % (part - PIECE_BYTES + 1)
                piece = data[at: at + PIECE_BYTES]
                first, last = piece.find(b" "), piece.rfind(b" ")
                pieces.append(piece[first:last] if first < last else piece)
        out += pieces
        size += sum(map(len, pieces))
        if size >= ORDINARY_BYTES:
            break
    return b"".join(out)[:ORDINARY_BYTES]


class Distance:
    """Bytes saved by the toxic dictionary, window by window."""

    def __init__(self, model: Model):
        self.pair = [self._compressor(d) for d in (model.ordinary, model.toxic)]

    @staticmethod
    def _compressor(content: bytes):
        # Matches are found by binary trees: the row tables that the plainer lazy
        # search takes for large dictionaries miss strings that stand there once.
        params = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=17, chain_log=17, search_log=6, min_match=4, target_length=64,
            strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=params)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Bytes saved against the length, largest saving, windows that save."""
        ordinary, toxic = (c.compress for c in self.pair)
        windows = _windows(text)
        saved = [s for w in windows if (s := len(ordinary(w)) - len(toxic(w))) >= LEAST_SAVED]
        if not saved:
            return 0.0, 0.0, 0.0
        return sum(saved) / len(windows) ** 0.5, float(max(saved)), np.log1p(len(saved))


def _dictionaries(sample: list[tuple[str, int]], share: float) -> Model | None:
    """Both dictionaries from (text, label) pairs; none without both classes."""
    toxic, ordinary = (_without_copies([t for t, y in sample if y == label]) for label in (1, 0))
    if not toxic or not ordinary:
        return None
    base = ordinary_text(ordinary)
    marks = b"".join(reversed(toxic_strings(toxic, ordinary)))
    # Bytes that occur in no text keep the distances to the ordinary part equal.
    filler = bytes(np.random.default_rng(1).integers(245, 256, len(marks)).astype(np.uint8))
    return Model(base + filler + _MARK, base + marks + _MARK, share=share)


def train(sample: list[tuple[str, int]], share: float | None = None) -> Model:
    """Model from (text, label) pairs.  The curve is fitted on every pair, each
    measured by dictionaries that are made without its part of the sample; the
    model's own dictionaries are made of all pairs.  ``share``: toxic documents
    among all labelled ones, if the sample holds them in another share."""
    if share is None:
        share = float(np.mean([y for _, y in sample])) if sample else 0.0
    x, y = [], []
    for part in range(PARTS):
        model = _dictionaries([s for i, s in enumerate(sample) if i % PARTS != part], share)
        if model is None:
            return Model(share=share)
        distance = Distance(model)
        for text, label in sample[part::PARTS]:
            x.append(distance.features(text))
            y.append(float(label))
    y = np.array(y)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    weights = fit_logistic(np.array(x), y, weight, ridge=1.0)
    return replace(_dictionaries(sample, share), weights=tuple(weights))


def fit(docs: DataFrame, labels: DataFrame, keep: Column) -> Model:
    share = labels.where(F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).agg(
        F.avg(F.col("toxic").cast("double")).alias("share")).first()["share"]
    sample = labelled_sample(docs, labels, "toxic", keep, {1: MAX_TOXIC, 0: MAX_ORDINARY}, MAX_CHARS)
    return train(sample, 0.0 if share is None else float(share))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries of bounded size

    def run(batches):
        own = shared.value
        weights = np.array(own.weights)
        distance = Distance(own) if own.weights else None
        for batch in batches:
            if distance is None:
                scores = np.full(batch.num_rows, own.share)
            else:
                x = np.array([distance.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
                scores = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    batch_limits(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(
        run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        own = shared.value
        weights = np.array(own.weights)
        distance = Distance(own) if own.weights else None
        for batch in batches:
            if distance is None:
                keep = np.full(batch.num_rows, own.share < threshold)
            else:
                x = np.array([distance.features(t) for t in batch.column(at).to_pylist()]).reshape(-1, 3)
                keep = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))) < threshold
            yield batch.filter(pa.array(keep))

    batch_limits(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
