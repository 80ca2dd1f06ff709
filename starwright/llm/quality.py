"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text.  Weights are
learnt from preference pairs: a document labelled 1 is preferred to one labelled
0, and the logistic loss is taken on the difference of the two feature vectors,
so that no constant is needed.  The cut lies at a quantile of the strengths of
the labelled documents (the share of documents labelled 0), and strengths become
scores by a logistic curve that meets THRESHOLD at the cut.

Training reads every labelled document, however long.  All pairs of a document
labelled 1 and one labelled 0 count alike: the loss is summed over strengths
grouped to steps of STEP, so that its cost grows with the documents and not with
their pairs.  The features are measured once and written; each round of Newton's
method adds up vectors over them where they lie, and the driver gets the sums.
The cut is the exact quantile of all strengths.

Defined results: null texts count as empty, but a label of a null text is not
learnt from; rows with a null id are scored like any other and are neither learnt
from nor marked held out (``held_out`` is null in the query); without documents of both classes
every score is the share of documents labelled 1 (0.5 without labels); several
labels of one id count as the largest; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwright.llm.common import Scratch, batch_limits, whole_text
from starwright.llm.labels import fit_logistic

THRESHOLD = 0.3
RIDGE, PAIRS = 3.0, 30_000  # the ridge weighs this much beside this many pairs
ROUNDS, MAX_STEP, SMALL_STEP = 50, 4.0, 1e-4
STEP = 1 / 8  # strengths that close count as their mean against the other class
FINE, PARTS, FINEST = 1 / 64, 1024, 1e-10  # steps of the search for the cut
_VALUES = 1024  # of a vector that are summed in one place
# Texts are compressed in blocks of this size, so that memory is bounded and the
# ratio does not depend on how far apart two passages are.
_BLOCK = 1 << 15
_MARKS = "!?#*$%&|@=/\\<>{}[]()\"':;,.-_"
_REPEATED_MARK = re.compile(r"([^\w\s])\1")
_LIST_MARK = re.compile(r"^\s*[-*•\d]", re.M)


def features(text: str | None) -> list[float]:
    """Shape of a text: characters, words, lines, repetition, compressibility."""
    text = text or ""
    n = max(len(text), 1)
    words = text.split()
    m = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    data = text.encode()
    small = sum(len(zlib.compress(data[i:i + _BLOCK], 1)) for i in range(0, len(data), _BLOCK))
    seen = Counter(words)
    common = seen.most_common(3)
    lengths = np.array([len(w) for w in words]) if words else np.zeros(1)
    line_lengths = np.array([len(x) for x in lines]) if lines else np.zeros(1)
    low = text.lower()
    upper = sum(map(str.isupper, words)) / m
    pairs = Counter(zip(words, words[1:]))
    same = sum(a == b for a, b in zip(words, words[1:])) / m
    marks = [text.count(c) / n for c in _MARKS]
    distinct_lines = len(set(lines)) / k
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(seen) / m, len(seen) / m ** 0.8,
        (common[0][1] if common else 0) / m, sum(c for _, c in common) / m, len(pairs) / m, same, upper,
        sum(1 for a, b in zip(text, low) if a != b) / n, lengths.mean(), lengths.std(), float(lengths.max()) ** 0.5,
        (lengths <= 3).mean(), (lengths > 15).mean(), sum(map(text.count, "0123456789")) / n,
        text.count(" ") / n, text.count("\n") / n, line_lengths.mean() ** 0.5, line_lengths.std() ** 0.5,
        distinct_lines, float(len(lines) - len(set(lines)) > 0), small / max(len(data), 1), small / max(len(data), 1) ** 0.9,
        sum(w[-1] in ".!?" for w in words) / m, sum(not w[-1].isalnum() for w in words) / m,
        sum(w.isalpha() for w in words) / m, sum(not any(map(str.isalnum, w)) for w in words) / m,
        len(_REPEATED_MARK.findall(text)) / m, len(_LIST_MARK.findall(text)) / k, *marks,
        *(min(1.0, 50 * x) for x in marks)]


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...] = ()
    cut: float = 0.0
    slope: float = 1.0
    share: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.share)
        margin = self.slope * (x @ np.array(self.weights) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


# Sums over all labelled documents: takes a function of a part's features and
# labels that returns vectors by key, and returns the sum of each key's vectors.
Totals = Callable[[Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]]], dict[int, np.ndarray]]


def _moments(x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
    return {label: np.concatenate([[len(own)], own.sum(0), (own * own).sum(0)])
            for label in (0, 1) if len(own := x[y == label])}


def _grouped(s: np.ndarray, y: np.ndarray, values: np.ndarray, width: float) -> dict[int, np.ndarray]:
    """Sums of the values by class and step of the strength; the key is twice
    the step's number, and 1 more in class 1."""
    keys, at = np.unique(2 * np.floor(s / width).astype(np.int64) + y, return_inverse=True)
    sums = np.zeros((len(keys), values.shape[1]))
    np.add.at(sums, at, values)
    return dict(zip(keys.tolist(), sums))


def _weights(total: Totals, pairs: int) -> np.ndarray | None:
    """Bradley-Terry: P(better is preferred) = 1 / (1 + exp(-w (x_better - x_worse))),
    over all pairs of documents of different classes."""
    moments = total(_moments)
    if len(moments) < 2:
        return None
    n = {label: m[0] for label, m in moments.items()}
    mean, square = ({label: m[1:].reshape(2, -1)[i] / m[0] for label, m in moments.items()} for i in (0, 1))
    centre = (n[0] * mean[0] + n[1] * mean[1]) / (n[0] + n[1])
    variance = sum(np.maximum(square[label] - mean[label] ** 2, 0) for label in (0, 1))
    scale = np.sqrt(variance + (mean[1] - mean[0]) ** 2) + 1e-9  # of the pairs' differences
    w, ridge = np.zeros(len(scale)), RIDGE / pairs

    def steps(x, y):
        z = (x - centre) / scale
        return _grouped(z @ w, y, np.column_stack([np.ones(len(z)), z]), STEP)

    for _ in range(ROUNDS):
        groups = total(steps)
        keys = {label: [k for k in sorted(groups) if k % 2 == label] for label in (0, 1)}
        sums = {label: np.array([groups[k] for k in keys[label]]) for label in (0, 1)}
        at = {label: sums[label][:, 1:] @ w / sums[label][:, 0] for label in (0, 1)}
        p = 1 / (1 + np.exp(np.clip(at[1][:, None] - at[0], -30, 30)))
        curve = p * (1 - p) / (n[0] * n[1])
        bend = {1: curve @ sums[0][:, 0], 0: sums[1][:, 0] @ curve}

        def pulls(x, y, w=w, keys=keys, sums=sums, at=at, bend=bend):
            z = (x - centre) / scale
            s, grad, hess = z @ w, np.zeros(len(w)), np.zeros((len(w), len(w)))
            number = 2 * np.floor(s / STEP).astype(np.int64) + y
            for label, sign in ((1, -1.0), (0, 1.0)):
                other = 1 - label
                rows = max(1, 2_000_000 // len(at[other]))
                own = np.flatnonzero(y == label)
                for some in (own[i:i + rows] for i in range(0, len(own), rows)):
                    beaten = 1 / (1 + np.exp(np.clip(sign * (at[other] - s[some, None]), -30, 30)))
                    grad += sign * (beaten @ sums[other][:, 0] / (n[0] * n[1])) @ z[some]
                    place = np.minimum(np.searchsorted(keys[label], number[some]), len(keys[label]) - 1)
                    hess += (z[some] * bend[label][place][:, None]).T @ z[some]
            return {0: np.concatenate([grad, hess.ravel()])}

        sum_ = total(pulls)[0]
        cross = sums[1][:, 1:].T @ curve @ sums[0][:, 1:]
        hess = sum_[len(w):].reshape(len(w), -1) - cross - cross.T + np.diag(np.full(len(w), ridge))
        step = np.linalg.solve(hess, sum_[:len(w)] + ridge * w)
        step *= min(1.0, MAX_STEP / np.sqrt(step @ step + 1e-30))
        w = w - step
        if np.abs(step).max() < SMALL_STEP:
            break
    return w / scale


def _cut_and_slope(total: Totals, weights: np.ndarray, share: float) -> tuple[float, float]:
    """Cut between the quantile of the strengths and the next strength, and the
    slope of the logistic curve."""
    inside: list[tuple[float, float, int]] = []  # steps that hold the quantile, each within the one before

    def steps(x, y, inside=inside, last=(0.0, FINE)):
        s = x @ weights
        for lo, width, k in inside:
            keep = np.floor((s - lo) / width) == k
            s, y = s[keep], y[keep]
        return _grouped(s - last[0], y, np.column_stack([np.ones(len(s)), s]), last[1])

    groups = total(steps)
    n = [sum(v[0] for k, v in groups.items() if k % 2 == label) for label in (0, 1)]
    # The labels may hold the classes in other shares than the documents do.
    each = [(1 - share) / n[0], share / n[1]]
    keys = sorted(groups)
    slope = float(fit_logistic(np.array([[groups[k][1] / groups[k][0]] for k in keys]), np.array([k % 2.0 for k in keys]),
                               np.array([groups[k][0] * each[k % 2] * sum(n) for k in keys]))[0])
    lo, width, below, edge, value = 0.0, FINE, 0.0, None, 0.0
    while groups:
        numbers = sorted({k // 2 for k in groups})
        rows = np.array([[sum(groups[2 * b + c][i] * f for c, f in enumerate(by) if 2 * b + c in groups)
                          for i, by in ((0, (1, 1)), (0, each), (1, (1, 1)))] for b in numbers])
        reached = below + np.cumsum(rows[:, 1])
        at = min(int(np.searchsorted(reached, 1 - share - 1e-9)), len(numbers) - 1)
        count, own, value = rows[at, 0], rows[at, 1], rows[at, 2] / rows[at, 0]
        below = reached[at] - own
        if at + 1 < len(numbers):
            edge = lo + numbers[at + 1] * width  # not above the next strength
        if count == 1 or width < FINEST:
            if edge is not None and below + own * (count - 1) / count < 1 - share - 1e-9:
                value = (value + edge) / 2
            break
        inside = [*inside, (lo, width, numbers[at])]
        lo, width = lo + numbers[at] * width, width / PARTS
        groups = total(lambda x, y, inside=inside, last=(lo, width): steps(x, y, inside, last))
    return float(value), max(slope, 1e-6)


def _learn(total: Totals, share: float, pairs: int = PAIRS) -> Model:
    weights = _weights(total, pairs)
    if weights is None:
        return Model(share=share)
    return Model(tuple(weights), *_cut_and_slope(total, weights, share), share)


def train(sample: list[tuple[str, int]], share: float, pairs: int = PAIRS) -> Model:
    """Model from (text, label) pairs; ``share``: documents labelled 1 among all
    labelled ones; ``pairs``: the number that the ridge is weighed against."""
    x, y = np.array([features(t) for t, _ in sample]), np.array([label for _, label in sample], int)
    return _learn(lambda part: part(x, y), share, pairs)


def measure(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, label and features (x: packed doubles) of every text, written to
    the shared folder.  The label is null where it is not learnt from.  ``keep``
    is a condition on doc_id."""

    def run(batches):
        for batch in batches:
            x = [np.array(features(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.binary())], ["doc_id", "taught", "x"])

    batch_limits(docs.sparkSession)
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).isNotNull().alias("taught"),
                           whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, taught boolean, x binary")
    known = labels.where(F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("label")).where("label IN (0, 1)").select(
        F.col("doc_id").cast("long").alias("key"), F.lit(True).alias("has_id"), "label")
    # Rows without an id meet no label; they are dealt out by their features.
    keyed = measured.select("*", F.coalesce("doc_id", F.xxhash64("x")).alias("key"),
                            F.col("doc_id").isNotNull().alias("has_id"))
    joined = keyed.join(known, ["key", "has_id"], "left").select(
        "doc_id", F.when(F.col("taught"), F.col("label")).alias("label"), "x")
    return Scratch(docs.sparkSession, "quality").write(joined, "features")


def _features_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(at).to_pylist())).reshape(batch.num_rows, -1)


def _totals(measured: DataFrame) -> Totals:
    """Sums over the labelled rows of a measured table."""
    table = measured.where("label IS NOT NULL").select("label", "x")

    def total(part):
        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows:
                    y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    for key, vector in part(_features_of(batch, 1), y).items():
                        sums[key] = sums[key] + vector if key in sums else vector
            rows = [(key, i, v[i:i + _VALUES].tobytes()) for key, v in sums.items() for i in range(0, len(v), _VALUES)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "at", "v"])

        def add(group: pa.Table) -> pa.Table:
            v = sum(np.frombuffer(b) for b in group.column("v").to_pylist())
            return pa.table({"key": group.column("key")[:1], "at": group.column("at")[:1],
                             "v": pa.array([v.tobytes()], pa.binary())})

        kinds, schema = (pa.int64(), pa.int32(), pa.binary()), "key long, at int, v binary"
        rows = table.mapInArrow(run, schema).groupBy("key", "at").applyInArrow(add, schema).collect()
        out: dict[int, list[np.ndarray]] = {}
        for key, _, v in sorted((r["key"], r["at"], bytes(r["v"])) for r in rows):
            out.setdefault(key, []).append(np.frombuffer(v))
        return {key: np.concatenate(parts) for key, parts in out.items()}

    return total


def fit_measured(measured: DataFrame, labels: DataFrame, keep: Column) -> Model:
    """Model from all labelled rows of a measured table."""
    counts = labels.where(keep & F.col("doc_id").isNotNull()).agg(
        F.avg(F.col("quality").cast("double")).alias("share")).first()
    return _learn(_totals(measured), 0.5 if counts["share"] is None else float(counts["share"]))


def fit(docs: DataFrame, labels: DataFrame, keep: Column) -> Model:
    return fit_measured(measure(docs, labels, keep), labels, keep)


def score_measured(measured: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of a measured table."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(model.scores(_features_of(batch, 1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    return measured.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every text."""

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    batch_limits(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(
        run, "doc_id long, score double")
