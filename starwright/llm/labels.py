"""Bounded samples of labelled documents and small logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int],
                    max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class[c]`` documents of each class c, of
    at most ``max_chars`` characters each, chosen by a hash of the id.  This
    bound is all the driver ever holds.  ``keep`` is a condition on doc_id."""
    labels = labels.where(F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = None
    for value, n in per_class.items():
        own = labels.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = own if ids is None else ids.unionByName(own)
    # At most sum(per_class) rows: small enough to broadcast.
    rows = (docs.where(F.length("text") <= max_chars).select("doc_id", "text")
            .join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("label").cast("int")).collect())
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1]))]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2,
                 rounds: int = 50) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression, by
    Newton's method on standardised columns."""
    if weight is None:
        weight = np.ones(len(y))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, keep = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + keep * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(keep + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = w[:-1] / scale
    return np.append(out, w[-1] - (out * mean).sum())
