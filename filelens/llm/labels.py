"""What the learned operators share: folds, bounded samples of labelled rows, and a
logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label): at most ``rows`` labelled rows outside the held-out fold, the
    first by a hash of their id. Of repeated ids one row counts."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label) of a bounded sample, which is small enough to broadcast."""
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method with a ridge penalty.
    Without both classes the constant alone says which there is."""
    weights = np.zeros(x.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        weights[-1] = (4.0 if len(y) and y.max() else -4.0)
        return weights
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ weights)
        gradient = x.T @ (p - y) + ridge @ weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights
