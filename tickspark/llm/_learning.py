"""What the two classifiers share: the labelled rows that they may learn from, and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model learns from at most so many labelled documents, taken by a hash of the id; more labels change nothing.
LABELLED_ROWS = 20_000


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Rows that no model learns from; a row without an id is one."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(True))


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int = LABELLED_ROWS) -> DataFrame:
    """Rows (text, y) of the bounded sample, ``rows`` at most. The ids and labels are few by that bound, so they go to the documents; of documents that share an id one is learned from, the one of least hash."""
    own = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "__id")
    known = docs.sparkSession.createDataFrame([tuple(r) for r in sample.collect()], sample.schema)
    own = docs.join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("__id", F.col("text").cast("string").alias("text"), "y")
    return own.groupBy("__id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y")).drop("__id")


def logistic(x: np.ndarray, y: np.ndarray, l2: float, weight: np.ndarray | None = None, intercept: bool = True, rounds: int = 40) -> np.ndarray:
    """Newton's method for logistic loss on soft labels ``y``; the last coefficient is the intercept, which isn't shrunk."""
    n = len(x)
    a = np.hstack([x, np.ones((n, 1))]) if intercept else x
    shrink = np.full(a.shape[1], l2)
    if intercept:
        shrink[-1] = 1e-6
    weight = np.ones(n) if weight is None else weight
    w = np.zeros(a.shape[1])

    def loss(w):
        z = a @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (shrink * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        gradient = a.T @ (weight * (p - y)) + shrink * w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(shrink + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        was, now = now, loss(w)
        if was - now < 1e-9 * max(1.0, abs(was)):
            break
    return w
