"""Labelled rows for training: the fold rule, all or a bounded sample, and logistic fits in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out():
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def training(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (0 or 1) of all training rows. Missing labels and ids are left out; rows labelled twice count twice."""
    return labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out())


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `most` training rows of each label, those of least hash.

    The sample of ids is bounded by 2 * most, so broadcasting it is safe. Missing labels and ids are
    left out; rows labelled twice count twice.
    """
    rows = training(labels, label)
    parts = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(parts[0].union(parts[1])), "doc_id")


def shares(labels: DataFrame, label: str) -> dict[int, int]:
    """How many training rows have each label."""
    rows = training(labels, label)
    return {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, intercept: bool = True, steps: int = 60) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last coefficient is the intercept (0 without one)."""
    a = np.column_stack([x, np.full(len(x), float(intercept))])
    w = np.ones(len(x)) if weight is None else weight
    w = w / max(w.sum(), 1e-12)
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (p - y)) + penalty * beta
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        beta -= step
        if np.abs(step).max() < 1e-7:
            break
    return beta
