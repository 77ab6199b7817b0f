"""Small linear models on bounded samples, and the deterministic samples themselves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id is fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def chance(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised squared-hinge machine; ``y`` is +1 or -1. Classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    # The largest eigenvalue of the weighted Gram matrix bounds the step of accelerated descent.
    v = np.ones(x1.shape[1], dtype=x1.dtype)
    for _ in range(10):
        v = x1.T @ (weight * (x1 @ v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (2 * top + penalty)
    w = z = np.zeros(x1.shape[1], dtype=x1.dtype)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ z))
        new = z - step * (penalty * z - 2 * (x1.T @ (weight * y * slack)))
        z = new + (i / (i + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model by Newton's steps; ``x`` has few columns, one of them constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + (penalty + 1e-9) * np.eye(x.shape[1])
        move = np.linalg.solve(hessian, gradient)
        w -= move / max(1.0, np.abs(move).max() / 2)
        if np.abs(move).max() < 1e-6:
            break
    return w
