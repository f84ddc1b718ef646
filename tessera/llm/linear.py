"""Regularised logistic regression on sparse hashed features, by full-batch Adam in numpy."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of binary hashed features: `index` holds the features of all rows, `row` the row of each."""

    def __init__(self, index: np.ndarray, row: np.ndarray, rows: int):
        self.index, self.row, self.rows = index.astype(np.int64), row.astype(np.int64), rows
        count = np.bincount(self.row, minlength=rows)
        self.scale = 1.0 / np.sqrt(np.maximum(count, 1))

    def take(self, which: np.ndarray) -> Sparse:
        number = np.full(self.rows, -1)
        number[which] = np.arange(len(which))
        keep = number[self.row] >= 0
        return Sparse(self.index[keep], number[self.row[keep]], len(which))

    def score(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.index], minlength=self.rows) * self.scale + bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(
    x: Sparse, y: np.ndarray, size: int, weight: np.ndarray | None = None, l2: float = 1e-4, rounds: int = 80, step: float = 0.3
) -> tuple[np.ndarray, float]:
    """Weights and bias; `weight` weighs the rows, `l2` penalises the weights."""
    weight = np.ones(x.rows) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-9)
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        error = (sigmoid(x.score(w, b)) - y) * weight
        grad = np.bincount(x.index, weights=(error * x.scale)[x.row], minlength=size) + l2 * w / max(x.rows, 1)
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= step * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= step * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b
