"""Logistic regression on sparse binary features, in numpy, for small fits on the driver."""

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sparse:
    """Rows of feature numbers: row ``i`` holds ``columns[begin[i]:begin[i + 1]]`` with ``values``."""

    def __init__(self, columns, begin, width, values=None):
        self.columns, self.begin, self.width = np.asarray(columns, np.int64), np.asarray(begin, np.int64), width
        self.values = np.ones(len(self.columns)) if values is None else np.asarray(values, float)
        self.row = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))

    def times(self, w):
        return np.bincount(self.row, self.values * w[self.columns], len(self.begin) - 1)

    def transposed(self, r):
        return np.bincount(self.columns, self.values * r[self.row], self.width)


def fit_logistic(x: Sparse, y, l2=1e-3, l1=0.0, steps=300, dense=None, weight=None):
    """``(weights, dense weights, intercept)`` of the penalised mean log-loss, by accelerated
    proximal gradient steps of a safe length. ``dense``: further columns, penalised alike."""
    y = np.asarray(y, float)
    n = max(1, len(y))
    weight = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    dense = np.zeros((len(y), 0)) if dense is None else dense
    w, v, b = np.zeros(x.width), np.zeros(dense.shape[1]), 0.0
    # No eigenvalue of the curvature exceeds a quarter of the largest weighted row-sum bound.
    square = np.bincount(x.row, x.values ** 2, len(y)) + (dense ** 2).sum(axis=1) + 1
    step = 4 / max(1e-9, float(weight @ square))
    past, t = (w, v, b), 1.0
    shrink = lambda a: np.sign(a) * np.maximum(np.abs(a) - step * l1, 0)
    at = past
    for _ in range(steps):
        r = weight * (sigmoid(x.times(at[0]) + dense @ at[1] + at[2]) - y)
        new = (shrink(at[0] - step * (x.transposed(r) + l2 * at[0])),
               shrink(at[1] - step * (dense.T @ r + l2 * at[1])), at[2] - step * r.sum())
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at = tuple(p + (before - 1) / t * (p - q) for p, q in zip(new, past))
        past = new
    return past
