"""Logistic models over numpy arrays, and the bounded labelled samples that they are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def bounded_labels(labels: DataFrame, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most `bound` labelled ids, chosen by a hash of the id, so that every part of the table may appear."""
    known = labels.where(F.col(id_col).isNotNull())
    total = known.count()
    if total > bound:
        space = 1 << 30
        share = min(1.0, 1.1 * bound / total)
        known = known.where(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(space)) < int(share * space))
    return known.orderBy(F.xxhash64(id_col, F.lit(11)), id_col).limit(bound)


class Sparse:
    """Rows of distinct feature places with value 1, flat, and dense columns beside them."""

    def __init__(self, rows: list[np.ndarray], n_features: int, dense: np.ndarray):
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.n_features, self.dense = len(rows), n_features, dense

    def dot(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n) + self.dense @ v

    def back(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.at, r[self.row], self.n_features), self.dense.T @ r


def fit_sparse(x: Sparse, y: np.ndarray, use: np.ndarray, l1: float = 2e-4, rounds: int = 250) -> tuple[np.ndarray, np.ndarray, float]:
    """An L1 logistic model by accelerated proximal steps over the rows of `use`: weights, dense weights, bias."""
    n = max(1, int(use.sum()))
    sizes = np.bincount(x.row, minlength=x.n)
    step = 4.0 / (float(np.quantile(sizes[use], 0.9)) / 16 + (x.dense**2).sum(1).max(initial=0) + 1.0) if n else 1.0
    w, v, b = np.zeros(x.n_features), np.zeros(x.dense.shape[1]), 0.0
    wy, vy, by, t = w, v, b, 1.0
    for _ in range(rounds):
        r = np.where(use, sigmoid(x.dot(wy, vy) + by) - y, 0.0) / n
        gw, gv = x.back(r)
        new_w = wy - step * gw
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0.0)
        new_v, new_b = vy - step * gv, by - step * r.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / new_t
        wy, vy, by = new_w + k * (new_w - w), new_v + k * (new_v - v), new_b + k * (new_b - b)
        w, v, b, t = new_w, new_v, new_b, new_t
    return w, v, b


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A ridge logistic model by Newton steps: weights, bias."""
    n, k = x.shape
    if not n:
        return np.zeros(k), 0.0
    design = np.hstack([x, np.ones((n, 1))])
    theta, penalty = np.zeros(k + 1), np.full(k + 1, l2 * n)
    penalty[-1] = 1e-9 * n
    for _ in range(rounds):
        p = sigmoid(design @ theta)
        gradient = design.T @ (p - y) + penalty * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        move = np.linalg.solve(hessian, gradient)
        theta -= move * min(1.0, 5.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return theta[:-1], float(theta[-1])
