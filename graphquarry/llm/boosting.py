"""Gradient-boosted trees for a few classes: histograms over binned columns, second-order gains, a softmax over classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Full binary trees, flat: columns and bounds of inner nodes, values of leaves; tree k is for class k % classes."""

    column: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    start: np.ndarray
    depth: int

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """One row of log probabilities of the classes for each row of x."""
        out = np.tile(self.start, (len(x), 1))
        rows = np.arange(len(x))
        for k in range(len(self.column)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.column[k][at]] > self.bound[k][at])
            out[:, k % len(self.start)] += self.value[k][at - (2**self.depth - 1)]
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, part: float = 0.35, l2: float = 2.0, seed: int = 0) -> Trees:
    """Rounds of one tree for each class, each on a random part of the rows. Columns are cut at quantiles."""
    rng = np.random.default_rng(seed)
    n, columns = x.shape
    cuts = []
    for c in range(columns):
        values = np.unique(x[:, c])
        cuts.append((values[:-1] + values[1:]) / 2 if len(values) <= bins else np.unique(np.quantile(x[:, c], np.arange(1, bins) / bins)).astype(np.float32))
    code = np.stack([np.searchsorted(cut, x[:, c], "left") for c, cut in enumerate(cuts)], axis=1).astype(np.int32) if n else np.zeros((0, columns), np.int32)
    two = np.array([len(cut) <= 1 for cut in cuts], bool)  # columns of two values are summed by node, not by bin
    many, pairs = np.flatnonzero(~two), np.flatnonzero(two)
    flat = code[:, many] + np.arange(len(many)) * bins
    ones = code[:, pairs].astype(np.float32)
    share = np.maximum(np.bincount(y, weight, classes), 1e-3)
    start = np.log(share / share.sum())
    score = np.tile(start, (n, 1))
    all_columns, all_bounds, all_values = [], [], []
    for _ in range(rounds):
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        use = np.flatnonzero(rng.random(n) < part)
        for k in range(classes):
            g = (p[:, k] - (y == k)) * weight
            h = np.maximum(p[:, k] * (1 - p[:, k]), 1e-6) * weight
            column, bound = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf, np.float32)
            cut_code = np.full(2**depth - 1, bins, np.int64)
            at = np.zeros(len(use), np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                key = ((at - first)[:, None] * (len(many) * bins) + flat[use]).ravel()
                gs, hs = np.zeros((2, width, columns, bins))
                by = np.argsort(at, kind="stable")
                nodes, begins = np.unique(at[by], return_index=True)
                sorted_ones = ones[use[by]]
                for v, into in ((g[use], gs), (h[use], hs)):
                    into[:, many] = np.bincount(key, np.repeat(v, len(many)), width * len(many) * bins).reshape(width, len(many), bins)
                    set_, every = (np.add.reduceat(x, begins, axis=0) for x in (sorted_ones * v[by, None], v[by]))
                    into[(nodes - first)[:, None], pairs, 1] = set_
                    into[(nodes - first)[:, None], pairs, 0] = every[:, None] - set_
                gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
                ga, ha = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(hl < 1.0) | (ha - hl < 1.0)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                for node in np.flatnonzero(gain.reshape(width, -1)[np.arange(width), best] > 1e-3):
                    c, b = divmod(int(best[node]), bins)
                    if b < len(cuts[c]):
                        column[first + node], bound[first + node], cut_code[first + node] = c, cuts[c][b], b
                at = 2 * at + 1 + (code[use, column[at]] > cut_code[at])
            leaf = at - (2**depth - 1)
            value = -rate * np.bincount(leaf, g[use], 2**depth) / (np.bincount(leaf, h[use], 2**depth) + l2)
            every = np.zeros(n, np.int64)
            for _ in range(depth):
                every = 2 * every + 1 + (code[np.arange(n), column[every]] > cut_code[every])
            score[:, k] += value[every - (2**depth - 1)]
            all_columns.append(column)
            all_bounds.append(bound)
            all_values.append(value)
    return Trees(np.array(all_columns), np.array(all_bounds), np.array(all_values), start, depth)
