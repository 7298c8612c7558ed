"""Gradient-boosted trees with a logistic loss, small enough to become a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (feature, threshold, left, right) or (value,)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float = 4.0, l2: float = 1.0) -> Tree:
    """A regression tree by second-order gain; left takes values <= threshold."""
    total_g, total_h = g.sum(), h.sum()
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            gain = cg**2 / (ch + l2) + (total_g - cg) ** 2 / (total_h - ch + l2) - total_g**2 / (total_h + l2)
            count = np.arange(1, len(v))
            gain[(v[1:] == v[:-1]) | (count < least) | (len(v) - count < least)] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return (float(-total_g / (total_h + l2)),)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def run_tree(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, at, left, right = tree
    return np.where(x[:, f] <= at, run_tree(left, x), run_tree(right, x))


class Boosted:
    """Trees, and the two numbers that turn their sum into a calibrated probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3):
        held = np.arange(len(y)) % 4 == 3  # for calibration
        fx, fy = x[~held], y[~held]
        self.rate, self.trees = rate, []
        score = np.zeros(len(fy))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = _grow(fx, p - fy, p * (1 - p), depth)
            self.trees.append(tree)
            score += rate * run_tree(tree, fx)
        self.slope, self.offset = self._calibrate(self.raw(x[held]), y[held])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum(run_tree(t, x) for t in self.trees)

    @staticmethod
    def _calibrate(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Platt scaling by Newton steps, with the usual softened targets."""
        pos, neg = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w, d = p * (1 - p) + 1e-9, p - t
            hess = np.array([[(w * s * s).sum() + 1e-6, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, np.array([(d * s).sum(), d.sum()]))
            a, b = a - step[0], b - step[1]
        return float(a), float(b)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.offset)))

    def column(self, features: list[Column]) -> Column:
        """The calibrated probability as a column expression over the feature columns."""

        def branch(t: Tree) -> Column:
            return F.lit(t[0]) if len(t) == 1 else F.when(features[t[0]] <= t[1], branch(t[2])).otherwise(branch(t[3]))

        total = branch(self.trees[0])
        for t in self.trees[1:]:
            total = total + branch(t)
        return 1 / (1 + F.exp(-(total * (self.rate * self.slope) + self.offset)))
