"""A small classification tree (Gini impurity, axis-parallel splits), trained and applied without other libraries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class DecisionTree:
    """Inner nodes are (feature, border, left, right), leaves the share of label 1; ties go to the first feature and border."""

    def __init__(self, depth: int = 8, least: int = 1) -> None:
        self.depth, self.least, self.root = depth, least, None

    def fit(self, rows: Sequence[Sequence[float]], labels: Sequence[int]) -> DecisionTree:
        self.root = self._grow(np.asarray(rows, float), np.asarray(labels, float), self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        n, share = len(y), float(y.mean())
        if depth == 0 or share in (0.0, 1.0):
            return share
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            left = np.flatnonzero(v[1:] > v[:-1]) + 1
            left = left[(left >= self.least) & (n - left >= self.least)]
            if not len(left):
                continue
            a, b = ones[left - 1], ones[-1] - ones[left - 1]
            impurity = a * (1 - a / left) + b * (1 - b / (n - left))
            k = int(impurity.argmin())
            if best is None or impurity[k] < best[0] - 1e-9:
                best = float(impurity[k]), f, float((v[left[k] - 1] + v[left[k]]) / 2)
        if best is None or best[0] >= n * share * (1 - share) - 1e-9:
            return share
        _, f, at = best
        right = x[:, f] > at
        return f, at, self._grow(x[~right], y[~right], depth - 1), self._grow(x[right], y[right], depth - 1)

    def score(self, row: Sequence[float]) -> float:
        node = self.root
        while isinstance(node, tuple):
            f, at, left, right = node
            node = right if row[f] > at else left
        return node

    def used(self) -> set[int]:
        """The features that the tree splits by."""
        out, waiting = set(), [self.root]
        while waiting:
            node = waiting.pop()
            if isinstance(node, tuple):
                out.add(node[0])
                waiting += node[2:]
        return out
