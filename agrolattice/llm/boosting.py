"""Gradient-boosted trees for two classes, on a bounded sample: histogram splits, log loss."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """``trees`` regression trees of ``depth`` levels; ``score`` gives probabilities.

    Each tree is a complete binary tree in arrays: node i has children 2i + 1 (value at most
    the cut) and 2i + 2; the last level holds the leaf values.
    """

    def __init__(self, rows: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3,
                 bins: int = 32, min_rows: int = 4, ridge: float = 1.0):
        rows, y = np.asarray(rows, float), np.asarray(labels, float)
        self.depth, self.rate = depth, rate
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(share / (1 - share)))
        # cuts lie between values, so that scoring in another engine can't differ at a tie
        self.cuts = []
        for f in range(rows.shape[1]):
            v = np.unique(rows[:, f])
            mid = (v[1:] + v[:-1]) / 2
            self.cuts.append(mid if len(mid) <= bins else mid[np.linspace(0, len(mid) - 1, bins).astype(int)])
        binned = np.stack([np.searchsorted(c, rows[:, f]) for f, c in enumerate(self.cuts)], 1)
        raw = np.full(len(y), self.start)
        self.trees = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p)
            feature, cut = np.full(2 ** depth - 1, -1), np.zeros(2 ** depth - 1)
            at = np.zeros(len(y), np.int64)
            for node in range(2 ** depth - 1):
                here = at == node
                best = self._split(binned[here], grad[here], hess[here], min_rows, ridge)
                if best:
                    f, b = best
                    feature[node], cut[node] = f, self.cuts[f][b]
                    at[here] = 2 * node + 1 + (binned[here, f] > b)
                else:
                    at[here] = 2 * node + 1
            leaf = at - (2 ** depth - 1)
            g, h = np.bincount(leaf, grad, 2 ** depth), np.bincount(leaf, hess, 2 ** depth)
            value = rate * g / (h + ridge)
            self.trees.append((feature, cut, value))
            raw += value[leaf]

    def _split(self, binned, grad, hess, min_rows, ridge):
        if len(binned) < 2 * min_rows:
            return None
        total_g, total_h = grad.sum(), hess.sum()
        base, best, found = total_g ** 2 / (total_h + ridge), 1e-6, None
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            size = len(cuts) + 1
            g = np.cumsum(np.bincount(binned[:, f], grad, size))[:-1]
            h = np.cumsum(np.bincount(binned[:, f], hess, size))[:-1]
            n = np.cumsum(np.bincount(binned[:, f], minlength=size))[:-1]
            gain = g ** 2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - base
            gain[(n < min_rows) | (n > len(binned) - min_rows)] = 0
            b = int(np.argmax(gain))
            if gain[b] > best:
                best, found = gain[b], (f, b)
        return found

    def score(self, rows: np.ndarray) -> np.ndarray:
        rows = np.asarray(rows, float)
        raw = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for feature, cut, value in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (rows[every, np.maximum(f, 0)] > cut[at]))
            raw += value[at - (2 ** self.depth - 1)]
        return 1 / (1 + np.exp(-raw))

    def sql(self, features: list[str]) -> str:
        """The same score as a SQL expression over the features' expressions."""
        def node(tree, i):
            feature, cut, value = tree
            if i >= len(feature):
                return f"{float(value[i - len(feature)])!r}D"
            left, right = node(tree, 2 * i + 1), node(tree, 2 * i + 2)
            if feature[i] < 0 or left == right:
                return left
            return f"if({features[feature[i]]} <= {float(cut[i])!r}D, {left}, {right})"

        total = " + ".join([f"{self.start!r}D", *[f"{node(t, 0)}" for t in self.trees]])
        return f"(1D / (1D + exp(-({total}))))"


def calibrated_threshold(tally: list[tuple[int, int, int]], steps: int, precision: float) -> int:
    """The lowest of ``steps`` score steps from which on at least ``precision`` of the rows are
    positive; ``tally`` has (step, label, rows).  steps + 1 if there is none."""
    pos, neg = np.zeros(steps + 2), np.zeros(steps + 2)
    for step, label, n in tally:
        (pos if label else neg)[step] += n
    above_pos, above_neg = np.cumsum(pos[::-1])[::-1], np.cumsum(neg[::-1])[::-1]
    good = np.flatnonzero((above_pos > 0) & (above_pos >= precision * (above_pos + above_neg)))
    return int(good[0]) if len(good) else steps + 1
