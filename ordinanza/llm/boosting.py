"""Small gradient-boosted trees for log loss, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited regression trees on the gradient of the logistic loss; splits at feature quantiles."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, least: int = 10):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.forest: list = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, cuts, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.forest.append(tree)
            f += self._values(tree, x)
        return self

    def _grow(self, binned, cuts, g, h, rows, depth):
        gr, hr = g[rows], h[rows]
        sg, sh = gr.sum(), hr.sum()
        leaf = self.rate * sg / (sh + 1.0)
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            at = binned[j][rows]
            k = len(c) + 1
            lg, lh, n = (np.cumsum(np.bincount(at, w, k))[:-1] for w in (gr, hr, None))
            gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg * sg / (sh + 1)
            gain[(n < self.least) | (n > len(rows) - self.least)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], j, i)
        if best[1] is None:
            return leaf
        _, j, i = best
        m = binned[j][rows] <= i
        return (j, cuts[j][i], self._grow(binned, cuts, g, h, rows[m], depth - 1), self._grow(binned, cuts, g, h, rows[~m], depth - 1))

    def _values(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, c, a, b = tree
        m = x[:, j] <= c
        out = np.empty(len(x))
        out[m], out[~m] = self._values(a, x[m]), self._values(b, x[~m])
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        f = np.full(len(x), self.base)
        for t in self.forest:
            f += self._values(t, x)
        return 1 / (1 + np.exp(-f))
