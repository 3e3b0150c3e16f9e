"""Gradient-boosted trees on histograms, for a yes/no label.

Features become small bin numbers by quantile cuts; every level of a tree is
grown from sums of gradients by (node, feature, bin). All trees are then laid
end to end in plain arrays, and scoring walks all rows down a tree at once, one
level at a time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Settings(NamedTuple):
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    l2: float = 1.0
    least_hessian: float = 0.5  # that a leaf needs
    least_gain: float = 1e-3


class Trees(NamedTuple):
    """Nodes of all trees. A node's row goes to ``left`` if its value of
    ``feature`` is at most ``cut``, else to the node after that; a leaf goes to
    itself and has a ``value``."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[node]] > self.cut[node]
                node = self.left[node] + (right & ~self.leaf[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Trees:
    """Learn from rows ``x`` (float) and labels ``y`` (0 or 1). With no rows, or
    one label only, the result has no tree and scores the (smoothed) share."""
    rate = (float(y.sum()) + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    roots, feature, cut, left, leaf, value = [], [], [], [], [], []

    def done() -> Trees:
        return Trees(np.array(roots, np.int64), np.array(feature, np.int64), np.array(cut, np.float64),
                     np.array(left, np.int64), np.array(leaf, bool), np.array(value, np.float64), base, settings.depth)

    if not len(y) or y.min() == y.max():
        return done()
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, settings.bins + 1)[1:-1])) for c in x.T]
    n, f, b = len(x), x.shape[1], settings.bins
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    cells = binned + np.arange(f) * b
    score = np.full(n, base)

    def node_of(at: int, to_left: int = -1, k: int = 0, c: float = 0.0) -> None:
        feature[at], cut[at], left[at], leaf[at] = k, c, (to_left if to_left >= 0 else at), to_left < 0

    def new() -> int:
        for column, start in zip((feature, cut, left, leaf, value), (0, 0.0, len(left), True, 0.0)):
            column.append(start)
        return len(left) - 1

    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(new())
        here, open_nodes = np.full(n, roots[-1]), [roots[-1]]
        for _ in range(settings.depth):
            slot = np.full(len(left), -1)
            slot[open_nodes] = np.arange(len(open_nodes))
            live = np.flatnonzero(slot[here] >= 0)
            if not len(live):
                break
            where = (slot[here[live]][:, None] * (f * b) + cells[live]).ravel()
            size = len(open_nodes) * f * b
            sums = [np.bincount(where, np.repeat(v[live], f), size).reshape(-1, f, b) for v in (g, h)]
            gl, hl = (np.cumsum(s, axis=2) for s in sums)
            g_all, h_all = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + settings.l2) + (g_all - gl) ** 2 / (h_all - hl + settings.l2) - g_all ** 2 / (h_all + settings.l2)
            gain[np.minimum(hl, h_all - hl) < settings.least_hessian] = 0
            nxt = []
            for i, node in enumerate(open_nodes):
                k, c = np.unravel_index(np.argmax(gain[i]), (f, b))
                if gain[i, k, c] <= settings.least_gain or c >= len(cuts[k]):
                    continue
                a = new()
                new()
                node_of(node, a, int(k), float(cuts[k][c]))
                mine = live[here[live] == node]
                here[mine] = a + (binned[mine, k] > c)
                nxt += [a, a + 1]
            open_nodes = nxt
        g_sum, h_sum = (np.bincount(here, v, len(left)) for v in (g, h))
        for node in np.unique(here):
            value[node] = float(-settings.rate * g_sum[node] / (h_sum[node] + settings.l2))
        score = score + np.array(value)[here]
    return done()
