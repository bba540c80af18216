"""Small gradient-boosted trees in numpy: log loss, binned features, complete trees of fixed depth."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class BoostedTrees:
    """Binary classifier; ``fit`` is deterministic, ``margin`` works on whole batches."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)])
        inner, leaves, b = 2**self.depth - 1, 2**self.depth, self.bins
        self.feature = np.zeros((self.trees, inner), dtype=np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, leaves))
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(n, self.bias)
        for t in range(self.trees):
            p = sigmoid(margin)
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, width_now = 2**level - 1, 2**level
                gain = np.full((width, width_now, b), -np.inf)
                for j in range(width):
                    key = (node - first) * b + binned[j]
                    gs = np.bincount(key, g, width_now * b).reshape(width_now, b).cumsum(1)
                    hs = np.bincount(key, h, width_now * b).reshape(width_now, b).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    score = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    score[:, len(cuts[j]) :] = -np.inf
                    gain[j] = np.where((hs > 1e-3) & (ht - hs > 1e-3), score, -np.inf)
                best = gain.transpose(1, 0, 2).reshape(width_now, -1)
                pick = best.argmax(1)
                for k in range(width_now):
                    if best[k, pick[k]] > 1e-6:
                        j, at = divmod(int(pick[k]), b)
                        self.feature[t, first + k], self.cut[t, first + k] = j, cuts[j][at]
                node = self.step(x, node, t)
            node -= inner
            self.leaf[t] = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            margin += self.leaf[t][node]
        return self

    def step(self, x: np.ndarray, node: np.ndarray, t: int) -> np.ndarray:
        return step(self.feature[t], self.cut[t], x, node)

    def arrays(self) -> dict:
        """The fitted trees as plain arrays, which any worker can unpickle."""
        return {"feature": self.feature, "cut": self.cut, "leaf": self.leaf, "bias": self.bias}


def step(feature: np.ndarray, cut: np.ndarray, x: np.ndarray, node: np.ndarray) -> np.ndarray:
    return 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])


def margin(trees: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of each row under the trees of ``arrays()``."""
    out = np.full(len(x), trees["bias"])
    inner = trees["feature"].shape[1]
    for feature, cut, leaf in zip(trees["feature"], trees["cut"], trees["leaf"]):
        node = np.zeros(len(x), dtype=np.int64)
        while node.size and node[0] < inner:  # trees are complete: all rows reach the leaves at once
            node = step(feature, cut, x, node)
        out += leaf[node - inner]
    return out


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the sigmoid that best maps margins to labels, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * margin).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        hess = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which the rows at or above it have the wanted precision; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)  # never between equal scores
    good = np.flatnonzero((right >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 2.0
