"""Small boosted and bagged decision trees: fitted with numpy, applied as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A split (``low`` if the feature is at most ``at``) or, without a feature, a leaf."""

    value: float
    feature: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.at
        out = np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out

    def sql(self, names: list[str]) -> str:
        if self.feature < 0:
            return f"{self.value:.6f}D"
        return f"IF({names[self.feature]} <= {self.at:.9g}D, {self.low.sql(names)}, {self.high.sql(names)})"


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: int, features: int, rng: np.random.Generator) -> Tree:
    """A regression tree; a leaf holds sum(target) / sum(weight)."""
    value = float(target.sum() / max(weight.sum(), 1e-9))
    if depth == 0 or len(x) < 2 * least or np.ptp(target) == 0:
        return Tree(value)
    best = (1e-9, -1, 0.0)
    whole = target.sum() ** 2 / max(weight.sum(), 1e-9)
    for j in rng.permutation(x.shape[1])[:features]:
        order = np.argsort(x[:, j], kind="stable")
        v, t, w = x[order, j], np.cumsum(target[order]), np.cumsum(weight[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        cuts = cuts[(cuts >= least - 1) & (cuts < len(v) - least)]
        if not len(cuts):
            continue
        gain = t[cuts] ** 2 / np.maximum(w[cuts], 1e-9) + (t[-1] - t[cuts]) ** 2 / np.maximum(w[-1] - w[cuts], 1e-9) - whole
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(j), float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    if best[1] < 0:
        return Tree(value)
    low = x[:, best[1]] <= best[2]
    args = depth - 1, least, features, rng
    return Tree(value, best[1], best[2], grow(x[low], target[low], weight[low], *args), grow(x[~low], target[~low], weight[~low], *args))


@dataclass
class Ensemble:
    trees: list[Tree]
    base: float
    logistic: bool

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = self.base + sum(t.predict(x) for t in self.trees)
        return 1 / (1 + np.exp(-total)) if self.logistic else total

    def sql(self, names: list[str]) -> str:
        """The prediction as a SQL expression over numeric expressions ``names``."""
        total = " + ".join([f"{self.base:.6f}D", *(t.sql(names) for t in self.trees)])
        return f"(1 / (1 + exp(-({total}))))" if self.logistic else f"({total})"


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5, seed: int = 0) -> Ensemble:
    """Gradient boosting of the logistic loss with Newton leaves."""
    rng, p = np.random.default_rng(seed), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    out = Ensemble([], float(np.log(p / (1 - p))), True)
    raw = np.full(len(y), out.base)
    for _ in range(rounds):
        now = 1 / (1 + np.exp(-raw))
        tree = grow(x, y - now, np.maximum(now * (1 - now), 1e-6), depth, least, x.shape[1], rng)
        _scale(tree, rate)
        raw += tree.predict(x)
        out.trees.append(tree)
    return out


def _scale(tree: Tree, by: float) -> None:
    tree.value = float(np.clip(tree.value, -4, 4)) * by
    for t in (tree.low, tree.high):
        if t:
            _scale(t, by)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 7, least: int = 3, seed: int = 0) -> Ensemble:
    """A random forest: trees on bootstrap rows and random features, averaged."""
    rng, out = np.random.default_rng(seed), Ensemble([], 0.0, False)
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        tree = grow(x[rows], y[rows], np.ones(len(y)), depth, least, max(2, round(x.shape[1] ** 0.5)), rng)
        _mean(tree, trees)
        out.trees.append(tree)
    return out


def _mean(tree: Tree, n: int) -> None:
    tree.value /= n
    for t in (tree.low, tree.high):
        if t:
            _mean(t, n)


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold from which on ``score`` has this precision on labelled rows; over 1 if none has."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    good = np.flatnonzero(hit / np.arange(1, len(s) + 1) >= precision)
    good = good[(good == len(s) - 1) | (s[np.minimum(good + 1, len(s) - 1)] < s[good])]
    return float(s[good[-1]]) if len(good) else 2.0
