"""Gradient-boosted trees on histograms, for classifiers that are trained on a bounded number of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Boosted:
    """Complete binary trees: feature and threshold per inner node, a value per leaf."""

    prior: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        inner = self.features.shape[1]
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while inner and len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total = total + leaf[at - inner]
        return sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 8, ridge: float = 1.0) -> Boosted:
    """Fits by second-order steps on the logistic loss. With fewer than two labels present, only the prior is learnt."""
    n, m = x.shape if x.ndim == 2 else (0, 0)
    share = (float(y.sum()) + 0.5) / (n + 1.0)
    prior = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Boosted(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    total, all_features, all_thresholds, all_leaves = np.full(n, prior), [], [], []
    for _ in range(trees):
        p = sigmoid(total)
        grad, hess = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best, pick, cut = np.full(wide, 1e-6), np.full(wide, -1), np.zeros(wide, np.int64)
            for j in range(m):
                width = len(edges[j]) + 1
                key = (at - first) * width + binned[:, j]
                g, h, c = (np.bincount(key, weights=w, minlength=wide * width).reshape(wide, width).cumsum(axis=1) for w in (grad, hess, np.ones(n)))
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(c < least) | (c[:, -1:] - c < least)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(wide), top] > best
                best = np.where(better, gain[np.arange(wide), top], best)
                pick, cut = np.where(better, j, pick), np.where(better, top, cut)
            for k in range(wide):
                if pick[k] >= 0:
                    feature[first + k], threshold[first + k] = pick[k], edges[pick[k]][cut[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        g, h = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (grad, hess))
        values = rate * g / (h + ridge)
        total = total + values[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_leaves.append(values)
    return Boosted(prior, np.array(all_features), np.array(all_thresholds), np.array(all_leaves))


def threshold_for(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which this share of the selected held-out rows has label 1; above all scores if none."""
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.ones(len(y), dtype=bool)
    last[:-1] = scores[order][1:] != scores[order][:-1]
    good = np.flatnonzero((hit >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else 1.1
