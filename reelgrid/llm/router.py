"""Balanced partitions of a neighbour graph, and a classifier that says in which a vector's neighbours lie."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEIGHBOURS = 10
HIDDEN, EPOCHS, BATCH, RATE = 128, 40, 256, 3e-3


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest others of each row (all others, if fewer)."""
    k = min(k, len(x) - 1)
    norms, out = (x * x).sum(axis=1), np.zeros((len(x), k), np.int64)
    for s in range(0, len(x) if k else 0, 512):
        near = norms[None, :] - 2 * (x[s : s + 512] @ x.T)
        near[np.arange(len(near)), np.arange(s, s + len(near))] = np.inf
        out[s : s + 512] = np.argpartition(near, k - 1, axis=1)[:, :k]
    return out


def _halves(n: int, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which half each of n nodes goes to: of equal size, with few of the edges a-b (each both ways) between them.

    The nodes are ranked by a slow mode of the graph's random walk and cut in the middle; then nodes that gain most
    by it change places in equal numbers, as long as edges between the halves get fewer.
    """
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    weight = degree / degree.sum()
    mode = rng.normal(size=n)
    for _ in range(60):
        mode = 0.5 * mode + 0.5 * np.bincount(a, mode[b], n) / degree
        mode -= (mode * weight).sum()
        mode /= np.abs(mode).max() or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(mode, kind="stable")[n // 2 :]] = True
    cut, share = int((side[a] != side[b]).sum()), 1.0
    while share > 0.02:
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
        low, high = (np.flatnonzero(side == s)[np.argsort(-gain[side == s], kind="stable")] for s in (False, True))
        pairs = min(len(low), len(high))
        good = int((gain[low[:pairs]] + gain[high[:pairs]] > 0).sum())
        swap = int(np.ceil(good * share))
        if not swap:
            break
        new = side.copy()
        new[low[:swap]], new[high[:swap]] = True, False
        after = int((new[a] != new[b]).sum())
        if after < cut:
            side, cut = new, after
        else:
            share /= 2
    return side


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each node, `parts` (a power of two) of equal size, by halving."""
    n, rng = len(graph), np.random.default_rng(0)
    label = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    while parts > 1:
        parts //= 2
        new = label * 2
        inner = label[a] == label[b]
        a, b = a[inner], b[inner]
        for part in np.unique(label).tolist():
            own = np.flatnonzero(label == part)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            edge = label[a] == part
            new[own] += _halves(len(own), place[a[edge]], place[b[edge]], rng)
        label = new
    return label


@dataclass
class Router:
    """A classifier of one hidden layer; vectors are centred and scaled before it."""

    mean: np.ndarray
    scale: float
    first: tuple[np.ndarray, np.ndarray]
    second: tuple[np.ndarray, np.ndarray]

    def probability(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.first[0] + self.first[1], 0)
        score = hidden @ self.second[0] + self.second[1]
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def mass_before(self, x: np.ndarray) -> np.ndarray:
        """Of each partition the probability of those that are more probable; the first of equals counts as more."""
        p = self.probability(x)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, 1)
        out = np.empty_like(p)
        np.put_along_axis(out, order, np.cumsum(ranked, axis=1) - ranked, 1)
        return out


def fitted(x: np.ndarray, parts: int) -> Router:
    """Partition the rows' neighbour graph and learn, by Adam, how a row's neighbours and itself are spread over the partitions."""
    d, rng = x.shape[1], np.random.default_rng(0)
    mean = x.mean(axis=0) if len(x) else np.zeros(d)
    scale = float(np.sqrt(((x - mean) ** 2).mean())) if len(x) else 1.0
    router = Router(mean, scale or 1.0, (rng.normal(size=(d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN)), (rng.normal(size=(HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)))
    if parts == 1 or not len(x):
        return router
    graph = neighbour_graph(x)
    label = balanced_parts(graph, parts)
    met = np.hstack([label[:, None], label[graph]])
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), met.shape[1]), met.ravel()), 1 / met.shape[1])
    wide = (x - mean) / router.scale
    weights = [router.first[0], router.first[1], router.second[0], router.second[1]]
    moment, spread, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for s in range(0, len(x), BATCH):
            some, step = order[s : s + BATCH], step + 1
            inner = wide[some] @ weights[0] + weights[1]
            hidden = np.maximum(inner, 0)
            score = hidden @ weights[2] + weights[3]
            score = np.exp(score - score.max(axis=1, keepdims=True))
            error = (score / score.sum(axis=1, keepdims=True) - goal[some]) / len(some)
            back = (error @ weights[2].T) * (inner > 0)
            slope = [wide[some].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            for w, g, m, v in zip(weights, slope, moment, spread, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(mean, router.scale, (weights[0], weights[1]), (weights[2], weights[3]))
