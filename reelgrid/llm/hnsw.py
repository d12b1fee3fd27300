"""Hierarchical navigable small-world graphs, searched for many queries in step."""

from __future__ import annotations

import numpy as np

WIDTH = 16
BUILD_BEAM = 48
BATCH = 512


class Layer:
    """The graph of one level: who is in it, and each member's neighbours (-1: none)."""

    def __init__(self, n: int, width: int):
        self.near = np.full((n, width), -1, np.int32)
        self.entry = -1


class HNSW:
    """Unit vectors (float32 rows) with links of falling reach; levels drawn with ratio 1/WIDTH."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.x = vectors
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(WIDTH)).astype(np.int64), 6)
        self.layers = [Layer(n, 2 * WIDTH if k == 0 else WIDTH) for k in range(int(self.level.max(initial=0)) + 1)]
        at = 0
        while at < n:
            upto = min(n, at + max(1, min(at, BATCH)))
            self._insert(np.arange(at, upto))
            at = upto

    def _beam(self, layer: Layer, query: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` most similar members met from start (rows of ids, -1: none): ids and similarities, best first."""
        rows = np.arange(len(query))[:, None]
        seen = np.zeros((len(query), len(self.x) + 1), bool)
        seen[:, -1] = True
        ids = np.full((len(query), beam), -1, np.int64)
        sims = np.full((len(query), beam), -2.0, np.float32)
        done = np.ones((len(query), beam), bool)

        def add(which: np.ndarray, new: np.ndarray) -> None:
            new = np.where(seen[which[:, None], new], -1, new)
            # the same neighbour can come from two members expanded together
            order = np.sort(new, axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            new = order
            seen[which[:, None], new] = True
            some = new >= 0
            got = np.full(new.shape, -2.0, np.float32)
            r, c = np.nonzero(some)
            got[r, c] = np.einsum("kd,kd->k", self.x[new[r, c]], query[which[r]])
            all_sims = np.concatenate([sims[which], got], axis=1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[which] = np.take_along_axis(all_sims, top, 1)
            ids[which] = np.take_along_axis(np.concatenate([ids[which], new], axis=1), top, 1)
            done[which] = np.take_along_axis(np.concatenate([done[which], ~some], axis=1), top, 1)

        add(rows[:, 0], start)
        together = 4
        while True:
            live = np.flatnonzero(~done.all(axis=1))
            if not len(live):
                return ids, sims
            turn = np.argsort(done[live], axis=1, kind="stable")[:, : min(together, beam)]
            picked = np.where(np.take_along_axis(done[live], turn, 1), -1, np.take_along_axis(ids[live], turn, 1))
            done[live[:, None], turn] = True
            near = np.where(picked[:, :, None] >= 0, layer.near[picked], -1)
            add(live, near.reshape(len(live), -1).astype(np.int64))

    def _select(self, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of candidates (best first) those closer to base than to any taken before, then the best others, up to width."""
        x = self.x[ids]
        between = np.einsum("bcd,bed->bce", x, x)
        taken = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -2.0, np.float32)  # to the nearest one taken
        for c in range(ids.shape[1]):
            take = (ids[:, c] >= 0) & (sims[:, c] > closest[:, c]) & (taken.sum(axis=1) < width)
            taken[:, c] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, c, :]), closest)
        rank = np.where(ids >= 0, np.where(taken, 0, 1), 2)
        order = np.argsort(rank, axis=1, kind="stable")[:, :width]
        return np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)

    def _insert(self, new: np.ndarray) -> None:
        query = self.x[new]
        start = np.full((len(new), 1), -1, np.int64)
        for k in reversed(range(len(self.layers))):
            layer = self.layers[k]
            inside = np.flatnonzero(self.level[new] >= k)
            if layer.entry >= 0:
                entry = np.where((start >= 0).any(axis=1)[:, None], start, layer.entry)
                ids, sims = self._beam(layer, query, entry, BUILD_BEAM)
                start = ids[:, :4]
            else:
                ids, sims = np.full((len(new), 1), -1, np.int64), np.full((len(new), 1), -2.0, np.float32)
            if not len(inside):
                continue
            # Those inserted together see each other as well.
            mates = query[inside] @ query[inside].T
            np.fill_diagonal(mates, -2.0)
            best = np.argsort(-mates, axis=1, kind="stable")[:, :WIDTH]
            ids = np.concatenate([ids[inside], np.where(np.take_along_axis(mates, best, 1) > -2, new[inside][best], -1)], axis=1)
            sims = np.concatenate([sims[inside], np.take_along_axis(mates, best, 1)], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            chosen = self._select(new[inside], ids, sims, WIDTH)
            layer.near[new[inside], : chosen.shape[1]] = chosen
            self._back(layer, new[inside], chosen)
            if layer.entry < 0:
                layer.entry = int(new[inside][0])

    def _back(self, layer: Layer, source: np.ndarray, chosen: np.ndarray) -> None:
        """Links from the chosen back to their source; full lists are selected anew."""
        to, own = chosen.ravel(), np.repeat(source, chosen.shape[1])
        own, to = own[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, own = to[order], own[order]
        who, at, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(at, count)
        extra = np.full((len(who), int(count.max(initial=0))), -1, np.int64)
        extra[np.repeat(np.arange(len(who)), count), rank] = own
        width = layer.near.shape[1]
        for s in range(0, len(who), BATCH):
            part = who[s : s + BATCH]
            ids = np.concatenate([layer.near[part].astype(np.int64), extra[s : s + BATCH]], axis=1)
            ids = -np.sort(-ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("bcd,bd->bc", self.x[ids], self.x[part]), -2.0)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            full = (ids >= 0).sum(axis=1) > width
            kept = ids[:, :width].copy()
            if full.any():
                kept[full] = self._select(part[full], ids[full], sims[full], width)
            layer.near[part, : kept.shape[1]] = kept

    def search(self, query: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ids and similarities of the `beam` best members met, best first."""
        start = np.full((len(query), 1), -1, np.int64)
        for k in reversed(range(len(self.layers))):
            layer = self.layers[k]
            if layer.entry < 0:
                continue
            entry = np.where((start >= 0).any(axis=1)[:, None], start, layer.entry)
            ids, sims = self._beam(layer, query, entry, beam if k == 0 else 4)
            start = ids
        return ids, sims
