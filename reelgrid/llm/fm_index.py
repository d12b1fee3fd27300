"""An FM-index over numbered words: wavelet ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def _suffixes(text: np.ndarray, top: int) -> np.ndarray:
    """Suffix order of text (numbers from 0 to top) by doubling, with the index in the low bits."""
    n = len(text)
    place = np.uint64(max(1, (n - 1).bit_length()))
    low = np.uint64((1 << int(place)) - 1)
    width = max(1, (64 - int(place)) // max(1, int(top).bit_length()))
    bits = np.uint64(max(1, int(top).bit_length()))
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = key << bits | padded[k : k + n]
    merged = np.sort(key << place | np.arange(n, dtype=np.uint64))
    while True:
        order = (merged & low).astype(np.int64)
        head = merged >> place
        if (head[1:] != head[:-1]).all():
            return order
        rank = np.zeros(n + 1, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], head[1:] != head[:-1]]))
        behind = rank[np.minimum(np.arange(n) + width, n)]
        pair = rank[:n] * (n + 1) + behind
        if int(n + 1).bit_length() * 2 + int(place) > 64:
            by = np.argsort(pair, kind="stable")
            head = pair[by]
            merged = np.cumsum(np.concatenate([[0], head[1:] != head[:-1]])).astype(np.uint64) << place | by.astype(np.uint64)
        else:
            merged = np.sort(pair.astype(np.uint64) << place | np.arange(n, dtype=np.uint64))
        width *= 2


class FMIndex:
    """Finds phrases in text, an array of numbers from 0; 0 parts what no phrase may span."""

    def __init__(self, text: np.ndarray):
        text = np.concatenate([text + 1, [0]])  # one end, below all
        self.n = len(text)
        top = int(text.max())
        order = _suffixes(text, top)
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 2))])
        self.top = top
        # Wavelet tree, level by level from the leading bit; at each, the ones before every place, and all zeros.
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = bwt
        for bit in reversed(range(max(1, top.bit_length()))):
            ones = (row >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]), int(self.n - ones.sum())))
            row = np.concatenate([row[~ones], row[ones]])
        self.bwt = bwt
        kept = order % SAMPLE == 0
        self.sampled, self.sample_rank, self.samples = kept, np.cumsum(kept) - 1, order[kept]

    def rank(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each word stands before a place of the transform."""
        zero = np.zeros_like(place)
        for bit, ones, zeros in self.levels:
            one = (word >> bit & 1).astype(bool)
            place = np.where(one, zeros + ones[place], place - ones[place])
            zero = np.where(one, zeros + ones[zero], zero - ones[zero])
        return place - zero

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of phrases (a row each, numbers over 0) those that occur: the phrase and place in the text of each occurrence."""
        phrases = phrases + 1
        live = np.flatnonzero((phrases <= self.top).all(axis=1))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for k in reversed(range(phrases.shape[1])):
            word = phrases[live, k]
            lo, hi = self.before[word] + self.rank(word, lo), self.before[word] + self.rank(word, hi)
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
        count = hi - lo
        row = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(live, count), self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text places of rows of the suffix order: steps back until a sampled suffix."""
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        while True:
            away = np.flatnonzero(~self.sampled[row])
            if not len(away):
                return self.samples[self.sample_rank[row]] + steps
            word = self.bwt[row[away]]
            row[away] = self.before[word] + self.rank(word, row[away])
            steps[away] += 1
