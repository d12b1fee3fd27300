"""Suffix automata over word numbers, with what each state's strings weigh."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """All substrings of the sequences fed to it; sequences share states but never run into each other."""

    def __init__(self) -> None:
        self.longest, self.link, self.next, self.weight = [0], [-1], [{}], [0]

    def _copy(self, q: int, length: int) -> int:
        self.longest.append(length)
        self.link.append(self.link[q])
        self.next.append(self.next[q].copy())
        self.weight.append(0)
        return len(self.longest) - 1

    def _divert(self, p: int, symbol: int, q: int) -> int:
        """A state for the longest string of p plus symbol, split off q."""
        clone = self._copy(q, self.longest[p] + 1)
        link, following = self.link, self.next
        while p >= 0 and following[p].get(symbol) == q:
            following[p][symbol] = clone
            p = link[p]
        link[q] = clone
        return clone

    def feed(self, sequence: list[int], weight: int) -> None:
        """Add a sequence; each of its prefixes counts with that weight."""
        longest, link, following, heavy = self.longest, self.link, self.next, self.weight
        last = 0
        for symbol in sequence:
            q = following[last].get(symbol)
            if q is not None:
                last = q if longest[q] == longest[last] + 1 else self._divert(last, symbol, q)
            else:
                fresh = len(longest)
                longest.append(longest[last] + 1)
                link.append(0)
                following.append({})
                heavy.append(0)
                p = last
                while p >= 0 and symbol not in following[p]:
                    following[p][symbol] = fresh
                    p = link[p]
                if p >= 0:
                    q = following[p][symbol]
                    link[fresh] = q if longest[q] == longest[p] + 1 else self._divert(p, symbol, q)
                last = fresh
            heavy[last] += weight

    def repeats(self) -> list[int]:
        """For each state: the length of the longest suffix of its strings that weighs 2 or more."""
        by_length = np.argsort(np.array(self.longest), kind="stable").tolist()
        weight, link, longest = self.weight[:], self.link, self.longest
        for v in reversed(by_length):
            if v:
                weight[link[v]] += weight[v]
        best = [0] * len(longest)
        for v in by_length[1:]:
            best[v] = longest[v] if weight[v] >= 2 else best[link[v]]
        return best

    def stream(self, sequence: list[int], best: list[int]) -> list[int]:
        """Matching statistics of a sequence: at each place the longest string ending there that weighs 2 or more."""
        longest, link, following = self.longest, self.link, self.next
        at, length, out = 0, 0, []
        for symbol in sequence:
            while at and symbol not in following[at]:
                at = link[at]
                length = longest[at]
            if symbol in following[at]:
                at, length = following[at][symbol], length + 1
            out.append(min(length, best[at]))
        return out


def repeated_windows(sequences: list[list[int]], length: int, weights: list[int]) -> list[np.ndarray]:
    """For each sequence, for each start of a window of `length`: does that window weigh 2 or more over all sequences?

    The automaton of all sequences is the reference; each is then streamed through it.
    """
    automaton = SuffixAutomaton()
    for s, w in zip(sequences, weights, strict=True):
        automaton.feed(s, w)
    best = automaton.repeats()
    return [np.array(automaton.stream(s, best)[length - 1 :], np.int64) >= length for s in sequences]
