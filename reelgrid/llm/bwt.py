"""Repeats of a fixed length from a Burrows-Wheeler transform, without the LCP array's larger values.

Strings are met by growing length: from the interval of a string w, one
backward extension for each character that precedes w gives the intervals of
cw.  A boundary behind an interval that no shorter string has set is a common
prefix of exactly |w|.  The search stops at the wanted length, so boundaries
still unset stand inside groups of suffixes that share at least that much.
"""

from __future__ import annotations

import numpy as np

#: Characters in one text at most: two ranks and an index have to fit 64 bits.
MAX_TEXT = (1 << 20) - 1
_FIRST = 5


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of uint8 `text` by their first `depth` characters at least; shorter ones stand first."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(_FIRST, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(_FIRST):
        key = key << np.uint64(8) | padded[k : k + n]
    merged = np.sort(key << np.uint64(20) | np.arange(n, dtype=np.uint64))
    order = (merged & np.uint64((1 << 20) - 1)).astype(np.int64)
    top = merged >> np.uint64(20)
    fresh = np.concatenate([[True], top[1:] != top[:-1]])
    slot = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = slot + 1
    width = _FIRST
    while width < depth:
        alone = fresh & np.concatenate([fresh[1:], [True]])
        open_slots = np.flatnonzero(~alone)
        if not len(open_slots):
            break
        at = order[open_slots]
        behind = rank[np.minimum(at + width, n)]
        merged = np.sort(rank[at].astype(np.uint64) << np.uint64(42) | behind.astype(np.uint64) << np.uint64(21) | np.arange(len(at), dtype=np.uint64))
        moved = at[(merged & np.uint64((1 << 21) - 1)).astype(np.int64)]
        order[open_slots] = moved
        pair = merged >> np.uint64(21)
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        fresh[open_slots] = new
        rank[moved] = np.maximum.accumulate(np.where(new, open_slots, 0)) + 1
        width *= 2
    return order


def repeat_boundaries(bwt: np.ndarray, length: int) -> np.ndarray:
    """True at i if suffixes i-1 and i (in order) share under `length` characters before any separator (0)."""
    n = len(bwt)
    step = np.empty(n, np.int64)  # where the suffix one longer stands
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    run_first = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
    run_end = np.concatenate([run_first[1:], [n]])
    run = np.zeros(n, np.int64)
    run[run_first[1:]] = 1
    run = np.cumsum(run)
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    lo, hi = np.array([0]), np.array([n])
    for size in range(length):
        first, last = run[lo], run[hi - 1]
        simple = first == last
        next_lo, next_hi = [step[lo[simple]]], [step[hi[simple] - 1] + 1]
        next_c = [bwt[lo[simple]]]
        if not simple.all():
            first, last, low, high = first[~simple], last[~simple], lo[~simple], hi[~simple]
            count = last - first + 1
            owner = np.repeat(np.arange(len(count)), count)
            runs = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
            begin, end = np.maximum(run_first[runs], low[owner]), np.minimum(run_end[runs], high[owner])
            char = bwt[begin].astype(np.int64)
            by = np.argsort(owner * 256 + char, kind="stable")
            key = (owner * 256 + char)[by]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            tails = np.concatenate([heads[1:], [len(key)]]) - 1
            next_lo.append(step[begin[by[heads]]])
            next_hi.append(step[end[by[tails]] - 1] + 1)
            next_c.append(char[by[heads]].astype(np.uint8))
        lo, hi, c = np.concatenate(next_lo), np.concatenate(next_hi), np.concatenate(next_c)
        new = ~cut[hi]
        if size:  # a separator may only end a string
            new &= c != 0
        lo, hi = lo[new], hi[new]
        cut[hi] = True
        if not len(lo):
            break
    return cut[:n]


def repeated_windows(text: np.ndarray, length: int, weight: np.ndarray) -> np.ndarray:
    """For each place of `text` (uint8, 0 as separator): does the string of `length` from there weigh 2 or more?

    weight: what an occurrence at each place counts; 0 where a separator cuts the string.
    """
    if len(text) > MAX_TEXT:
        raise ValueError(f"{len(text)} characters in one text; {MAX_TEXT} at most")
    order = suffix_order(text, length)
    cut = repeat_boundaries(text[order - 1], length)
    heads = np.flatnonzero(cut)
    total = np.add.reduceat(weight[order].astype(np.int64), heads)
    out = np.zeros(len(text), bool)
    out[order] = np.repeat(total >= 2, np.diff(np.concatenate([heads, [len(text)]])))
    return out & (weight > 0)
