"""Content-chosen anchors that bring equal windows of long sequences together.

Two equal windows of L units hold the same units, so a rule that looks only at
a window's content picks the same place in both.  The rule here: of the k-grams
in the window, the one with the smallest mixed hash, the leftmost of equals.
Consecutive windows mostly share their choice; such a run of windows is a
*segment*, and it travels under the hash of its k-gram (`akey`).  All equal
windows of the corpus hence lie in segments with one akey, and work on a akey's
segments alone decides exactly which windows repeat.  Any other order of the hashes
is as good a rule, and gives other anchors to the same windows.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_PIECE_BITS = 18
_LOW = np.uint64((1 << _PIECE_BITS) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on every element."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


#: A mixed 64-bit value for each byte.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)

_power_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power_cache.get("up", ())) < n:
        size = max(n, 1 << 16)
        _power_cache["up"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _MULT)]))
        _power_cache["down"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _INV)]))
    return _power_cache["up"], _power_cache["down"]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = the hash of codes[s:e], times a factor that depends on s alone."""
    _, down = _powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * down[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The mixed 64-bit hash of each codes[start:end], the same wherever those codes stand."""
    up, _ = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * up[start] + (end - start).astype(np.uint64))


def _piece(codes: np.ndarray, window: int, gram: int, rule: int) -> tuple[np.ndarray, ...]:
    """Of the windows of one piece: the anchor of each start, in the low bits of what it was chosen by, and the piece's k-gram hashes and prefix sums.

    rule: which order of hashes the smallest is chosen by.
    """
    prefix = prefix_sums(BYTE_CODES[codes] if codes.dtype == np.uint8 else codes)
    up, _ = _powers(len(prefix))
    grams = prefix[gram:] - prefix[:-gram]
    grams *= up[: len(grams)]
    grams = mix(grams)
    low = (mix(grams + np.uint64(rule)) if rule else grams) & ~_LOW
    low |= np.arange(len(grams), dtype=np.uint64)
    places, width = window - gram + 1, 1
    while width * 2 <= places:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if places > width:
        low = np.minimum(low[: len(low) - (places - width)], low[places - width :])
    return low, grams, prefix


def segments(codes: np.ndarray, bounds: np.ndarray, window: int, gram: int, rule: int = 0, among: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Segments of the sequences codes[bounds[i]:bounds[i+1]]; sequences under `window` units have none.

    codes: 64-bit values, or bytes, which stand for theirs.
    among: for each unit, whether the window that starts there takes part; or, as two rows, where runs of windows of
    one sequence that take part begin and end, in order; all do where left out.  Only what these windows cover is looked at.

    first, last: starts of the segment's first and last window; akey: the anchor's hash;
    skey: the hash of codes[first:last + window].  Long inputs go through in pieces; where a
    piece ends a segment may be cut in two, which changes no window's akey.
    """
    if among is not None:
        return _segments_among(codes, bounds, window, gram, rule, among)
    # What is looked at of each sequence is where its windows start; segments begin there and where the anchor changes.
    begin, end = bounds[:-1], bounds[1:] - window + 1
    begin, end = begin[end > begin], end[end > begin]
    step = (1 << _PIECE_BITS) - window
    found = []
    for at in range(0, max(len(codes) - window + 1, 0), step):
        here = slice(np.searchsorted(end, at, "right"), np.searchsorted(begin, at + step))
        if here.start >= here.stop:
            continue
        low, grams, prefix = _piece(codes[at : at + step + window - 1], window, gram, rule)
        s, e = np.maximum(begin[here] - at, 0), np.minimum(end[here] - at, len(low))
        change = np.flatnonzero(low[1:] != low[:-1]) + 1
        own = np.maximum(np.searchsorted(s, change, "right") - 1, 0)
        inside = (change > s[own]) & (change < e[own])
        first = np.concatenate([s, change[inside]])
        order = np.argsort(first, kind="stable")
        first, own = first[order], np.concatenate([np.arange(len(s)), own[inside]])[order]
        last = np.minimum(np.append(first[1:], len(low)), e[own]) - 1
        found.append((first + at, last + at, grams[(low[first] & _LOW).astype(np.int64)], span_hash(prefix, first, last + window)))
    if not found:
        none = np.zeros(0, np.int64)
        return {"first": none, "last": none, "akey": none.astype(np.uint64), "skey": none.astype(np.uint64)}
    return dict(zip(("first", "last", "akey", "skey"), map(np.concatenate, zip(*found, strict=True)), strict=True))


def _segments_among(codes: np.ndarray, bounds: np.ndarray, window: int, gram: int, rule: int, among: np.ndarray) -> dict[str, np.ndarray]:
    """As segments: runs of windows in a row, one sequence each, with the units that they cover."""
    if among.ndim == 1:
        starts = np.flatnonzero(among)
        starts = starts[starts + window <= bounds[np.minimum(np.searchsorted(bounds, starts, "right"), len(bounds) - 1)]]
        among = np.stack([starts, starts + 1])
    starts, stops = among
    new = np.ones(len(starts) + 1, bool)
    new[1:-1] = (starts[1:] != stops[:-1]) | (np.diff(np.searchsorted(bounds, starts, "right")) != 0)
    begin, end = starts[new[:-1]], stops[new[1:]] + window - 1
    own = np.append(0, np.cumsum(end - begin))
    shift = np.repeat(begin - own[:-1], end - begin)
    found = segments(codes[shift + np.arange(len(shift))], own, window, gram, rule)
    back = shift[found["first"]]
    found["first"], found["last"] = found["first"] + back, found["last"] + back
    return found


def word_spans(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of byte sequences: starts, ends, and the bounds of each sequence in words.

    separator: 256 booleans, true for bytes that stand in no word.
    """
    inside = ~separator[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, bounds)


#: Bytes 0x20 and 0x09 to 0x0D.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time, mixed into what is before them; by XXH64 for long words.

    Mixing is not linear, so words that differ in a pattern, as those of a Thue-Morse sequence and its complement, differ in their hashes.
    """
    out, step = np.empty(len(start), np.uint64), 1 << 16
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.uint64, padded, 0, (1,))
    for at in range(0, len(start), step):
        s = start[at : at + step]
        size = end[at : at + step] - s
        code = mix((size.astype(np.uint64) + np.uint64(1)) * _MULT)
        for k in range(0, min(int(size.max()), LONG_WORD), 8):
            some = np.flatnonzero(size > k) if k else np.arange(len(s))
            code[some] = mix(code[some] ^ (eight[s[some] + k] & _KEPT[np.minimum(size[some] - k, 8)]))
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            code[i] = xxhash.xxh64_intdigest(data[s[i] : s[i] + size[i]].tobytes())
        out[at : at + step] = code
    return out
