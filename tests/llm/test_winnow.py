"""Segments of some windows only: those of all windows, at the cost of what these cover."""

import numpy as np


def test_segments_among(monkeypatch):
    from reelgrid.llm import winnow

    rng, looked, piece = np.random.default_rng(1), [], winnow._piece
    monkeypatch.setattr(winnow, "_piece", lambda codes, *rest: looked.append(len(codes)) or piece(codes, *rest))
    for window, gram in ((20, 5), (1, 1), (7, 7), (9, 1)):
        bounds = np.append(0, np.cumsum(rng.integers(0, 90, 60)))
        codes = winnow.BYTE_CODES[rng.integers(0, 3, bounds[-1])]
        whole = winnow.segments(codes, bounds, window, gram, 1)
        akey = {w: a for f, l, a in zip(whole["first"], whole["last"], whole["akey"], strict=True) for w in range(f, l + 1)}
        for share in (0, 0.02, 0.5, 1):
            among = np.convolve(rng.random(bounds[-1]) < share, np.ones(4), "same") > 0
            looked.clear()
            some, got = winnow.segments(codes, bounds, window, gram, 1, among), {}
            assert sum(looked) <= sum(among) * window
            for f, l, a, s in zip(*(some[c].tolist() for c in ("first", "last", "akey", "skey")), strict=True):
                assert winnow.span_hash(winnow.prefix_sums(codes[f : l + window]), np.array([0]), np.array([l + window - f]))[0] == s
                assert not got.keys() & set(range(f, l + 1))
                got |= dict.fromkeys(range(f, l + 1), a)
            assert got == {w: a for w, a in akey.items() if among[w]}


def test_a_block_is_cut_once_a_rule(monkeypatch):
    """What rules before have found is kept where a block goes through all of them."""
    import pyarrow as pa

    from reelgrid.llm import blocks, repeats, winnow

    calls, segments = [], winnow.segments
    monkeypatch.setattr(winnow, "segments", lambda *a: (len(a) == 6 and calls.append(a[4])) or segments(*a))
    step = repeats._Steps(False, 20, 5, 16, 100, None, lambda table, units, covered: covered)
    text = [bytes(np.random.default_rng(3).integers(97, 123, 400, np.uint8))]
    payload = blocks.to_bytes(pa.table({"id": [1], "text": pa.array(text, pa.binary())}))
    rows, among = [], None
    data = winnow.BYTE_CODES[np.frombuffer(text[0], np.uint8)]
    for rule in range(3):
        seg = segments(data, np.array([0, 400]), 20, 5, rule, among)
        crowded = np.arange(len(seg["skey"])) % 3 == 0
        state = np.where(crowded, repeats.CROWDED, repeats.ALL).astype(np.uint8) if rule < 2 else np.full(len(seg["skey"]), repeats.ALL, np.uint8)
        rows.append((0, rule, seg["akey"].tobytes(), seg["skey"].tobytes(), state.tobytes(), False, rule < 2))
        among = np.zeros(400, bool)
        for f, l in zip(seg["first"][crowded], seg["last"][crowded], strict=True):
            among[f : l + 1] = True
    calls.clear()
    covered = step.apply(pa.table({"block": [0], "payload": pa.array([payload], pa.binary())}), repeats._table(repeats.ANSWER, *zip(*rows, strict=True)))
    assert covered.all() and calls == [0, 1, 2]


def test_segments_of_bytes_hold_nothing_for_each_byte():
    """Bytes stand for their codes, and what a block's segments take in memory is what a piece takes, not eight bytes and more for each of the block's."""
    import tracemalloc

    from reelgrid.llm import repeats, winnow

    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 1 << 23).astype(np.uint8)
    bounds = np.arange(0, len(data) + 1, 1 << 12)
    units = repeats.Units(data, bounds, False)
    assert units.codes.itemsize == 1
    small = slice(0, 1 << 14)
    one, other = (winnow.segments(c, bounds[:5], 200, 40) for c in (data[small], winnow.BYTE_CODES[data[small]]))
    assert all((one[c] == other[c]).all() for c in one) and len(one["first"]) > 4
    tracemalloc.start()
    try:
        winnow.segments(units.codes, bounds, 200, 40)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5 * len(data)


def test_runs_of_windows_that_take_part(monkeypatch):
    """As runs and as a mark for each unit, the same windows give the same segments."""
    from reelgrid.llm import repeats, winnow

    monkeypatch.setattr(winnow, "_PIECE_BITS", 9)
    rng = np.random.default_rng(2)
    for window, gram in ((20, 5), (1, 1), (7, 7), (9, 1)):
        bounds = np.append(0, np.cumsum(rng.integers(0, 90, 60)))
        codes = rng.integers(0, 3, bounds[-1]).astype(np.uint8)
        whole = winnow.segments(codes, bounds, window, gram)
        state = np.where(rng.random(len(whole["first"])) < 0.4, repeats.CROWDED, repeats.ALL)
        step = repeats._Steps(False, window, gram, 16, 100, None, None)
        runs, among = step.crowded_windows(whole, state), np.zeros(bounds[-1], bool)
        for s, e in runs.T.tolist():
            among[s:e] = True
        one, other = (winnow.segments(codes, bounds, window, gram, 1, x) for x in (runs, among))
        assert all((one[c] == other[c]).all() for c in one)
        assert sum((one["last"] - one["first"] + 1).tolist()) == among.sum()


def test_covered_by():
    from reelgrid.llm import repeats

    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 300):
        for k in (0, 1, 20):
            first = rng.integers(0, n, k * (n > 0))
            end = np.minimum(first + rng.integers(1, 12, len(first)), n)
            brute = np.zeros(n, bool)
            for s, e in zip(first, end, strict=True):
                brute[s:e] = True
            assert (repeats.covered_by(first, end, n) == brute).all()
