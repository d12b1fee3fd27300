"""Which units of a corpus (bytes or words) does a window cover whose content also starts elsewhere?

The work runs over blocks of documents (blocks.py).  Blocks stay in their files,
dealt by their number; only hashes, and texts of candidates, move:

1. A block names its segments (winnow.py) by akey and skey, once each with the
   number of their occurrences.  All that share an akey meet in one bucket.  An
   akey met once repeats nothing.  A segment whose akey and skey are met twice is
   repeated in all its windows, and the block hears so.
2. What is left are segments met once whose akey others share.  Their text, and
   that of one copy of each other segment of that akey, goes to the akey's
   bucket, where an index over these few texts decides window by window.
3. Answers return to the blocks, which mark what the repeated windows cover.

An akey with over `hot` different segments (a line that a third of all documents
hold, each in its own surroundings) would bring too much into one task.  Its
windows take other anchors instead, by another order of the hashes, and go through
the same steps once more; windows that keep meeting in such lines are in the end
their own anchors, which only equal windows share.  A block that alone has many
segments of one akey says so in one entry and does not list them.

Segments are taken for equal if the 64-bit hashes of both their anchor and their
whole content are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import bwt, winnow

#: Different segments of one akey that one index holds at most, and that one block lists.
HOT, LISTED = 2048, 64
#: Rules that anchors are chosen by, one after the other; by the last a window is its own anchor.
RULES = 4

# States of a segment in an answer, and the count that says that a block has too many of an akey.
ALL, SINGLE, CONTEXT, CROWDED = 1, 2, 3, 4
MANY = 255

ASK = "bucket long, block long, akey binary, skey binary, n binary"
ANSWER = "block long, kind int, a binary, b binary, c binary, ships boolean, crowded boolean"
#: Answers of rule k about segments have the kind k; about windows VERDICT + k.
VERDICT = 64
SENT = "bucket long, block long, akey binary, skey binary, n binary, ends binary, text binary"


class Units:
    """A block's documents as sequences of bytes or words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, words: bool):
        self.data, self.words = data, words
        if words:
            self.start, self.end, self.bounds = winnow.word_spans(data, bounds, winnow.WHITE)
            self.codes = winnow.word_codes(data, self.start, self.end)
        else:
            self.bounds, self.codes = bounds, data

    def cut(self, first: int, end: int) -> tuple[int, int]:
        """Where the units first:end lie in the bytes."""
        return (int(self.start[first]), int(self.end[end - 1])) if self.words else (first, end)


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _longs(column: pa.ChunkedArray, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of keys, by bucket."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(16)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    for b, places in zip(found.tolist(), np.split(order, at[1:]), strict=True):
        yield b, places


def _ask(keys: np.ndarray, skeys: np.ndarray, n: np.ndarray, block: int, buckets: int) -> pa.Table:
    rows = [(b, block, keys[i].tobytes(), skeys[i].tobytes(), n[i].astype(np.uint8).tobytes()) for b, i in _by_bucket(keys, buckets)]
    return _table(ASK, *(zip(*rows, strict=True) if rows else [[]] * 5))


def _count(table: pa.Table, hot: int, rule: int) -> pa.Table:
    """One bucket's answers to all blocks that asked."""
    asked = table.column("akey").to_pylist()
    akey, skey, n = _longs(table.column("akey")), _longs(table.column("skey")), _longs(table.column("n"), np.uint8).astype(np.int64)
    block = np.repeat(np.array(table.column("block").to_pylist(), np.int64), [len(x) // 8 for x in asked])
    order = np.lexsort((block, skey, akey))
    akey, skey, n, block = akey[order], skey[order], n[order], block[order]
    new_akey = np.concatenate([[True], akey[1:] != akey[:-1]])
    new = new_akey | np.concatenate([[True], skey[1:] != skey[:-1]])
    segment, group = np.cumsum(new) - 1, np.cumsum(new_akey) - 1
    total = np.add.reduceat(n, np.flatnonzero(new))[segment]
    different, singles = np.bincount(group, new)[group], np.bincount(group, new & (total == 1))[group]
    told = np.bincount(group, n)[group] >= 2
    state = np.where(total >= 2, ALL, SINGLE)
    state[told & (different > 1) & (singles > 0) & (total >= 2) & new] = CONTEXT
    state[(np.maximum.reduceat(n, np.flatnonzero(new_akey)) == MANY)[group] | (different > hot)] = CROWDED
    keep = np.flatnonzero(told)
    keep = keep[np.argsort(block[keep], kind="stable")]
    found, at = np.unique(block[keep], return_index=True)
    parts = np.split(keep, at[1:]) if len(keep) else []
    states = [state[i].astype(np.uint8) for i in parts]
    rows = [[f(x) for x in parts] for f in (lambda i: akey[i].tobytes(), lambda i: skey[i].tobytes())]
    return _table(ANSWER, found, [rule] * len(found), *rows, [x.tobytes() for x in states], [bool((x == SINGLE).any() or (x == CONTEXT).any()) for x in states], [bool((x == CROWDED).any()) for x in states])


def _look_up(key: np.ndarray, sorted_key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of each key, 0 for those not known."""
    if not len(sorted_key):
        return np.zeros(len(key), value.dtype)
    at = np.minimum(np.searchsorted(sorted_key, key), len(sorted_key) - 1)
    return np.where(sorted_key[at] == key, value[at], 0)


class _Told:
    """What a block has been told, by kind."""

    def __init__(self, answers: pa.Table):
        self.answers, self.kinds = answers, answers.column("kind").to_pylist()

    def of(self, kind: int) -> pa.Table:
        return self.answers.take(pa.array([i for i, k in enumerate(self.kinds) if k == kind], pa.int64()))

    def states(self, rule: int, seg: dict[str, np.ndarray]) -> np.ndarray:
        part = self.of(rule)
        akey, skey, state = _longs(part.column("a")), _longs(part.column("b")), _longs(part.column("c"), np.uint8)
        order = np.argsort(skey)
        found = _look_up(seg["skey"], skey[order], state[order])
        crowded = np.unique(akey[state == CROWDED])
        return np.where(_look_up(seg["akey"], crowded, np.ones(len(crowded), np.uint8)) > 0, CROWDED, found)


class _Steps:
    """What runs on executors; holds parameters only."""

    def __init__(self, words: bool, window: int, gram: int, buckets: int, hot: int, decide: Callable, finish: Callable):
        self.words, self.window, self.gram, self.buckets, self.hot, self.decide, self.finish = words, window, gram, buckets, hot, decide, finish

    def at(self, rule: int) -> tuple[Callable, ...]:
        """The steps by one rule; Spark counts the arguments of what it is given, `self` included."""
        hot = self.hot if rule < RULES else 1 << 62
        return (lambda own, told: self.ask_again(own, told, rule)), (lambda t: _count(t, hot, rule)), (lambda own, told: self.send(own, told, rule)), (lambda t: self.judge(t, rule))

    def units(self, payload: bytes) -> tuple[pa.Table, Units]:
        table = B.from_bytes(payload)
        data, bounds = B.flat(table.column("text"))
        return table, Units(data, bounds, self.words)

    def segments(self, units: Units, rule: int, among: np.ndarray | None) -> dict[str, np.ndarray]:
        return winnow.segments(units.codes, units.bounds, self.window, self.window if rule == RULES else self.gram, rule, among)

    def crowded_windows(self, seg: dict[str, np.ndarray], state: np.ndarray) -> np.ndarray:
        """Runs of windows that a rule could not deal out: where they begin and end."""
        crowded = state == CROWDED
        return np.stack([seg["first"][crowded], seg["last"][crowded] + 1])

    def open_windows(self, units: Units, told: _Told, rule: int) -> np.ndarray | None:
        """Runs of windows that no rule before this one could deal out; None for all."""
        among = None
        for before in range(rule):
            seg = self.segments(units, before, among)
            among = self.crowded_windows(seg, told.states(before, seg))
        return among

    def ask(self, block: int, payload: bytes, told: _Told | None, rule: int) -> pa.Table:
        units = self.units(payload)[1]
        seg = self.segments(units, rule, self.open_windows(units, told, rule) if rule else None)
        skey, at, n = np.unique(seg["skey"], return_index=True, return_counts=True)
        akey, n = seg["akey"][at], np.minimum(n, 2)
        if rule < RULES:
            distinct, first, group, count = np.unique(akey, return_index=True, return_inverse=True, return_counts=True)
            many = count > min(LISTED, self.hot)
            keep = ~many[group]
            keep[first[many]] = True
            n[first[many]] = MANY
            skey, akey, n = skey[keep], akey[keep], n[keep]
        return _ask(akey, skey, n, block, self.buckets)

    def ask_blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                yield from self.ask(block, payload.as_py(), None, 0).combine_chunks().to_batches()

    def ask_again(self, block: pa.Table, answers: pa.Table, rule: int) -> pa.Table:
        if not block.num_rows or not answers.num_rows:
            return _table(ASK, *[[]] * 5)
        return self.ask(block.column("block")[0].as_py(), block.column("payload")[0].as_py(), _Told(answers), rule)

    def send(self, block: pa.Table, answers: pa.Table, rule: int) -> pa.Table:
        """The texts that indexes need."""
        if not block.num_rows or not answers.num_rows:
            return _table(SENT, *[[]] * 7)
        number, told = block.column("block")[0].as_py(), _Told(answers)
        units = self.units(block.column("payload")[0].as_py())[1]
        seg = self.segments(units, rule, self.open_windows(units, told, rule))
        state = told.states(rule, seg)
        _, place = np.unique(seg["skey"], return_index=True)
        rows = []
        sent = place[np.isin(state[place], (CONTEXT, SINGLE))]
        for b, i in _by_bucket(seg["akey"][sent], self.buckets):
            at = sent[i]
            cuts = [units.cut(f, l + self.window) for f, l in zip(seg["first"][at].tolist(), seg["last"][at].tolist(), strict=True)]
            text = [units.data[s:e].tobytes() for s, e in cuts]
            ends = np.cumsum([len(x) for x in text]).astype(np.int64)
            rows.append((b, number, seg["akey"][at].tobytes(), seg["skey"][at].tobytes(), np.where(state[at] == CONTEXT, 2, 1).astype(np.uint8).tobytes(), ends.tobytes(), pa.compress(b"".join(text), "zstd", asbytes=True)))
        return _table(SENT, *(zip(*rows, strict=True) if rows else [[]] * 7))

    def judge(self, table: pa.Table, rule: int) -> pa.Table:
        """An index over a bucket's texts, some akeys at a time; what repeats, to the blocks of the segments met once."""
        akey, skey, n = _longs(table.column("akey")), _longs(table.column("skey")), _longs(table.column("n"), np.uint8)
        texts, block = [], []
        for number, ends, text in zip(table.column("block").to_pylist(), table.column("ends").to_pylist(), table.column("text").to_pylist(), strict=True):
            ends = np.frombuffer(ends, np.int64).tolist()
            raw = pa.decompress(text, ends[-1], "zstd", asbytes=True)
            texts += [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            block += [number] * len(ends)
        order = np.argsort(akey, kind="stable")
        told: dict[int, list[tuple[int, int, int]]] = {}
        for group in self._groups(akey, order, [len(x) for x in texts]):
            for i, runs in zip(group, self.decide([texts[i] for i in group], [int(n[i]) for i in group], self.window), strict=True):
                if n[i] == 1:
                    told.setdefault(block[i], []).extend((int(skey[i]), s, e) for s, e in runs)
        rows = [(b, VERDICT + rule, np.array([x[0] for x in v], np.uint64).tobytes(), np.array([x[1] for x in v], np.int64).tobytes(), np.array([x[2] for x in v], np.int64).tobytes(), False, False) for b, v in told.items() if v]
        return _table(ANSWER, *(zip(*rows, strict=True) if rows else [[]] * 7))

    def _groups(self, akey: np.ndarray, order: np.ndarray, size: list[int], limit: int = 1 << 19) -> Iterator[list[int]]:
        """Whole akeys, together at most `limit` bytes unless one akey alone has more."""
        held, total = [], 0
        edges = np.flatnonzero(np.concatenate([[True], akey[order][1:] != akey[order][:-1], [True]]))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            own = order[s:e].tolist()
            more = sum(size[i] + 1 for i in own)
            if held and total + more > limit:
                yield held
                held, total = [], 0
            held, total = held + own if len(held) < 64 else [*held, *own], total + more
        if held:
            yield held

    def apply(self, block: pa.Table, answers: pa.Table) -> pa.Table:
        """Mark what repeated windows cover and let `finish` make rows of it."""
        table, units = self.units(block.column("payload")[0].as_py())
        told, among = _Told(answers), None
        spans: list[tuple[np.ndarray, np.ndarray]] = []
        for rule in range(RULES + 1):
            if among is not None and not among.size:
                break
            seg = self.segments(units, rule, among)
            state = told.states(rule, seg)
            whole = np.isin(state, (ALL, CONTEXT))
            spans.append((seg["first"][whole], seg["last"][whole] + self.window))
            part = told.of(VERDICT + rule)
            key, lo, hi = _longs(part.column("a")), _longs(part.column("b"), np.int64), _longs(part.column("c"), np.int64)
            if len(key):
                order = np.argsort(seg["skey"])
                at = order[np.searchsorted(seg["skey"][order], key)]
                spans.append((seg["first"][at] + lo, seg["first"][at] + hi - 1 + self.window))
            among = self.crowded_windows(seg, state)
        return self.finish(table, units, covered_by(*map(np.concatenate, zip(*spans, strict=True)), len(units.codes)))


def covered_by(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n units the spans first:end (none empty) cover."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = first[1:] > reach[:-1]
    edges = np.stack([first[np.append(True, new)[: len(first)]], reach[np.append(new, True)[-len(first) :]]], axis=1).ravel() if len(first) else first
    return np.repeat(np.arange(len(edges) + 1) % 2 == 1, np.diff(edges, prepend=0, append=n))


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True, as half-open pairs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def marked(docs: DataFrame, id_col: str, text_col: str, *, words: bool, window: int, gram: int, decide: Callable, finish: Callable, schema: str, hot: int = HOT, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Run the exchanges; `finish(table, units, covered)` makes the rows (of `schema`) of a block's documents.

    decide(texts, weights, window): for each candidate text, the runs of its window starts that weigh 2 or more.
    """
    if not 1 <= gram <= window:
        raise ValueError("an anchor has to fit its window")
    if not words:  # a segment has under two windows' bytes: what one index holds has to fit
        hot = min(hot, bwt.MAX_TEXT // (2 * window + 1))
        if not hot:
            raise ValueError(f"windows of over {bwt.MAX_TEXT // 2} bytes do not fit an index")
    packed = B.packed(docs, id_col, text_col, block_bytes)
    step = _Steps(words, window, gram, B.buckets_for(packed), hot, decide, finish)
    own = packed.select("block", "payload").groupBy("block")
    known: list[DataFrame] = []
    crowded = None
    for rule in range(RULES + 1):
        ask_again, count, send, judge = step.at(rule)
        asked = own.cogroup(crowded.groupBy("block")).applyInArrow(ask_again, ASK) if rule else packed.select("block", "payload").mapInArrow(step.ask_blocks, ASK)
        answers = B.kept(asked.groupBy("bucket").applyInArrow(count, ANSWER), "answers")

        def with_earlier(told: DataFrame, earlier: DataFrame | None = crowded) -> DataFrame:
            """The answers by this rule, with what their blocks were told of crowded anchors by those before."""
            return told if earlier is None else told.unionByName(earlier.join(told.select("block").distinct(), "block", "left_semi"))

        sent = own.cogroup(with_earlier(answers.filter("ships")).groupBy("block")).applyInArrow(send, SENT)
        known += [answers, sent.groupBy("bucket").applyInArrow(judge, ANSWER)]
        now = answers.filter("crowded")
        if now.isEmpty():
            break
        crowded = with_earlier(now)
    told = known[0]
    for more in known[1:]:
        told = told.unionByName(more)
    return own.cogroup(told.groupBy("block")).applyInArrow(lambda own, told: step.apply(own, told), schema)
