"""Benchmark decontamination with an FM-index per training shard.

A shard is some MB of documents.  Its words are numbered by the phrases'
vocabulary; others part what no phrase can span, and so do runs of known words
too short for any phrase.  Test phrases are found by backward search, their
places by sampled suffix positions, and what they cover is merged to spans.
No document leaves its task.  Phrases are broadcast in chunks of a stated
size; with one chunk documents are read once, with more they are packed into
blocks and the chunks' spans meet again at their block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import winnow
from .fm_index import FMIndex

#: Bytes of A-Z in lower case, others unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

#: Word bytes after folding: digits, a-z, and all from 0x80.
_APART = np.array([not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])

SHARD_BYTES = 16 << 20
CHUNK_BYTES = 16 << 20


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, and the bounds of the texts in words."""
    data = FOLD[data]
    start, end, of = winnow.word_spans(data, bounds, _APART)
    return start, end, winnow.word_codes(data, start, end), of


class Phrases:
    """The windows of test items: by length, a row of word numbers (from 1) for each, and the items that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        data, bounds = B.flat(pa.array([t for _, t in items], pa.binary()))
        _, _, code, of = words_of(data, bounds)
        self.vocabulary = np.unique(code)
        number = np.searchsorted(self.vocabulary, code) + 1
        holders: dict[bytes, set[str]] = defaultdict(set)
        for (name, _), s, e in zip(items, of[:-1].tolist(), of[1:].tolist(), strict=True):
            length = min(window, e - s)
            for at in range(s, e - length + 1) if length else ():
                holders[number[at : at + length].tobytes()].add(name)
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for key in holders:
            by_length[len(key) // 8].append(key)
        self.rows = {n: np.frombuffer(b"".join(keys), np.int64).reshape(-1, n) for n, keys in by_length.items()}
        self.items = {n: [sorted(holders[k]) for k in keys] for n, keys in by_length.items()}
        self.shortest = min(self.rows, default=0)

    def find(self, code: np.ndarray, bounds: np.ndarray) -> tuple[list[tuple[np.ndarray, int]], list[tuple[int, list[str]]]]:
        """Over the texts of a shard: starts and length of what occurs, and for each occurrence its place and items."""
        if not self.rows or not len(code):
            return [], []
        at = np.minimum(np.searchsorted(self.vocabulary, code), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[at] == code, at + 1, 0)
        # Runs of known words, within a text.
        known = np.concatenate([[False], number > 0, [False]])
        begins = known[1:] & ~known[:-1]
        heads = bounds[:-1][bounds[:-1] < len(code)]
        begins[heads] |= known[1:][heads]
        begin = np.flatnonzero(begins[:-1])
        if not len(begin):
            return [], []
        unknown = np.concatenate([np.flatnonzero(number == 0), [len(code)]])
        stop = np.minimum(unknown[np.searchsorted(unknown, begin)], np.concatenate([begin[1:], [len(code)]]))
        long = stop - begin >= self.shortest
        begin, length = begin[long], (stop - begin)[long]
        if not len(begin):
            return [], []
        goes = np.cumsum(length + 1) - length - 1
        place = np.repeat(begin - goes, length + 1) + np.arange(int((length + 1).sum()))
        text = number[np.minimum(place, len(number) - 1)]
        text[goes + length] = 0
        index = FMIndex(text)
        spans, holders = [], []
        for n, rows in self.rows.items():
            which, where = index.search(rows)
            where = place[where]
            spans.append((where, n))
            names = self.items[n]
            holders += [(w, names[k]) for k, w in zip(which.tolist(), where.tolist(), strict=True)]
        return spans, holders


def _digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _finish(ids: pa.ChunkedArray, data: np.ndarray, bounds: np.ndarray, words: tuple, spans: list, holders: list[tuple[int, list[str]]], with_text: bool) -> pa.Table:
    start, end, _, of = words
    change = np.zeros(len(start) + 1, np.int64)
    for where, n in spans:
        np.add.at(change, where, 1)
        np.add.at(change, where + n, -1)
    hit = np.cumsum(change[:-1]) > 0
    names: dict[int, set[str]] = defaultdict(set)
    doc = (np.searchsorted(of, np.array([w for w, _ in holders], np.int64), "right") - 1).tolist()
    for d, (_, held) in zip(doc, holders, strict=True):
        names[d].update(held)
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[of])
    none = _digest(set())
    columns = {
        "id": ids,
        "n_words": np.diff(of),
        "n_hit": n_hit,
        "n_items": [len(names.get(d, ())) for d in range(len(n_hit))],
        "items_sha256": [_digest(names[d]) if d in names else none for d in range(len(n_hit))],
        "contaminated": n_hit > 0,
    }
    if with_text:
        # A removed span reaches from its first word's first byte to its last word's last; touching spans are one.
        gone = np.zeros(len(data) + 1, np.int64)
        first = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]) | hit & np.isin(np.arange(len(hit)), of))
        last = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]) | hit & np.isin(np.arange(len(hit)) + 1, of))
        gone[start[first]] += 1
        gone[end[last]] -= 1
        keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        left, at = data[keep].tobytes(), np.searchsorted(keep, bounds).tolist()
        columns["kept"] = pa.array([left[s:e] for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary()).cast(pa.string())
    return pa.table(columns)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, with_text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Find test phrases in documents: windows of `window` words of an item, a shorter item as one window.

    Words are runs of digits, letters a-z (A-Z folded) and bytes from 0x80.  One row per row
    of docs: id, n_words, n_hit (words inside any occurrence), n_items, items_sha256 (of the
    ids of items with an occurring window, as strings, sorted, comma-joined), contaminated,
    and with `with_text` kept: the text without the spans of hit words.  Null texts have no
    words, on either side; items without words match nothing; a null item id counts as the
    string "null", equal ids as one item.  Repeated rows are documents of their own, null
    ids pass through, other columns are not read.  Without documents the result is empty,
    without items nothing is hit.  Texts are not cut: a document over the shard's size is
    a shard of its own.
    """
    schema = f"id {B.id_type(docs, id_col)}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", kept string" * with_text
    phrases = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text).cast("binary"), F.lit(b"")).alias("text"))
    chunks = max(1, -(-(phrases.agg(F.sum(F.length("text"))).first()[0] or 0) // chunk_bytes))

    def chunk(k: int):
        part = phrases if chunks == 1 else phrases.filter(F.pmod(F.xxhash64("item", "text"), F.lit(chunks)) == k)
        return docs.sparkSession.sparkContext.broadcast(Phrases([(r["item"], bytes(r["text"])) for r in part.toLocalIterator()], window))

    if chunks == 1:
        sent = chunk(0)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in B.slices(batches, "text", SHARD_BYTES):
                data, bounds = B.flat(table.column("text"))
                words = words_of(data, bounds)
                spans, holders = sent.value.find(words[2], words[3])
                yield from _finish(table.column("id"), data, bounds, words, spans, holders, with_text).combine_chunks().to_batches()

        slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
        return slim.mapInArrow(scan, schema)

    packed = B.packed(docs, id_col, text_col)
    found = None
    for k in range(chunks):
        sent = chunk(k)

        def scan_block(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                    data, bounds = B.flat(B.from_bytes(payload.as_py()).column("text"))
                    words = words_of(data, bounds)
                    spans, holders = sent.value.find(words[2], words[3])
                    lengths = [n for where, n in spans for _ in range(len(where))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(holders), pa.int64()), pa.array([w for w, _ in holders], pa.int64()), pa.array(lengths, pa.int64()), pa.array([x for _, x in holders], pa.list_(pa.string()))], ["block", "place", "length", "items"]
                    )

        part = packed.select("block", "payload").mapInArrow(scan_block, "block long, place long, length long, items array<string>")
        part = B.kept(part, "phrases")
        found = part if found is None else found.unionByName(part)
        sent.unpersist()

    def meet(own: pa.Table, told: pa.Table) -> pa.Table:
        table = B.from_bytes(own.column("payload")[0].as_py())
        data, bounds = B.flat(table.column("text"))
        words = words_of(data, bounds)
        where, length = told.column("place").to_numpy(), told.column("length").to_numpy()
        spans = [(where[length == n], int(n)) for n in np.unique(length)]
        return _finish(table.column("id"), data, bounds, words, spans, list(zip(where.tolist(), told.column("items").to_pylist(), strict=True)), with_text)

    return packed.select("block", "payload").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(meet, schema)
