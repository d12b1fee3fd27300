"""Substring dedup: word windows that start more than once are cut out everywhere.

The corpus is its own reference.  repeats.py deals candidate texts into
reference shards of bounded size that hold all that could match each other; a
suffix automaton over each shard (automaton.py) is streamed with the shard's
documents for matching statistics, and spans of `window` words or more that
weigh 2 are removed.  An automaton is sent to the texts of its own shard only:
automata of a whole corpus have no size bound that a broadcast could rely on.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import automaton, repeats
from . import blocks as B


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def decide(texts: list[bytes], weights: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each text the runs of window starts that weigh 2 or more in all."""
    numbers = _Numbers()
    found = automaton.repeated_windows([[numbers[w] for w in t.split()] for t in texts], window, weights)
    return [repeats.runs_of(x) for x in found]


def _rows(table: pa.Table, units: repeats.Units, covered: np.ndarray, with_text: bool) -> pa.Table:
    bounds = units.bounds
    removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[bounds])
    raw, whole = table.column("text").to_pylist(), []
    keep = (~covered).tolist()
    for text, n, lost, at in zip(raw, np.diff(bounds).tolist(), removed.tolist(), bounds[:-1].tolist(), strict=True):
        words = text.split()
        whole.append(b" ".join(compress(words, keep[at : at + n]) if lost else words))
    columns = {
        "id": table.column("id"),
        "n_words": np.diff(bounds),
        "n_removed": removed,
        "kept_sha256": [hashlib.sha256(x).hexdigest() for x in whole],
    }
    if with_text:
        columns["kept"] = pa.array([k if lost else t for k, t, lost in zip(whole, raw, removed.tolist(), strict=True)], pa.binary()).cast(pa.string())
    return pa.table(columns)


def _rows_with_text(table: pa.Table, units: repeats.Units, covered: np.ndarray) -> pa.Table:
    return _rows(table, units, covered, True)


def _rows_counts(table: pa.Table, units: repeats.Units, covered: np.ndarray) -> pa.Table:
    return _rows(table, units, covered, False)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8, with_text: bool = True, hot: int = repeats.HOT) -> DataFrame:
    """Cut every word that a window of `window` words covers which also starts elsewhere in the corpus.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged.  One row per row of
    docs: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), and
    with `with_text` kept: the text as it was where nothing is cut, else the kept words
    joined by one space.  Null and empty texts have no words; texts under the window keep
    all; repeated rows are documents of their own.  Null ids pass through, other columns
    are not read, an empty table gives an empty result.
    """
    schema = f"id {B.id_type(docs, id_col)}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return repeats.marked(docs, id_col, text_col, words=True, window=window, gram=min(gram, window), decide=decide, finish=_rows_with_text if with_text else _rows_counts, schema=schema, hot=hot)
