"""Suffix-array dedup: strings of a given number of bytes that start more than once are cut out everywhere.

Candidates that could repeat are brought together by repeats.py.  Over each
group of candidate texts a Burrows-Wheeler transform is built, and breadth-first
backward extension (bwt.py) derives the common prefixes of neighbouring
suffixes by increasing value.  It stops at the window's length: suffixes with no
boundary between them by then share a whole window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import bwt, repeats


def decide(texts: list[bytes], weights: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each text the runs of window starts that weigh 2 or more in all; texts stand apart behind separators."""
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)  # 0xFF is in no UTF-8 text, and becomes 0
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size + 1) - size - 1
    weight = np.repeat(np.array(weights), size + 1)
    for s, n in zip(start.tolist(), size.tolist(), strict=True):
        weight[s + n - window + 1 : s + n + 1] = 0
    found = bwt.repeated_windows(data, window, weight)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for s, e in repeats.runs_of(found):  # no window starts where a separator would cut it, so no run goes on into the next text
        i = int(np.searchsorted(start, s, "right")) - 1
        out[i].append((s - int(start[i]), e - int(start[i])))
    return out


def _cut(table: pa.Table, units: repeats.Units, covered: np.ndarray, with_text: bool) -> pa.Table:
    bounds = units.bounds
    begins = bounds[:-1][bounds[:-1] < len(covered)]
    edge = covered.copy()
    edge[1:] &= ~covered[:-1]
    edge[begins] |= covered[begins]
    removed = np.append(0, np.cumsum(covered))[bounds]
    left = units.data[~covered].tobytes()
    at = (bounds - removed).tolist()
    rest = [left[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
    columns = {
        "id": table.column("id"),
        "n_bytes": np.diff(bounds),
        "n_removed": np.diff(removed),
        "n_spans": np.diff(np.searchsorted(np.flatnonzero(edge), bounds)),
        "kept_sha256": [hashlib.sha256(x).hexdigest() for x in rest],
    }
    if with_text:
        columns["kept"] = pa.array(rest, pa.binary())
    return pa.table(columns)


def _cut_with_text(table: pa.Table, units: repeats.Units, covered: np.ndarray) -> pa.Table:
    return _cut(table, units, covered, True)


def _cut_counts(table: pa.Table, units: repeats.Units, covered: np.ndarray) -> pa.Table:
    return _cut(table, units, covered, False)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 40, with_text: bool = True, hot: int = repeats.HOT) -> DataFrame:
    """Cut every byte that a `window`-byte string covers which also starts elsewhere in the corpus.

    One row per row of docs: id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, and with `with_text` kept (binary; a cut may fall inside a character).
    Null and empty texts have no bytes; texts under the window keep all; repeated rows
    count as documents of their own, so all copies lose what they share.  Null ids pass
    through, other columns are not read, an empty table gives an empty result.
    """
    schema = f"id {B.id_type(docs, id_col)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return repeats.marked(docs, id_col, text_col, words=False, window=window, gram=min(gram, window), decide=decide, finish=_cut_with_text if with_text else _cut_counts, schema=schema, hot=hot)
