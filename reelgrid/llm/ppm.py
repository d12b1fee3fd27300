"""Language-model scoring by prediction by partial matching over bytes.

The trie of contexts is kept as sorted strings of symbols with counts: a node's
children are neighbours.  It is dealt out by the two symbols before the
predicted one, so each bucket holds all longer contexts with that ending, and
two small tables of fixed size serve what is shorter.  Blocks of documents
(blocks.py) hand in their counts and the strings whose probabilities they need,
and get these back in the order of the question, so the model may grow with the corpus and is never
broadcast.  Counts meet level by level, a fixed number of blocks at a time.

Escapes are estimated by the number of different symbols met in a context, half
a count each (method D), and symbols that a longer context has already offered are excluded.
Texts end with a symbol of their own, and begin behind ones that are never
predicted.  The model is pretrained: the code length of a document comes from
the counts of all training documents and does not change as it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import winnow
from .decontaminate import FOLD

ORDER = 5
BITS = 8
# Folding leaves A-Z free: two of these stand for the end and for what is before the beginning.
END, BEGIN = ord("A"), ord("B")
#: What can be predicted: 230 bytes and the end.
SYMBOLS = 256 - 26 + 1
_MASK = np.uint64((1 << BITS) - 1)
_INDEX = 64 - BITS * (ORDER + 1)
_PIECE = 1 << _INDEX
#: Blocks whose counts one task merges at a time.
FAN = 64
#: Bytes of questions to one part of the model that one task answers; where there are more, tasks share them.
ASKED_BYTES = 64 << 20

GRAM, TOKEN = 0, 1
ASK = "kind int, bucket long, block long, keys binary, n binary"
TOLD = "kind int, bucket long, block long, value binary"


def _low(order: int) -> np.uint64:
    return np.uint64((1 << BITS * (order + 1)) - 1)


def _strings(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every predicted symbol with the last ORDER symbols before it as one number, a piece of the texts at a time, so that
    only bytes are held of a whole block: the distinct numbers, for each place which of them is there, and its text."""
    each = np.diff(bounds) + ORDER + 1
    ends = np.cumsum(each)
    size = int(ends[-1]) if len(ends) else 0
    stream, inside = np.full(size, BEGIN, np.uint8), np.ones(size, bool)
    for k in range(ORDER):
        inside[ends - each + k] = False
    inside[ends - 1] = False
    stream[inside] = FOLD[data]
    stream[ends - 1] = END
    del inside
    for at in range(0, size - ORDER, _PIECE):
        part = stream[at : at + _PIECE + ORDER].astype(np.uint64)
        key = np.zeros(len(part) - ORDER, np.uint64)
        for k in range(ORDER + 1):
            key = key << np.uint64(BITS) | part[k : k + len(key)]
        real = np.flatnonzero(part[ORDER:] != BEGIN)
        key, text = key[real], np.searchsorted(ends, real + at + ORDER, "right")
        merged = np.sort(key << np.uint64(_INDEX) | np.arange(len(key), dtype=np.uint64))
        value, index = merged >> np.uint64(_INDEX), (merged & np.uint64(_PIECE - 1)).astype(np.int64)
        new = np.concatenate([[True], value[1:] != value[:-1]])
        which = np.empty(len(key), np.int64)
        which[index] = np.cumsum(new) - 1
        yield value[new], which, text


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(n, heads)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return pa.compress(np.diff(keys, prepend=np.uint64(0)).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, size * 8, "zstd", asbytes=True), np.uint64), dtype=np.uint64)


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed behind their number; counts with all first bytes together, then all second ones: most are zeros."""
    raw = values.view(np.uint8).reshape(len(values), 8).T if values.dtype == np.int64 else values
    return len(values).to_bytes(8, "little") + pa.compress(raw.tobytes(), "zstd", asbytes=True)


def _size(data: bytes) -> int:
    return int.from_bytes(data[:8], "little")


def _loosen(data: bytes, kind: type) -> np.ndarray:
    size = _size(data)
    raw = pa.decompress(data[8:], size * np.dtype(kind).itemsize, "zstd", asbytes=True)
    if kind is np.int64:
        raw = np.frombuffer(raw, np.uint8).reshape(-1, size).T.tobytes() if size else b""
    return np.frombuffer(raw, kind)


def _keys(table: pa.Table) -> list[np.ndarray]:
    return [_unpack(k, _size(n)) for k, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist(), strict=True)]


def _open(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return _keys(table), [_loosen(x, np.int64) for x in table.column("n").to_pylist()]


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class _Text:
    """A block's strings and tokens."""

    def __init__(self, payload: bytes):
        self.table = B.from_bytes(payload)
        self.data, self.bounds = B.flat(self.table.column("text"))
        self.train = self.table.column("train").to_numpy()

    def strings(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return _strings(self.data, self.bounds)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        folded = FOLD[self.data]
        start, end, of = winnow.word_spans(folded, self.bounds, winnow.WHITE)
        return winnow.word_codes(folded, start, end), np.repeat(np.arange(len(of) - 1), np.diff(of))


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
            text = _Text(payload.as_py())
            keys, counts = [], []
            for value, which, of in text.strings():
                keys.append(value)
                counts.append(np.bincount(which, text.train[of], len(value)).astype(np.int64))
            rows = []
            if keys:
                value, n = _summed(np.concatenate(keys), np.concatenate(counts))
                rows += _dealt(GRAM, block, value, n, buckets)
            code, of = text.tokens()
            value, n = _summed(code, text.train[of].astype(np.int64))
            rows += _dealt(TOKEN, block, value, n, buckets)
            yield from _rows(ASK, rows).combine_chunks().to_batches()


def _bucket(kind: int, value: np.ndarray, buckets: int) -> np.ndarray:
    spread = winnow.mix(value >> np.uint64(BITS) & _low(1) if kind == GRAM else value)
    return (spread % np.uint64(buckets)).astype(np.int64)


def _dealt(kind: int, block: int, value: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple]:
    bucket = _bucket(kind, value, buckets)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    return [(kind, b, block, _pack(value[i]), _squeeze(n[i])) for b, i in zip(found.tolist(), np.split(order, at[1:]), strict=True)] if len(value) else []


def _merge(table: pa.Table) -> pa.Table:
    """The counts of some blocks as those of one, without what no training document holds; no row where nothing is left."""
    keys, n = _open(table)
    value, total = _summed(np.concatenate(keys), np.concatenate(n))
    value, total = value[total > 0], total[total > 0]
    if not len(value):
        return _rows(ASK, [])
    first = [table.column(c)[0].as_py() for c in ("kind", "bucket", "block")]
    return _rows(ASK, [(*first, _pack(value), _squeeze(total))])


def _count(table: np.ndarray, sums: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, sums[at], 0)


class _Model:
    """Of one bucket: for orders above 1 what is counted, and the tables of orders 1 and 0 (contexts x symbols)."""

    def __init__(self, value: np.ndarray, n: np.ndarray, pairs: np.ndarray):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for order in range(ORDER, 1, -1):
            self.tables[order] = (value, n) if order == ORDER else _summed(value & _low(order), n)
        self.pairs, self.single = pairs, pairs.sum(axis=0)

    def counts(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order > 1:
            return _count(*self.tables[order], keys & _low(order))
        symbol = (keys & _MASK).astype(np.int64)
        return self.pairs[(keys >> np.uint64(BITS) & _MASK).astype(np.int64), symbol] if order else self.single[symbol]

    def _all(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total and different symbols of the keys' contexts of that order."""
        if order > 1:
            table, n = self.tables[order]
            context, total = _summed(table >> np.uint64(BITS), n)
            _, kinds = _summed(table >> np.uint64(BITS), np.ones(len(table), np.int64))
            own = (keys & _low(order)) >> np.uint64(BITS)
            return _count(context, total, own), _count(context, kinds, own)
        if order:
            own = (keys >> np.uint64(BITS) & _MASK).astype(np.int64)
            return self.pairs.sum(axis=1)[own], (self.pairs > 0).sum(axis=1)[own]
        return np.full(len(keys), self.single.sum()), np.full(len(keys), (self.single > 0).sum())

    def _excluded(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Of the context of that order, what symbols weigh that the context one longer has met."""
        if order > 0:
            table = self.tables[order + 1][0]
            context, weight = _summed(table >> np.uint64(BITS), self.counts(order, table))
            return _count(context, weight, (keys & _low(order + 1)) >> np.uint64(BITS))
        met = (self.pairs > 0) @ self.single
        return met[(keys >> np.uint64(BITS) & _MASK).astype(np.int64)]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each last symbol's probability behind the symbols before it."""
        out, open_, longer = np.zeros(len(keys)), np.ones(len(keys), bool), np.zeros(len(keys), np.int64)
        for order in range(ORDER, -1, -1):
            total, kinds = self._all(order, keys)
            n = self.counts(order, keys)
            fresh = total - (self._excluded(order, keys) if order < ORDER else 0)
            new = kinds - longer
            found, met = open_ & (n > 0), open_ & (n == 0) & (fresh > 0)
            out[found] += np.log10((n[found] - 0.5) / fresh[found])
            out[met] += np.log10(0.5 * new[met] / fresh[met])
            open_ &= ~found
            longer = kinds
        out[open_] -= np.log10(np.maximum(SYMBOLS - longer[open_], 1))
        return out


def _answer(asked: pa.Table, model: pa.Table, pairs: np.ndarray) -> pa.Table:
    if not asked.num_rows:
        return _rows(TOLD, [])
    kind = asked.column("kind")[0].as_py()
    keys, n = _open(model)
    value, count = (keys[0], n[0]) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    wanted = _keys(asked)
    distinct, at = np.unique(np.concatenate(wanted), return_inverse=True)
    told = _Model(value, count, pairs).log10(distinct) if kind == GRAM else _count(value, count, distinct)
    edges = np.cumsum([len(w) for w in wanted])[:-1]
    bucket = asked.column("bucket")[0].as_py()
    return _rows(TOLD, [(kind, bucket, b, _squeeze(told[i])) for b, i in zip(asked.column("block").to_pylist(), np.split(at, edges), strict=True)])


def _score(own: pa.Table, told: pa.Table, buckets: int, ends: int, total: int, different: int) -> pa.Table:
    text = _Text(own.column("payload")[0].as_py())
    docs = len(text.bounds) - 1

    def answers(kind: int, of: type, keys: np.ndarray) -> np.ndarray:
        """What is told of the block's keys (distinct, sorted); answers keep the order in which a bucket was asked."""
        rows = {b: v for what, b, v in zip(told.column("kind").to_pylist(), told.column("bucket").to_pylist(), told.column("value").to_pylist(), strict=True) if what == kind}
        out = np.empty(len(keys), of)
        if rows:
            out[np.argsort(_bucket(kind, keys, buckets), kind="stable")] = np.concatenate([_loosen(rows[b], of) for b in sorted(rows)])
        return out

    met = np.sort(np.concatenate([np.zeros(0, np.uint64), *(distinct for distinct, _, _ in text.strings())]))
    known = met[np.concatenate([[True], met[1:] != met[:-1]])] if len(met) else met
    del met
    value = answers(GRAM, np.float64, known)
    score = np.zeros(docs)
    for distinct, which, of in text.strings():
        score += np.bincount(of, value[np.searchsorted(known, distinct)][which], docs)
    code, of = text.tokens()
    known, at = np.unique(code, return_inverse=True)
    c = answers(TOKEN, np.int64, known)[at]
    scale = total + 0.5 * (different + 1)
    base = np.bincount(of, np.log10((c + 0.5) / scale), docs) + np.log10((ends + 0.5) / scale)
    return pa.table(
        {
            "id": text.table.column("id"),
            "held_out": text.train == 0,
            "n_tokens": np.bincount(of, minlength=docs) + 1,
            "n_known": np.bincount(of, c > 0, docs).astype(np.int64) + (ends > 0),
            "train_tokens": np.full(docs, total),
            "base_score": base,
            "score": score,
        }
    )


def ppm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", asked_bytes: int = ASKED_BYTES) -> DataFrame:
    """Score every document by a model of those for which `train` holds.

    One row per row of docs: id, held_out, n_tokens (words and one end), n_known,
    train_tokens, base_score (log10 under add-half unigrams of tokens) and score (the
    model's log10 probability of the whole text with A-Z in lower case, as bytes and an end).
    Null and empty texts are an end alone.  A null `train` is not trained on.  Without
    training documents all symbols are equally likely.  Repeated rows count and are scored
    each; other columns are not read; an empty table gives an empty result.
    """
    packed = B.packed(docs, id_col, text_col, more=[F.coalesce(train, F.lit(False)).cast("int").alias("train")])
    buckets = B.buckets_for(packed, each=1)
    blocks = packed.count()
    asked = B.kept(packed.select("block", "payload").mapInArrow(lambda it: _ask(it, buckets), ASK), "asked")
    merged, groups = asked, blocks
    while True:
        groups = -(-groups // FAN)
        merged = merged.withColumn("block", F.pmod(F.xxhash64("block"), F.lit(max(1, groups)))).groupBy("kind", "bucket", "block").applyInArrow(lambda t: _merge(t), ASK)
        if groups <= 1:
            break
    model = B.kept(merged, "model")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for kind, key, n in zip(table.column("kind").to_pylist(), *_open(table), strict=True):
                if kind == TOKEN:
                    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([int(n.sum())]), pa.array([len(n)])], ["pair", "n", "kinds"])
                else:
                    pair, total = _summed(key & _low(1), n)
                    yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(total), pa.array(np.ones(len(pair), np.int64))], ["pair", "n", "kinds"])

    pairs, words, different = np.zeros((1 << BITS, 1 << BITS), np.int64), 0, 0
    for r in model.mapInArrow(sums, "pair long, n long, kinds long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():  # 65,537 rows at most
        if r["pair"] < 0:
            words, different = r["n"], r["kinds"]
        else:
            pairs[r["pair"] >> BITS, r["pair"] & int(_MASK)] = r["n"]
    ends = int(pairs[:, END].sum())
    total, different = words + ends, different + (ends > 0)
    # A part of the model travels once, and once more for each ASKED_BYTES of questions beyond the first: rows here are all questions / ASKED_BYTES at most.
    crowds = asked.groupBy("kind", "bucket").agg(F.ceil(F.sum(F.length("keys")) / F.lit(asked_bytes)).cast("long").alias("tasks")).filter("tasks > 1").collect()
    crowds = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in crowds], "kind int, bucket long, tasks long"))
    tasks = F.coalesce("tasks", F.lit(1).cast("long"))
    copies = model.join(crowds, ["kind", "bucket"], "left").select("kind", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("salt"), "block", "keys", "n")
    questions = asked.join(crowds, ["kind", "bucket"], "left").select("kind", "bucket", F.pmod(F.xxhash64("block"), tasks).alias("salt"), "block", "keys", F.substring("n", 1, 8).alias("n"))  # their number alone; counts stay behind
    told = questions.groupBy("kind", "bucket", "salt").cogroup(copies.groupBy("kind", "bucket", "salt")).applyInArrow(lambda a, m: _answer(a, m, pairs), TOLD)
    schema = f"id {B.id_type(docs, id_col)}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.select("block", "payload").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda o, t: _score(o, t, buckets, ends, total, different), schema)
