"""Toxicity by nearest labelled examples under exact TF-IDF cosine, from a block-max inverted index.

A text is the vector of all its words that the examples hold.  A word weighs its
TF-IDF times its chi-squared against the label, so that what tells the
classes apart, either way, decides who is near; no word and no example is left out.
The index holds blocks of examples: for each word its postings by block and the
largest weight in each block.  Words that many examples hold are rows of a dense
table, which a product of matrices sums up for many queries at once.  Of the others
a query sums up those that can give most until
the rest cannot lift an example from nothing to the k-th best cosine; then only
blocks whose bound still reaches that are summed to the end.  Words so rare that blocks
hold few of their postings are summed up whole.  So the neighbours are
exact.  Their labels vote by
1 / distance against the share of toxic examples as a prior.  Votes become
probabilities by a logistic curve fitted on labelled rows kept out of the index.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .decontaminate import words_of

#: Labelled rows that are learnt from at most: those with the smallest hashes of their id.
MAX_EXAMPLES = 20_000
#: Distinct words of these, summed over rows: what one task learns from and what is broadcast, 16 bytes each.
MAX_POSTINGS = 8_000_000
#: Every so many of the rows learnt from is kept out of the index, for calibration.
CALIBRATE = 5
SLICE_BYTES = 4 << 20
#: Bytes of the model in a row of its table.
MODEL_ROW = 4 << 20
#: Postings whose blocks are told apart at a time.
CHUNK = 1 << 20
#: Terms of a query that are summed up before it is asked again whether the rest matters.
TERMS = 40
#: A word that at least one in so many examples holds is a row of a table of all examples, as far as the table has this many bytes.
DENSE, DENSE_BYTES = 12, 24 << 20
#: Postings for each block that a query's words have there: with fewer, bounds of blocks cost more than they leave out.
PER_CELL = 4
#: Queries that are multiplied with that table at a time.
QUERIES = 32


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), start[1], ..."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second ones, and so on, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def _unplaned(n: int, dtype: str, raw: bytes) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(flat.T).view(dtype).reshape(n)


class BlockMaxIndex:
    """Unit vectors of examples in blocks; exact nearest neighbours by cosine."""

    def __init__(self, n_terms: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, label: np.ndarray, ids: list, width: int = 64):
        """doc, term, weight: by doc."""
        # Examples with the same strongest word stand together: bounds of blocks are then tight.
        head = np.flatnonzero(np.diff(doc, prepend=-1))
        heaviest = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, head), np.diff(np.append(head, len(doc)))))
        strongest = np.zeros(len(label), np.int64)
        strongest[doc[heaviest]] = term[heaviest]
        seat = np.lexsort((np.arange(len(label)), strongest))
        place = np.empty(len(label), np.int32)
        place[seat] = np.arange(len(label))
        self.label, self.ids = label[seat], [ids[i] for i in seat.tolist()]
        self.size, self.width, self.blocks = len(label), width, -(-len(label) // width)
        order = np.lexsort((place[doc], term))
        self.at, self.weight = place[doc[order]], weight[order].astype(np.float32)
        del order
        self._bounds(np.bincount(term, minlength=n_terms))

    def _bounds(self, postings: np.ndarray) -> None:
        """Blocks of each word and the most it weighs in them, from how many postings each word has."""
        ends = np.concatenate([[0], np.cumsum(postings)])
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], CHUNK)), len(postings))).tolist()
        start, block, bound, cells = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], np.zeros(len(postings), np.int32)
        self.top = np.zeros(len(postings), np.float32)
        for low, high in zip([0, *cuts[:-1]], cuts, strict=True):
            s, e = int(ends[low]), int(ends[high])
            if s == e:
                continue
            term, of = np.repeat(np.arange(high - low, dtype=np.int32), postings[low:high]), self.at[s:e] // self.width
            head = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])]))
            most = np.maximum.reduceat(self.weight[s:e], head)
            start.append((head + s).astype(np.int32))
            block.append(of[head].astype(np.int32))
            bound.append(most)
            cells[low:high] = np.bincount(term[head], minlength=high - low)
            np.maximum.at(self.top[low:high], term[head], most)
        self.start = np.append(np.concatenate(start), np.int32(ends[-1]))
        self.block, self.bound = np.concatenate(block), np.concatenate(bound)
        self.cells = np.concatenate([[0], np.cumsum(cells)]).astype(np.int32)
        # Words that many examples hold, from the most frequent: a product of matrices sums them up for many queries at once.
        able = np.flatnonzero(postings * DENSE >= max(self.size, 1))
        able = able[np.argsort(-postings[able], kind="stable")][: DENSE_BYTES // max(1, 8 * self.blocks * self.width)]
        self.row = np.full(len(postings), -1, np.int32)
        self.row[able] = np.arange(len(able))
        self.dense = np.zeros((len(able), self.blocks * self.width))
        for row, term in enumerate(able.tolist()):
            own = slice(int(ends[term]), int(ends[term + 1]))
            self.dense[row, self.at[own]] = self.weight[own]

    def __getstate__(self) -> dict:
        """What the rest follows from: postings of each word, steps between their places, and weights, in compressed bytes."""
        step = np.diff(self.at, prepend=np.int32(0))
        postings = np.diff(self.start[self.cells])
        slim = {c: self.__dict__[c] for c in ("label", "ids", "size", "width", "blocks")}
        return slim | {"packed": [(len(x), str(x.dtype), _planes(x)) for x in (postings, step, self.weight)]}

    def __setstate__(self, state: dict) -> None:
        postings, step, self.weight = (_unplaned(*x) for x in state.pop("packed"))
        self.__dict__.update(state)
        self.at = np.cumsum(step, dtype=np.int32)
        self._bounds(postings)

    def frequent(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """Of each text (doc: from 0) and example what the words of `dense` give."""
        row = self.row[term]
        some = row >= 0
        own = np.zeros((texts, len(self.dense)))
        own[doc[some], row[some]] = weight[some]
        return own @ self.dense

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k best examples over 0; of equals the first.  sums: what `frequent` tells of the text, changed here."""
        if sums is None:
            sums = self.frequent(np.zeros(len(term), np.int64), term, weight, 1)[0]
        rare = self.row[term] < 0
        term, weight = term[rare], weight[rare]
        first = self.start[self.cells[term]]
        count, least = self.start[self.cells[term + 1]] - first, 0.0
        if count.sum() < PER_CELL * (self.cells[term + 1] - self.cells[term]).sum():
            post = _ranges(first, count)
            sums += np.bincount(self.at[post], np.repeat(weight, count) * self.weight[post], len(sums))
            if k < self.size:
                least = max(0.0, np.partition(sums, len(sums) - k)[len(sums) - k])
        else:
            least = self._by_blocks(term, weight, k, sums)
        there = np.flatnonzero(sums >= least - 1e-9) if least > 0 else np.flatnonzero(sums)
        best = there[np.lexsort((there, -sums[there]))[:k]]
        return best, sums[best]

    def _by_blocks(self, term: np.ndarray, weight: np.ndarray, k: int, sums: np.ndarray) -> float:
        """Add what words give to sums, but for examples that cannot reach the k-th best; a bound from below of that one's sum."""
        most = weight * self.top[term]
        order = np.argsort(-most, kind="stable")[: np.count_nonzero(most)]
        term, weight, most = term[order], weight[order], most[order]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what terms from here on can add at most
        place, value = self.at, self.weight
        least = max(0.0, np.partition(sums, len(sums) - k)[len(sums) - k]) if k < self.size else 0.0
        first, end = self.start[self.cells[term]].tolist(), self.start[self.cells[term + 1]].tolist()
        at = 0
        while at < len(term) and (rest[at] >= least or not least):
            upto = min(at + TERMS, len(term))
            lists = [slice(s, e) for s, e in zip(first[at:upto], end[at:upto], strict=True)]
            # Places and weights stay narrow in the index and are widened as they are put end to end.
            where = np.concatenate([place[x] for x in lists], dtype=np.int64)
            gives = np.concatenate([value[x] * w for x, w in zip(lists, weight[at:upto], strict=True)])
            sums += np.bincount(where, gives, len(sums))
            at = upto
            if k < self.size:
                least = max(least, np.partition(sums, len(sums) - k)[len(sums) - k])
        if at < len(term):
            # No new example can come in: only blocks that still reach the k-th best are looked at further.
            able = sums.reshape(self.blocks, self.width).max(axis=1) + rest[at] >= least - 1e-9
            n = self.cells[term[at:] + 1] - self.cells[term[at:]]
            cell, own = _ranges(self.cells[term[at:]], n), np.repeat(weight[at:], n)
            some = able[self.block[cell]]
            cell, own = cell[some], own[some]
            block = self.block[cell]
            able = sums.reshape(self.blocks, self.width).max(axis=1) + np.bincount(block, own * self.bound[cell], self.blocks) >= least - 1e-9
            some = able[block]
            start = self.start[cell[some]]
            count = self.start[cell[some] + 1] - start
            post = _ranges(start, count)
            sums += np.bincount(place[post], np.repeat(own[some], count) * value[post], len(sums))
            sums.reshape(self.blocks, self.width)[~able] = 0
        return least


class Votes:
    """Scores texts by the index; all that goes to executors, bounded by MAX_POSTINGS."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, share: float, k: int):
        self.terms, self.weight, self.share, self.k = terms, weight, share, k
        self.index: BlockMaxIndex | None = None
        self.curve: tuple[float, float] | None = None

    def vectors(self, doc: np.ndarray, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts' distinct words (by text) and their counts, the known ones: text, word number and unit weight."""
        term = np.minimum(np.searchsorted(self.terms, code), len(self.terms) - 1)
        known = self.terms[term] == code
        return self.weighed(doc[known], term[known], count[known])

    def weighed(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As vectors, of words by their numbers."""
        weight = self.weight[term]
        weight *= 1 + np.log(count)
        some = weight > 0
        if not some.all():
            doc, term, weight = doc[some], term[some], weight[some]
        weight /= np.sqrt(np.bincount(doc, weight * weight))[doc]
        return doc, term, weight

    def votes(self, doc: np.ndarray, code: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, list[list]]:
        """Of each text the vote of its neighbours (NaN without any), and the ids of up to five of them."""
        out, evidence = np.full(texts, np.nan), [[] for _ in range(texts)]
        if self.index is None or not len(code):
            return out, evidence
        doc, term, weight = self.vectors(doc, code, count)
        edges = np.searchsorted(doc, np.arange(texts + 1)).tolist()
        for d, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if not d % QUERIES:
                upto = edges[min(d + QUERIES, texts)]
                sums = self.index.frequent(doc[s:upto] - d, term[s:upto], weight[s:upto], min(QUERIES, texts - d))
            if s == e:
                continue
            near, cosine = self.index.nearest(term[s:e], weight[s:e], self.k, sums[d % QUERIES])
            if len(near):
                pull = 1 / (1.05 - np.minimum(cosine, 1))
                out[d] = (pull @ self.index.label[near] + self.share) / (pull.sum() + 1)
                evidence[d] = [self.index.ids[i] for i in near[:5]]
        return out, evidence

    def calibrate(self, vote: np.ndarray, label: np.ndarray) -> None:
        """Fit the curve; left out where the rows are of one class."""
        told = ~np.isnan(vote)
        x, y = _logit(vote[told]), label[told]
        if not 0 < y.sum() < len(y):
            return
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        rows, at = np.stack([np.ones(len(x)), x]), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-at @ rows))
            step = np.linalg.solve((rows * (p * (1 - p))) @ rows.T + 1e-6 * np.eye(2), rows @ (goal - p) - 1e-6 * at)
            at = at + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.curve = (float(at[0]), max(float(at[1]), 0.0))

    def score(self, code: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list[list]]:
        distinct, at = np.unique(code, return_inverse=True)
        doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
        pair, count = np.unique(doc * max(1, len(distinct)) + at, return_counts=True)
        vote, evidence = self.votes(pair // max(1, len(distinct)), distinct[pair % max(1, len(distinct))], count, len(of) - 1)
        score = vote if self.curve is None else 1 / (1 + np.exp(-self.curve[0] - self.curve[1] * _logit(vote)))
        return np.where(np.isnan(vote), self.share, score), evidence


def _logit(vote: np.ndarray) -> np.ndarray:
    return np.log(vote + 1e-3) - np.log(1 - vote + 1e-3)


def _learn(held: dict, k: int) -> Votes:
    """Words, weights, index and curve from the examples' distinct words (code, count; size for each example), label and ids.

    Takes code and count out of `held`, so that they are held once.
    """
    label, ids = held["label"], held["ids"]
    inside = np.arange(len(label)) % CALIBRATE != CALIBRATE - 1
    if not (label[inside].any() and (label[inside] == 0).any()):
        inside[:] = True  # all of one class: nothing to calibrate by
    seat = np.where(inside, np.cumsum(inside), np.cumsum(~inside)).astype(np.int32) - 1
    here, doc = np.repeat(inside, held["size"]), np.repeat(seat, held["size"])
    code, count = held.pop("code"), held.pop("count")
    apart = doc[~here], code[~here], count[~here]
    doc, code, count = doc[here], code[here], count[here]
    del here
    terms = np.unique(code)
    term = np.searchsorted(terms, code).astype(np.int32)
    del code
    total, toxic = int(inside.sum()), float(label[inside].sum())
    n = np.bincount(term, minlength=len(terms)).astype(np.float64)
    bad = np.bincount(term, label[inside][doc], len(terms))
    spread = n * (total - n) * toxic * (total - toxic)
    chi2 = np.divide(total * (bad * (total - n) - (toxic - bad) * (n - bad)) ** 2, spread, out=np.zeros(len(n)), where=spread > 0)
    votes = Votes(terms, np.log((1 + total) / n) * chi2, toxic / total if total else 0.0, k)
    if not votes.weight.any():
        return votes
    doc, term, weight = votes.weighed(doc, term, count)
    del count
    votes.index = BlockMaxIndex(len(terms), doc, term, weight.astype(np.float32), label[inside], [ids[i] for i in np.flatnonzero(inside).tolist()])
    del doc, term, weight
    votes.calibrate(votes.votes(*apart, int((~inside).sum()))[0], label[~inside])
    return votes


class Model:
    """Votes as bytes, unpacked where texts are scored."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def __getstate__(self) -> dict:
        return {"raw": self.raw}

    @cached_property
    def votes(self) -> Votes:
        found = pickle.loads(self.raw)
        self.raw = b""
        return found


def _learnt(batches: Iterator[pa.RecordBatch], k: int) -> Votes:
    """The model of examples in order, each with label, id, codes and counts of its distinct words."""
    label, ids, code, count = [np.zeros(0)], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    size = [np.zeros(0, np.int64)]
    for batch in batches:
        label.append(batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64))
        ids += batch.column("id").to_pylist()
        codes, of = B.flat(batch.column("codes"))
        size.append(np.diff(of) // 8)
        code.append(np.frombuffer(codes.tobytes(), np.uint64))
        count.append(np.frombuffer(B.flat(batch.column("counts"))[0].tobytes(), np.int32))
    held = {"label": np.concatenate(label), "ids": ids, "size": np.concatenate(size), "count": np.concatenate(count)}
    del count
    held["code"] = np.concatenate(code)
    del code
    return _learn(held, k)


def model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, k: int, max_examples: int, max_postings: int = MAX_POSTINGS) -> Model:
    """Learn from at most max_examples labelled rows, and so many of them that their distinct words are max_postings at most.

    One task learns, as the examples are bounded; the driver passes the model's bytes on without unpacking them.
    Several labels of an id count as toxic if any is; of several documents of an id the smallest text counts.
    """
    told = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    drawn = told.orderBy(F.xxhash64("id"), "id").limit(max_examples)
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    examples = text.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # the broadcast: max_examples rows of two numbers

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.slices(batches, "text", SLICE_BYTES):
            _, _, code, of = words_of(*B.flat(table.column("text")))
            found = [np.unique(code[s:e], return_counts=True) for s, e in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]
            own = [table.column(c).combine_chunks() for c in ("id", "label")]
            own = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in own]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(c) for c, _ in found], pa.int64()), pa.array([c.tobytes() for c, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())], ["id", "label", "size", "codes", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pickle.dumps(_learnt(batches, k), pickle.HIGHEST_PROTOCOL)
        for part, at in enumerate(range(0, len(raw), MODEL_ROW)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw[at : at + MODEL_ROW]], pa.binary())], ["part", "raw"])

    kept = B.kept(examples.mapInArrow(vectorise, f"id {B.id_type(docs, id_col)}, label int, size long, codes binary, counts binary"), "examples").withColumn("hash", F.xxhash64("id"))
    size = kept.select("hash", "id", "size").orderBy("hash", "id").toArrow()  # max_examples rows of three numbers
    fits = int(np.searchsorted(np.cumsum(size.column("size").to_numpy()), max_postings, "right"))
    if not fits:
        return Model(pickle.dumps(_learnt(iter(()), k)))
    last = F.struct(*(F.lit(size.column(c)[fits - 1].as_py()).cast(kept.schema[c].dataType).alias(c) for c in ("hash", "id")))
    chosen = kept.filter(F.struct("hash", "id") <= last).drop("size").repartition(1).sortWithinPartitions("hash", "id")
    parts = B.kept(chosen.mapInArrow(learn, "part int, raw binary"), "model").toLocalIterator()
    return Model(b"".join(r["raw"] for r in sorted(parts, key=lambda r: r["part"])))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, k: int, max_examples: int, max_postings: int = MAX_POSTINGS) -> Votes:
    """The model, unpacked."""
    return model(docs, labels, id_col, text_col, label_col, k, max_examples, max_postings).votes


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", k: int = 15, threshold: float = 0.7, max_examples: int = MAX_EXAMPLES, with_row: bool = False) -> DataFrame:
    """Score every document: id, score (0 to 1), predicted (score >= threshold), evidence (ids of up to five nearest examples).

    With `with_row` also row: the document's own columns, as ids need not tell rows apart.

    Null and empty texts, and texts without any word of an example, score as the share of toxic
    examples.  Without labelled rows all score 0; with rows of one class only, that class's
    share.  Repeated rows are scored each; labels without a document, null labels and null ids
    teach nothing.  Of equally near examples those that stand first in the index count.  No
    other column is read.
    """
    votes = docs.sparkSession.sparkContext.broadcast(model(docs, labels, id_col, text_col, label_col, k, max_examples))  # bounded by MAX_POSTINGS
    kind = B.id_type(docs, id_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.slices(batches, "text", SLICE_BYTES):
            _, _, code, of = words_of(*B.flat(table.column("text")))
            found, evidence = votes.value.votes.score(code, of)
            ids = table.column("id").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            own = [table.column("row").combine_chunks()] if with_row else []
            own = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in own]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found), pa.array((found >= threshold).astype(np.int32)), pa.array(evidence, pa.list_(ids.type)), *own], ["id", "score", "predicted", "evidence", "row"][: 4 + with_row])

    whole = [F.struct(*docs.columns).alias("row")] if with_row else []
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *whole)
    return slim.mapInArrow(score, f"id {kind}, score double, predicted int, evidence array<{kind}>" + (f", row {B.id_type(slim, 'row')}" if with_row else ""))
