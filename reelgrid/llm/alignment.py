"""Cross-tokenizer alignment: where two tokenizers cut a text alike, and which of their tokens share a piece.

Neither tokenizer merges over the place between a character that is no white
space and a space (`Tokenizers.parts` says when that holds), so a text is cut
there into chunks, and a block of documents tokenizes and aligns each different
chunk once: ends by cumsum, common cuts by intersect1d, groups by searchsorted,
links by repeats.  Counts of documents by id pair are added up in the block,
then salted, then by pair; what comes back to a block are its own pairs.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

#: Bytes of text that a block holds about, and chunks that a worker remembers.
BLOCK_BYTES = 4 << 20
REMEMBERED = 1 << 17
#: Parts that the documents of one pair are added up in first.
SALTS = 16
#: Fixed value: the words that a byte-level BPE parts a text into.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SEP = {"a": ord(","), "|": ord("|"), ";": ord(";")}


def _byte_level() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves, the rest for 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        code = _byte_level()
        self.a_bytes = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        for name, k in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[k] = bytes(code[c] for c in name) if all(c in code for c in name) else name.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        probe = "  ﬁ① é Ａ\t  a  b "
        apart = not any("▁" in p.lstrip("▁") for p in pieces) and self.b.normalize(probe) == "▁" + probe.replace(" ", "▁")
        spec = json.loads(self.a.to_str())
        before = spec["pre_tokenizer"] or {}
        words = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and self.a.normalizer is None
        #: Whether chunks may be tokenized by themselves: the first parts words from spaces before it merges, no token of the
        #: second has a space behind another letter, and both take texts as they are.
        self.parts = apart and words
        #: The first by its ranks, which is faster by far on single words, where its ids are in the order of its merges.
        merged = [self.a.token_to_id("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"].get("merges", [])]
        ranked = self.parts and bool(merged) and merged == list(range(256, 256 + len(merged)))
        own = {b: k for k, b in enumerate(self.a_bytes) if k <= max(merged, default=-1)}
        self.ranks = tiktoken.Encoding("first", pat_str=WORDS, mergeable_ranks=own, special_tokens={}) if ranked else None
        self.a_flat, self.b_flat = _Spelt(self.a_bytes), _Spelt(self.b_bytes)
        self.known: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})  # of bytes alone, which the garbage collector leaves be

    def encode(self, chunks: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both tokenizers, 4 bytes each, for each chunk (which begins with a space)."""
        known_a, known_b = self.known
        new = [c for c in chunks if c not in known_a]
        if len(known_a) + len(new) > REMEMBERED:
            known_a, known_b = self.known = tuple({c: k[c] for c in chunks if c in k} for k in self.known)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            texts = [c.decode("utf-8", "replace") for c in part]
            first = [self.ranks.encode_ordinary(t) for t in texts] if self.ranks else [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            second = self.b.encode([t[1:] for t in texts], num_threads=1)
            for known, found in ((known_a, first), (known_b, second)):
                for c, ids in zip(part, found, strict=True):
                    known[c] = array("I", ids).tobytes()
        return [known_a[c] for c in chunks], [known_b[c] for c in chunks]


class _Spelt:
    """The bytes of all ids, end to end."""

    def __init__(self, names: list[bytes]):
        self.size = np.array([len(x) for x in names], np.int64)
        self.start, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(names), np.uint8)

    def text(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


@cache
def _tokenizers(first: str, second: str) -> Tokenizers:
    return Tokenizers(first, second)


def chunk_starts(data: np.ndarray, bounds: np.ndarray, parts: bool) -> np.ndarray:
    """Where chunks begin: at each text, and at spaces between what surely is no white space.

    data: texts end to end, each behind a space.  A byte of 0x80 or more may be part of a wide space; then the
    space before or behind it is a place to cut only if the other side is plain.
    """
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    if parts and len(data) > 2:
        plain, wide = (data > 0x20) & (data < 0x7F), data >= 0x80
        may_be_white = np.isin(data, [0xC2, 0xE1, 0xE2, 0xE3])
        behind, before = plain[2:] | (wide[2:] & ~may_be_white[2:]), plain[:-2]
        first[1:-2] |= (data[1:-1] == 0x20) & (before | (wide[:-2] & behind))
        first[bounds[1:] - 1] = False  # a space that ends a text is no chunk: behind the space that it adds the second would see nothing
        first[bounds[:-1]] = True
    return np.flatnonzero(first[:-1])


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each id with room for a separator, and which of these places are used."""
    width = len(str(max(size - 1, 0)))
    text = np.frombuffer("".join(str(k).ljust(width, "\0") for k in range(size)).encode(), np.uint8).reshape(size, width)
    text = np.hstack([text, np.full((size, 1), _SEP["a"], np.uint8)])
    return text, text > 0


class Aligned:
    """Different chunks, aligned: of each its numbers of tokens, groups and links, its groups as text, and its links."""

    def __init__(self, of: Tokenizers, data: np.ndarray, bounds: np.ndarray, found: tuple[list[bytes], list[bytes]]):
        m = len(bounds) - 1
        a, b = (np.frombuffer(b"".join(f), np.uint32).astype(np.int64) for f in found)
        self.n_a, self.n_b = (np.fromiter(map(len, f), np.int64, m) // 4 for f in found)
        self.good = self._spelt(of.a_flat, a, self.n_a, data, bounds) & self._spelt(of.b_flat, b, self.n_b, data, bounds)
        a, b = a[np.repeat(self.good, self.n_a)], b[np.repeat(self.good, self.n_b)]
        self.n_a[~self.good] = self.n_b[~self.good] = 0
        end_a, end_b = np.cumsum(of.a_flat.size[a]), np.cumsum(of.b_flat.size[b])  # bytes of good chunks agree, so both run on over chunks
        cut = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        chunk_a = np.repeat(np.arange(m), self.n_a)
        last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
        self.n_groups = np.bincount(chunk_a[last_a], minlength=m)
        # Each A token meets every B token of its group.
        fan = in_b[group_a]
        total = np.cumsum(fan)
        where = np.repeat((last_b - in_b + 1)[group_a] - (total - fan), fan) + np.arange(int(total[-1]) if len(total) else 0)
        self.link_chunk = np.repeat(chunk_a, fan)
        self.link_key = np.repeat(a, fan) << 32 | b[where]
        self.n_links = np.bincount(self.link_chunk, minlength=m)
        self.texts = self._texts(of, m, a, b, group_a, group_b, last_a, last_b, chunk_a)

    @staticmethod
    def _spelt(of: _Spelt, ids: np.ndarray, n: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which chunks the ids spell byte for byte."""
        length = np.diff(bounds)
        same = np.bincount(np.repeat(np.arange(len(n)), n), of.size[ids], len(n)).astype(np.int64) == length
        own = np.repeat(np.arange(len(n)), np.where(same, length, 0))
        same[own[of.text(ids[np.repeat(same, n)]) != data[np.repeat(same, length)]]] = False
        return same

    def _texts(self, of: Tokenizers, m: int, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, chunk_a: np.ndarray) -> list[bytes]:
        """Each chunk's groups as `a1,a2|b1`, with `;` between them."""
        digits, used = _digits(max(len(of.a_bytes), len(of.b_bytes)))
        side = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(side, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = np.concatenate([a, b])[order]
        cells = digits[ids]
        cells[place[last_a], -1] = _SEP["|"]
        cells[place[len(a) + last_b], -1] = _SEP[";"]
        text = cells[used[ids]].tobytes()
        chunk = np.concatenate([chunk_a, np.repeat(np.arange(m), self.n_b)])[order]
        size = np.bincount(chunk, used.sum(axis=1)[ids], m).astype(np.int64)
        ends = np.cumsum(size)
        return [text[e - s : e - 1] if s else b"" for s, e in zip(size.tolist(), ends.tolist(), strict=True)]


def _differing(rows: np.ndarray, values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Different (row, value) pairs, sorted; values lie under span."""
    both, _ = _ranked(rows * span + values, False)
    return both // span, both % span


def _ranked(values: np.ndarray, inverse: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """The different values, sorted, and of each value its place among them; by sorting, which is faster here than by hashing."""
    order = np.argsort(values, kind="stable") if inverse else None
    ranked = values[order] if inverse else np.sort(values)
    new = np.concatenate([np.ones(min(1, len(values)), bool), ranked[1:] != ranked[:-1]])
    if not inverse:
        return ranked[new], None
    at = np.empty(len(values), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def _zip(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.astype("<i4").tobytes(), "zstd", asbytes=True)


def _unzip(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size * 4, "zstd", asbytes=True), "<i4").astype(np.int64)


def _encoded(table: pa.Table, of: Tokenizers) -> tuple[pa.Table, dict[str, bytes], np.ndarray, np.ndarray]:
    """A block's rows without counts; which chunks each document has and which pairs each chunk; its pairs, and how many documents hold each."""
    data, bounds = B.flat(table.column("text"))
    docs, length = len(bounds) - 1, np.diff(bounds)
    spaced = np.full(len(data) + docs, 0x20, np.uint8)
    ends = bounds[1:] + np.arange(1, docs + 1)
    inside = np.ones(len(spaced), bool)
    inside[ends - length - 1] = False
    spaced[inside] = data
    edges = np.concatenate([[0], ends])
    start = chunk_starts(spaced, edges, of.parts)
    doc = np.searchsorted(ends, start, "right")
    offsets = np.concatenate([start, [len(spaced)]]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(spaced)]).dictionary_encode()
    aligned = Aligned(of, *B.flat(words.dictionary), of.encode(words.dictionary.to_pylist()))
    chunk = words.indices.to_numpy().astype(np.int64)
    whole = (np.bincount(doc, ~aligned.good[chunk], docs) == 0) & (length > 0)
    held = whole[doc]
    doc, chunk = doc[held], chunk[held]
    at = np.searchsorted(doc, np.arange(docs + 1))
    digest = []
    stream, texts = chunk.tolist(), aligned.texts
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        digest.append(hashlib.sha256(b";".join([texts[k] for k in stream[s:e]])).hexdigest() if e > s else "")

    def by_doc(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[chunk])])
        return total[at[1:]] - total[at[:-1]]

    told = pa.table({"id": table.column("id"), "n_a": by_doc(aligned.n_a), "n_b": by_doc(aligned.n_b), "n_groups": by_doc(aligned.n_groups), "n_links": by_doc(aligned.n_links), "groups_sha256": digest})
    met = np.zeros(len(aligned.good), bool)
    met[chunk] = True
    real = met[aligned.link_chunk]
    keys, pair = _ranked(aligned.link_key[real])
    link_chunk = aligned.link_chunk[real]
    # Documents of a pair: their different chunks, the chunks' different pairs, and those once a document.
    in_doc, own = _differing(doc, chunk, max(len(met), 1))
    of_chunk, one = _differing(link_chunk, pair, max(len(keys), 1))
    first, size = np.searchsorted(of_chunk, np.arange(len(met))), np.bincount(of_chunk, minlength=len(met))
    fan = size[own]
    run = np.cumsum(fan)
    where = np.repeat(first[own] - (run - fan), fan) + np.arange(int(run[-1]) if len(run) else 0)
    _, holds = _differing(np.repeat(in_doc, fan), one[where], max(len(keys), 1))
    links = np.bincount(link_chunk, minlength=len(met))
    return told, {"chunks": _zip(chunk), "docs": _zip(np.diff(at)), "links": _zip(links), "pairs": _zip(pair)}, keys, np.bincount(holds, minlength=len(keys)).astype(np.int64)


ENCODED = "block long, told binary, chunks binary, docs binary, links binary, pairs binary, keys array<long>, n array<long>"
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(own: pa.Table, told: pa.Table) -> pa.Table:
    """A block's rows with the corpus-wide counts of its pairs."""
    rows = B.from_bytes(own.column("told")[0].as_py())
    chunks, docs, links, pairs = (_unzip(own.column(c)[0].as_py()) for c in ("chunks", "docs", "links", "pairs"))
    key, count, best = (told.column(c).to_numpy() for c in ("key", "count", "best"))
    order = np.argsort(key)
    ends, at = np.cumsum(links), np.concatenate([[0], np.cumsum(docs)])

    def by_doc(value: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(value[order][pairs])])
        of_chunk = (total[ends] - total[ends - links])[chunks]
        total = np.concatenate([[0], np.cumsum(of_chunk)])
        return total[at[1:]] - total[at[:-1]]

    columns = {"n_best": by_doc(best.astype(np.int64)), "count_sum": by_doc(count.astype(np.int64))}
    return pa.table({c: rows[c] if c in rows.column_names else columns[c] for c in ["id", *(x.split()[0] for x in RESULT.split(", "))]})


def _blocks(docs: DataFrame, first: str, second: str, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, of = TaskContext.get().partitionId(), _tokenizers(first, second)
        for k, table in enumerate(B.slices(batches, "text", block_bytes)):
            told, packed, keys, n = _encoded(table, of)
            row = {"block": [part << 32 | k], "told": [B.to_bytes(told)], **{c: [v] for c, v in packed.items()}}
            arrays = [*(pa.array(v, pa.int64() if c == "block" else pa.binary()) for c, v in row.items()), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (keys, n))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in ENCODED.split(", ")])

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return B.kept(slim.mapInArrow(encode, ENCODED), "aligned")


def pair_counts(encoded: DataFrame, salts: int = SALTS) -> DataFrame:
    """key (A id << 32 | B id), count (documents that hold the pair linked), best (the highest of its A id): salted, then by pair."""
    rows = encoded.select("block", F.explode(F.arrays_zip("keys", "n")).alias("p")).select(F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), F.col("p.keys").alias("key"), F.col("p.n").alias("n"))
    count = rows.groupBy("key", "salt").agg(F.sum("n").alias("n")).groupBy("key").agg(F.sum("n").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("key", 32)))  # at most as many rows as B has ids
    return count.withColumn("best", F.col("count") == top)


def alignment(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, salts: int = SALTS) -> DataFrame:
    """Align every text's tokens under two tokenizers: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    first: a byte-level BPE (tokenizers JSON), which gets a space before the text; second: a
    sentencepiece model that adds one.  Null and empty texts, and texts that either's tokens
    do not spell byte for byte, have no tokens: zeros, and an empty string for the digest.
    Repeated rows count as documents each.  Null ids are ids like any other; other columns
    are not read; an empty table gives an empty result.  A text is never cut between tasks.
    """
    encoded = _blocks(docs, first, second, id_col, text_col, block_bytes)
    asked = encoded.select(F.col("block").alias("of"), F.explode("keys").alias("key"))
    told = asked.join(B.kept(pair_counts(encoded, salts), "pairs"), "key")
    own = encoded.drop("keys", "n")
    return own.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_counted, f"id {B.id_type(docs, id_col)}, {RESULT}")


def aligned_pairs(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, salts: int = SALTS) -> DataFrame:
    """The corpus's id pairs: a_id, b_id, documents (that hold it linked), best (no pair of that A id is in more)."""
    found = pair_counts(_blocks(docs, first, second, id_col, text_col, block_bytes), salts)
    return found.select(F.shiftright("key", 32).cast("int").alias("a_id"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), F.col("count").alias("documents"), "best")
