"""Best-fit packing by exact-complement hashing.

Pieces are counted by length, so a plan depends on 2048 counts and not on how
many pieces there are.  Bins open with the longest length left.  A gap is looked
up among single lengths and sums of two and of three that are available; a
combination that fills it exactly is used as many times as counts allow.  Where
none exists the longest length that fits goes in, and the rest of the gap is
looked up again.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

#: Ranks of a length are counted in that many parts at least, and in more where pieces are many.
SALTS, MOST_SALTS, SALT_ROWS = 64, 1024, 4_000_000
END = b"\0\0\0\0"
#: Bytes of chunks, and of words within them, that a worker keeps the token numbers of; longer chunks are not kept.
CACHE_BYTES, LONG = 48 << 20, 256
SLICE_BYTES = 4 << 20
#: A capital with what may be a mark: some letters join with one in lower case only, so these texts are not folded here.
_MARKED = re.compile(rb"[A-Z][\xCC-\xFF]")
#: How a tokenizer may part texts, and what these parts are in ASCII texts in lower case.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: The same of other texts: what stands between white space and has a byte beyond ASCII stays in one piece, as it is.
_MIXED = re.compile(rb"\S*[\x80-\xFF]\S*|(?i:'s|'t|'re|'ve|'m|'ll|'d)|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+")
_TRAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Known(dict):
    """Token numbers by bytes, forgotten when they outgrow CACHE_BYTES."""

    held = 0

    def learn(self, keys: list[bytes], numbers: list[bytes]) -> None:
        self.held += sum(map(len, keys)) + sum(map(len, numbers)) + 130 * len(keys)
        self.update(zip(keys, numbers, strict=True))

    def tidy(self) -> None:
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0


class WordTokens:
    """Token numbers of texts, as little-endian 32-bit numbers.

    A tokenizer that drops white space and never joins what it parts is asked for each chunk
    between ASCII white space once; a chunk of letters and punctuation behind them is two such
    parts, and case is folded first where the tokenizer does so.  Others get whole texts.
    Where the tokenizer parts texts by _PATTERN, what is ASCII is cut into its parts here.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        letters = bytes(range(ord("a"), ord("z") + 1))
        apart = [b"ab", b"cd", b"\xc3\xa9f", b"it's", b"12", b"g", b"..."]
        whole = self._whole([b" ab\tcd \xc3\xa9f\nit's  12 g... "])[0]
        self.parts = whole == b"".join(self._whole(apart))
        self.folds = self._whole([letters]) == self._whole([letters.upper()])
        self.known, self.cores = _Known(), _Known()
        told = json.loads(self.tokenizer.to_str())
        split = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.regular = self.parts and self.folds and split.get("pattern") == {"Regex": _PATTERN} and (split["behavior"], split["invert"]) == ("Removed", True)
        added = [re.escape(x["content"].encode()) for x in told["added_tokens"]]
        self.added = re.compile(b"|".join(added) or rb"(?!)")

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        """Each part's numbers.  Words of letters alone go through together: a token that ends a word tells them apart."""
        out = [b""] * len(parts)
        texts = [p.decode("utf-8", "replace") for p in parts]
        words = [i for i, p in enumerate(parts) if p.isalpha() or not p.isascii() and _letters(texts[i])]
        rest = sorted(set(range(len(texts))).difference(words))
        for at in range(0, len(words), 256):
            group = words[at : at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in group])], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):  # a letter to us is none to the tokenizer
                rest += group
                continue
            raw, edges = ids.tobytes(), (4 * stops).tolist()
            for i, s, e in zip(group, [0, *edges[:-1]], edges, strict=True):
                out[i] = raw[s:e]
        for i, x in zip(rest, self._whole([parts[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _pieces(self, text: bytes) -> list[bytes]:
        if not self.regular or self.added.search(text):
            return text.split()
        if text.isascii():
            return _PARTS.findall(text.lower())
        return _MIXED.findall(text if _MARKED.search(text) else text.lower())

    def _split(self, chunk: bytes) -> tuple[bytes, bytes]:
        fold = bytes.lower if self.folds else bytes
        if chunk.isalpha():
            return fold(chunk), b""
        core = chunk.rstrip(_TRAIL)
        if core.isascii():
            return (fold(core), chunk[len(core) :]) if core.isalpha() else (chunk, b"")
        return (core, chunk[len(core) :]) if _letters(core.decode("utf-8", "replace")) else (chunk, b"")

    def learn(self, chunks: set[bytes]) -> None:
        self.known.tidy()
        self.cores.tidy()
        fresh = list(chunks.difference(self.known))
        if self.regular:
            plain = [c for c in fresh if c.isascii()]
            fresh = [c for c in fresh if not c.isascii()]
            self.known.learn(plain, self._encode(plain))
        split = [self._split(c) for c in fresh]
        wanted = list({p for pair in split for p in pair}.difference(self.cores))
        self.cores.learn(wanted, self._encode(wanted))
        cores = self.cores
        self.known.learn(fresh, [cores[a] + cores[b] for a, b in split])

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.parts:
            yield from (self._whole([t])[0] for t in texts)
            return
        # ASCII falls into the tokenizer's own parts, of which there are far fewer different ones than chunks.
        split = [self._pieces(t) for t in texts]
        seen: set[bytes] = set()
        for chunks in split:
            seen.update(chunks)
        long = [c for c in seen if len(c) > LONG]
        self.learn(seen.difference(long) if long else seen)
        get = self.known.__getitem__
        if long:
            odd = dict.fromkeys(long)
            get = lambda c: self._whole([c])[0] if c in odd else self.known[c]
        for chunks in split:
            yield b"".join(map(get, chunks))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """What a worker has learnt of a tokenizer, for all tasks that it runs; bounded by CACHE_BYTES."""
    return WordTokens(path)


def _letters(text: str) -> bool:
    """Letters before and after folding: some letters in lower case have a mark that joins with punctuation."""
    return text.isalpha() and text.lower().isalpha()


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths, each summing up to `size` at most, and how many bins follow each; uses all of counts."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    # Indexes of what is available: lengths themselves, sums of two and sums of three.
    out: list[tuple[list[int], int]] = []
    pairs = triples = None

    def able(parts: list[int], pattern: list[int]) -> bool:
        need = Counter(parts + pattern)
        return all(left[x] >= n for x, n in need.items())

    def complement(gap: int, pattern: list[int]) -> list[int] | None:
        nonlocal pairs, triples
        if able([gap], pattern):
            return [gap]
        a = np.arange((gap + 1) // 2, gap)
        for x in a[(left[a] > 0) & (left[gap - a] > 0)][::-1].tolist():
            if able([x, gap - x], pattern):
                return [x, gap - x]
        if pairs is None:
            there = (left > 0).astype(np.float64)
            there[0] = 0
            wave = np.fft.rfft(there, 4 * size + 4)
            pairs = np.rint(np.fft.irfft(wave**2, 4 * size + 4))[: size + 1] > 0
            triples = np.rint(np.fft.irfft(np.fft.rfft(pairs.astype(np.float64), 4 * size + 4) * wave, 4 * size + 4))[: size + 1] > 0
        if not triples[gap]:
            return None
        a = np.arange((gap + 2) // 3, gap - 1)
        for x in a[(left[a] > 0) & pairs[gap - a]][::-1].tolist():
            b = np.arange((gap - x + 1) // 2, min(x, gap - x - 1) + 1)
            for y in b[(left[b] > 0) & (left[gap - x - b] > 0)][::-1].tolist():
                if able([x, y, gap - x - y], pattern):
                    return [x, y, gap - x - y]
        return None

    while left.any():
        pattern = [int(np.flatnonzero(left)[-1])]
        while gap := size - sum(pattern):
            if exact := complement(gap, pattern):
                pattern += exact
                continue
            fit = next((x for x in np.flatnonzero(left[: gap + 1])[::-1].tolist() if able([x], pattern)), None)
            if fit is None:
                break
            pattern.append(fit)
        need = Counter(pattern)
        bins = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * bins
            if not left[x]:
                pairs = None
        out.append((pattern, bins))
    return out


def _seats(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks within a length, with the first sequence and the offset of each, by (length, rank)."""
    rows, next_rank, sequence = [], Counter(), 0
    for pattern, bins in patterns:
        offset = 0
        for length in pattern:
            rows.append((length << 44 | next_rank[length], sequence, offset))
            next_rank[length] += bins
            offset += length
        sequence += bins
    start, first, offset = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return {"start": start, "sequence": first, "offset": offset}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048) -> DataFrame:
    """Pack documents into sequences of at most `size` tokens, as few as it can.

    One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.  A document
    is its token numbers and a 0; only longer ones are cut, into pieces of `size` and a rest.
    Null and empty texts are one token.  Repeated rows are packed each; null ids pass through;
    other columns are not read; an empty table gives an empty result.
    """
    kind = B.id_type(docs, id_col)
    cut_schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = word_tokens(tokenizer_path), TaskContext.get().partitionId() << 40
        for table in B.slices(batches, "text", SLICE_BYTES):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(words.texts(table.column("text").to_pylist())):
                ids += END
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids = table.column("id").take(pa.array(row, pa.int64())).combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            columns = [ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.arange(number, number + len(row)))]
            number += len(row)
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "number"])

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    pieces = B.kept(slim.mapInArrow(cut, cut_schema + ", number long"), "pieces")
    # A piece of the full length is a sequence; the others, one a document at most, are ranked within their length.
    whole = pieces.filter(F.col("length") == size).select("id", "piece", "start", "length", "ids_crc32", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < size)
    salts = min(MOST_SALTS, max(SALTS, rest.count() // SALT_ROWS))
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(salts)).cast("int"))
    cells = rest.groupBy("length", "salt").count().collect()  # size x MOST_SALTS at most
    counts, before = Counter(), {}
    for r in sorted(cells, key=lambda r: (r["length"], r["salt"])):
        before[r["length"], r["salt"]] = counts[r["length"]]
        counts[r["length"]] += r["count"]
    seats = docs.sparkSession.sparkContext.broadcast((_seats(plan(counts, size)), before))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("number")) - 1

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, ahead = seats.value
        for batch in batches:
            length, salt = batch.column("length").to_numpy(), batch.column("salt").to_pylist()
            key = (length << 44) + batch.column("rank").to_numpy() + np.array([ahead[x] for x in zip(length.tolist(), salt, strict=True)], np.int64)
            at = np.searchsorted(told["start"], key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(told["sequence"][at] + key - told["start"][at]), pa.array(told["offset"][at])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    seated = rest.withColumn("rank", rank.cast("long")).drop("number")
    return whole.unionByName(seated.mapInArrow(seat, cut_schema + ", sequence_id long, offset long"))
