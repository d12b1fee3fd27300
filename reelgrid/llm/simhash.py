"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints with at most 2r differing bits have a common variant
within r bits of both, and two with a common variant differ in 2r bits at most.
So every fingerprint stands for all its variants within r bits, and equal
variants mean a link.  Variants are dealt out by their leading bits: a
fingerprint goes once to each bucket that holds any of its variants, and the
bucket spells them out, slice by slice, which moves 8 bytes for many variants
and never holds more than one slice of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import components, spanning

SEED = 42
_CHUNK = 1 << 16
#: Variants that a slice spells out at once.
_SLICE = 1 << 20


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each `size` words in a row, joined by a space; of the whole sequence if it has fewer."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin = (end - length).tolist()
    end = end[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(begin, end)]  # the last words begin no shingle


def fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    """Of each text a fingerprint: bit k is 1 if over half of its shingles' hashes have it; 0 without words."""
    out = np.zeros(len(texts), np.uint64)
    weight = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    for i, text in enumerate(texts):
        found = np.array(shingle_hashes(text, size), np.uint64)
        if len(found):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(found), _CHUNK):
                ones += np.unpackbits(found[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = weight[2 * ones > len(found)].sum()
    return out


@cache
def _flips(bits: int, radius: int) -> list[np.ndarray]:
    """Masks of each number of set bits up to radius, among the low `bits`."""
    return [np.array([sum(1 << k for k in c) for c in combinations(range(bits), n)], np.uint64) for n in range(min(radius, bits) + 1)]


def _meet(value: np.ndarray, owner: np.ndarray, left: np.ndarray, bits: int, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Owners that share a variant of the low `bits` of value; left: how many bits each may still flip."""
    per = [sum(len(m) for m in _flips(bits, r)) for r in range(int(left.max()) + 1)]
    names = np.unique(owner)
    if sum(int((left == r).sum()) * n for r, n in enumerate(per)) > _SLICE or bits + len(names).bit_length() > 64:
        if bits == 0:
            found.append((names[:-1], names[1:]))
            return
        take = min(4, bits)
        rest = bits - take
        parts = []
        for n, masks in enumerate(_flips(take, int(left.max()))):
            able = np.flatnonzero(left >= n)
            for mask in masks:
                parts.append(((value[able] >> np.uint64(rest)) ^ mask, able, left[able] - n))
        bucket, able, now = map(np.concatenate, zip(*parts, strict=True))
        low = value & np.uint64((1 << rest) - 1)
        order = np.argsort(bucket, kind="stable")
        for i in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(i) > 1:
                _meet(low[able[i]], owner[able[i]], now[i], rest, found)
        return
    shift = np.uint64(len(names).bit_length())
    short = np.searchsorted(names, owner).astype(np.uint64)
    parts = []
    for r in range(len(per)):
        i = np.flatnonzero(left == r)
        if len(i):
            masks = np.concatenate(_flips(bits, r)) << shift
            parts.append(((value[i] << shift | short[i])[:, None] ^ masks[None, :]).ravel())
    merged = np.sort(np.concatenate(parts))
    same = np.flatnonzero((merged[1:] ^ merged[:-1]) >> shift == 0)
    if len(same):
        mask = np.uint64((1 << int(shift)) - 1)
        pair = np.unique((merged[same] & mask) << np.uint64(32) | (merged[same + 1] & mask))
        a, b = names[(pair >> np.uint64(32)).astype(np.int64)], names[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        found.append((a[a != b], b[a != b]))


def _bucket_links(table: pa.Table, bits: int, radius: int) -> pa.Table:
    """Links between the fingerprints of one bucket, thinned to a star for each group that they connect."""
    owner = table.column("fp").to_numpy().view(np.uint64)
    left = radius - table.column("used").to_numpy().astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    _meet(owner & np.uint64((1 << bits) - 1), owner, left, bits, found)
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))
    near = np.bitwise_count(a ^ b) <= 2 * radius
    a, b = spanning(a[near].view(np.int64), b[near].view(np.int64))
    return pa.table({"a": a, "b": b})


def fingerprint_links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b: long) that connect all distinct values of `fp` (long) within `distance` bits (even) of each other."""
    radius = distance // 2
    n = prints.count()
    lead = 4
    while lead < 24 and n * 2081 >> lead > 8 * _SLICE:
        lead += 2
    masks = [(sum(1 << k for k in c), k_used) for k_used in range(radius + 1) for c in combinations(range(lead), k_used)]
    to = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(u).alias("used")) for m, u in masks])
    dealt = prints.select("fp", F.explode(to).alias("to")).select(F.shiftrightunsigned("fp", 64 - lead).bitwiseXOR(F.col("to.mask")).alias("bucket"), "fp", F.col("to.used").alias("used"))
    return dealt.groupBy("bucket").applyInArrow(lambda t: _bucket_links(t, 64 - lead, radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """Fingerprint and group of every document: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts, and those of white space alone, have fingerprint zero and are
    linked like any other.  Repeated rows are rows of their own in the same group.  A null
    id is never smallest; a group of null ids only has a null component_id.  Other columns
    are not read; an empty table gives an empty result.  distance must be even.
    """
    if distance % 2:
        raise ValueError("the two halves of the distance have to be equal")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(texts, shingle).view(np.int64))], ["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    signed = B.kept(slim.mapInArrow(sign, f"id {B.id_type(docs, id_col)}, fp long"), "fingerprints")
    per = B.kept(signed.groupBy("fp").agg(F.min("id").alias("low")), "prints")
    root = components(fingerprint_links(per, distance))
    named = per.join(root, per["fp"] == root["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    member = named.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return signed.join(member, signed["fp"] == member["of"]).select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
