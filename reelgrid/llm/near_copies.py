"""Near copies by word shingles: every pair of texts whose sets of shingles have a given Jaccard similarity.

Put the shingles of all sets in one order.  Two sets of similarity t or more
share a shingle among the first n - ceil(t n) + 1 of each, n being the set's
size; so texts that meet under one of these are all the candidates there can
be, whatever the order.  Shingles that a sample of the texts holds often come
last, which keeps candidates few.  Texts that only share a passage are most of
them; a parity sketch of each set, a bit or two for a shingle, bounds from below
how many shingles are in one set only and rules them out without their texts.
Every candidate left is verified by the sets of its two texts.

SimHash goes first: texts whose fingerprints of the same shingles link (simhash.py), and
texts 1, 2, 4, ... places apart by size under a shared shingle, are verified, which takes n log n
pairs for n texts under it and connects most families of near copies.  SimHash alone cannot do: texts
of similarity 0.8 differ in about ten of 64 bits, and variants within five bits are over
eight million.  So all candidates as above follow, but only between groups that are still apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import winnow
from .components import components
from .decontaminate import FOLD
from .simhash import fingerprint_links, fingerprints

SLICE_BYTES = 4 << 20
#: Bytes of text whose candidates' shingles one bucket holds, about.
BUCKET_BYTES = 64 << 20
#: Text of a group of candidates that is verified in one piece at most, about.
GROUP_BYTES = 32 << 20
#: Texts that are looked through for frequent shingles, in how many of them these stand, and how many are noted at most.
SAMPLE, OFTEN, NOTED = 20_000, 4, 200_000
#: Pairs that a bucket looks at or gathers before it goes on or drops repeated ones.
_PAIRS = 1 << 20
#: Bytes of a sketch that go to a bucket with a text's shingles, at most.
NARROW = 128
#: What of a slice of texts goes to a bucket: shingles, and how many of them, name, size, group and sketch of each text.
DEALT = ["bucket", "keys", "counts", "nodes", "sizes", "roots", "widths", "sketches"]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's `size` words in a row (of all its words if fewer), by text and hash; the texts' bounds."""
    folded = FOLD[data]
    start, end, of = winnow.word_spans(folded, bounds, winnow.WHITE)
    codes, n = winnow.word_codes(folded, start, end), np.diff(of)
    stop = np.repeat(of[1:], n)
    begins = np.arange(len(codes)) + size <= stop
    begins[of[:-1][n > 0]] = True
    first = np.flatnonzero(begins)
    found = winnow.span_hash(winnow.prefix_sums(codes), first, np.minimum(first + size, stop[first]))
    doc = np.repeat(np.arange(len(n)), n)[first]
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def _frequent(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles that stand often in a sample of the texts, by hash, and their ranks from the rarest: two rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.slices(batches, "text", SLICE_BYTES):
            found, n = np.unique(shingle_sets(*B.flat(table.column("text")), size)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    share = SAMPLE / max(1, texts.count())
    some = texts if share >= 1 else texts.sample(share, seed=42)
    often = some.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    told = often.orderBy(F.desc("n"), "hash").limit(NOTED).toArrow()
    key = told.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return np.stack([key, np.arange(len(key), 0, -1).astype(np.uint64)])[:, order]


def parity_sketch(found: np.ndarray) -> bytes:
    """A bit for each of a power of two of cells, as many as there are hashes or more: whether an odd number of them fall there."""
    cells = max(64, 1 << max(0, len(found) - 1).bit_length())
    cell = (found * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) & np.uint64(cells - 1)
    return np.packbits(np.bincount(cell.astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """The same sketches with fewer cells: a cell's place is the low bits of one number, so halves lie over each other."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_be_near(table: pa.Table, similarity: float) -> np.ndarray:
    """Which pairs (sketch_a, size_a, sketch_b, size_b) their sketches do not rule out.

    Each cell in which two sketches differ takes a shingle that is in one set only, as do sizes that differ, and sets of
    sizes m and n have the similarity t exactly if at most (m + n)(1 - t)/(1 + t) are.
    """
    least = np.zeros(table.num_rows, np.int64)
    a, b = (table.column(f"sketch_{x}").to_pylist() for x in "ab")
    wide = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for m, n in np.unique(wide, axis=0).tolist():
        at = np.flatnonzero((wide == (m, n)).all(axis=1))
        x, y = (np.frombuffer(b"".join(some[k] for k in at.tolist()), np.uint8).reshape(len(at), w) for some, w in ((a, m), (b, n)))
        least[at] = np.bitwise_count(_folded(x, min(m, n)) ^ _folded(y, min(m, n))).sum(axis=1, dtype=np.int64)
    m, n = table.column("size_a").to_numpy(), table.column("size_b").to_numpy()
    return np.maximum(least, np.abs(m - n)) <= (m + n) * (1 - similarity) / (1 + similarity) + 1e-6


def linking(a: list[int], b: list[int], near: Callable[[int, int], bool]) -> list[int]:
    """Places of near pairs that connect what all near pairs connect; a pair is looked at only if those before leave it apart."""
    over: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := over.get(x, x)) != x:
            over[x] = x = over.get(up, up)
        return x

    found = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        left, right = top(x), top(y)
        if left != right and near(x, y):
            over[max(left, right)] = min(left, right)
            found.append(k)
    return found


def narrow(sketch: bytes) -> bytes:
    """The sketch with NARROW bytes at most: it rules out less, but never a near pair."""
    return _folded(np.frombuffer(sketch, np.uint8)[None], NARROW).tobytes()


class _Met:
    """What met in a bucket: shingle `key`, place `at` of the text among names, `size` and `root` (group), once each, by shingle and group."""

    def __init__(self, table: pa.Table):
        kinds = {"keys": np.uint64, "counts": np.int32, "nodes": np.int64, "sizes": np.int64, "roots": np.int64}
        key, count, node, size, root = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in kinds.items())
        self.names, first, at = np.unique(node, return_index=True, return_inverse=True)
        at, size, root = (np.repeat(x, count) for x in (at, size, root))
        order = np.lexsort((at, size, root, key))
        key, at = key[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        self.key, self.at, self.size, self.root = key[new], at[new], size[order][new], root[order][new]
        width = np.frombuffer(b"".join(table.column("widths").to_pylist()), np.int32).astype(np.int64)
        raw, begin = np.frombuffer(b"".join(table.column("sketches").to_pylist()), np.uint8), (np.cumsum(width) - width)[first]
        self.width = width[first]
        self.row, self.folds = np.zeros(len(first), np.int64), {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            wide = raw[begin[own][:, None] + np.arange(w)]
            while w >= 8:
                self.folds[len(wide[0]), w] = np.ascontiguousarray(_folded(wide, w)).view(np.uint64)
                w //= 2

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many shingles are in one of the texts a and b only, at least."""
        out, kind = np.zeros(len(a), np.int64), self.width[a].astype(np.int64) << 16 | self.width[b]
        for k in np.unique(kind).tolist():
            m, n = k >> 16, k & 0xFFFF
            some = np.flatnonzero(kind == k)
            x, y = self.folds[m, min(m, n)][self.row[a[some]]], self.folds[n, min(m, n)][self.row[b[some]]]
            out[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out

    def able(self, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
        """Pairs, as one number each, of the texts at left and right that sizes and sketches do not rule out (as in may_be_near)."""
        x, y = self.size[left], self.size[right]
        most = (x + y) * (1 - similarity) / (1 + similarity) + 1e-6
        some = np.flatnonzero(np.abs(x - y) <= most)
        some = some[self.differ(self.at[left[some]], self.at[right[some]]) <= most[some]]
        a, b = self.at[left[some]], self.at[right[some]]
        return np.minimum(a, b) << 32 | np.maximum(a, b)

    def pairs(self, parts: list[np.ndarray]) -> pa.Table:
        pair = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]))
        return pa.table({"a": self.names[pair >> 32], "b": self.names[pair & 0xFFFFFFFF]})


def _neighbours(table: pa.Table, similarity: float) -> pa.Table:
    """Pairs of texts that stand 1, 2, 4, ... places apart by size under a shingle of a bucket and that neither sizes nor sketches rule out."""
    met = _Met(table)
    parts, step, live = [], 1, np.arange(len(met.key))
    while len(live := live[live + step < len(met.key)]):
        live = live[met.key[live] == met.key[live + step]]
        for low in range(0, len(live), _PAIRS):
            parts.append(met.able(live[low : low + _PAIRS], live[low : low + _PAIRS] + step, similarity))
        step *= 2
    return met.pairs(parts)


def _across(table: pa.Table, similarity: float) -> pa.Table:
    """Pairs of texts of different groups that meet under a shingle of a bucket and that neither sizes nor sketches rule out."""
    met = _Met(table)
    n = len(met.key)
    if not n:
        return met.pairs([])
    first = np.ones(n, bool)
    first[1:] = met.key[1:] != met.key[:-1]
    own = first.copy()
    own[1:] |= met.root[1:] != met.root[:-1]
    # By group within a shingle: a text meets all that stand behind its own group.
    begin, end = (np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1] for new in (own, first))
    upto, parts, held, low = np.cumsum(end - begin), [], 0, 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + _PAIRS, "right")))
        count = (end - begin)[low:high]
        left = np.repeat(np.arange(low, high), count)
        right = np.arange(len(left)) + np.repeat(begin[low:high] - np.cumsum(count) + count, count)
        parts.append(met.able(left, right, similarity))
        held += len(parts[-1])
        if held > _PAIRS:
            parts, held = [np.unique(np.concatenate(parts))], 0
        low = high
    return met.pairs(parts)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 4, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs with one row of each group of near copies, all columns as they are.

    Texts link if the sets of their shingles (`shingle` words in a row, A-Z folded; all words
    of a shorter text) have the Jaccard similarity or more, and a group is what links connect.
    Of a group the row with the smallest id stays, a null id only where there is no other, and
    of equal ids one.  Null and empty texts and those of white space alone are copies of each
    other.  Sets and shingles are told apart by 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs.select(text), shingle))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, ranks = frequent.value
        part = TaskContext.get().partitionId()
        row = part << 40
        for table in B.slices(batches, "text", SLICE_BYTES):
            found, of = shingle_sets(*B.flat(table.column("text")), shingle)
            n = np.diff(of)
            rank = np.zeros(len(found), np.int64)
            if len(often):
                place = np.minimum(np.searchsorted(often, found), len(often) - 1)
                rank = np.where(often[place] == found, ranks[place], 0).astype(np.int64)
            first = found[np.lexsort((found, rank, np.repeat(np.arange(len(n)), n)))]
            take = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
            bounds = of.tolist()
            nodes = np.array([xxhash.xxh3_64_intdigest(found[s:e].tobytes()) for s, e in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64).view(np.int64)
            keys = [first[s : s + k].tobytes() for s, k in zip(bounds[:-1], take.tolist(), strict=True)]
            sketches = [parity_sketch(found[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            length = np.diff(B.flat(table.column("text"))[1])
            own = [pa.array(np.full(len(n), part)), pa.array(np.arange(row, row + len(n))), pa.array(nodes), pa.array(n.astype(np.int64)), pa.array(length)]
            prints = fingerprints(table.column("text").to_pylist(), shingle).view(np.int64)
            own += [pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(prints)]
            row += len(n)
            rest = table.column("kept").combine_chunks()
            rest = rest.chunk(0) if isinstance(rest, pa.ChunkedArray) else rest
            yield pa.RecordBatch.from_arrays([*own, rest], ["part", "row", "node", "size", "bytes", "keys", "sketch", "fp", "kept"])

    whole = docs.select(text, F.struct(*docs.columns).alias("kept"))
    # Dealt into files by the task that wrote a row: what is known of rows later goes to their texts, which stay where they are.
    columns = f"part long, row long, node long, size long, bytes long, keys binary, sketch binary, fp long, kept {whole.schema['kept'].dataType.simpleString()}"
    signed = B.kept_by(whole.mapInArrow(sign, columns), "signed", "part")

    def beside(told: DataFrame, *columns: str | Column) -> DataFrame:
        """Columns of signed, and `told` (row, and `value`, null if a row has none) as an array of a part's rows, `value` of the row in it."""
        of_part = signed.select("part", "row").join(told, "row", "left").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("row", "value"))).alias("told"))
        at = F.col("row").bitwiseAND(F.lit((1 << 40) - 1)).cast("int") + 1
        rows = signed.select("part", "row", *columns)
        return rows.join(of_part.hint("shuffle_hash"), "part").select(*rows.columns[2:], F.element_at("told", at)["value"].alias("value"))

    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(16, total // BUCKET_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.slices(batches, "keys", SLICE_BYTES):
            key = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
            count = np.diff(B.flat(table.column("keys"))[1]) // 8
            own = [table.column(c).to_numpy() for c in ("node", "size", "root")]
            sketch = [narrow(x) for x in table.column("sketch").to_pylist()]
            text = np.repeat(np.arange(len(count)), count)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            rows = []
            for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if s < e:
                    some, n = np.unique(text[order[s:e]], return_counts=True)
                    there = [sketch[i] for i in some.tolist()]
                    wide = np.array([len(x) for x in there], np.int32)
                    rows.append((k, key[order[s:e]].tobytes(), n.astype(np.int32).tobytes(), *(x[some].tobytes() for x in own), wide.tobytes(), b"".join(there)))
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64() if c == "bucket" else pa.binary()) for c, x in zip(DEALT, zip(*rows, strict=True) if rows else [()] * len(DEALT), strict=True)})

    def meeting(rows: DataFrame, pairs_of: Callable[[pa.Table, float], pa.Table]) -> DataFrame:
        """Pairs among rows (node, size, root, keys, sketch) that meet under a key."""
        dealt = rows.mapInArrow(deal, ", ".join(f"{c} {'long' if c == 'bucket' else 'binary'}" for c in DEALT))
        return dealt.groupBy("bucket").applyInArrow(lambda t: pairs_of(t, similarity), "a long, b long")

    def not_ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.slices(batches, "sketch_a", SLICE_BYTES):
            yield from table.select(["a", "b"]).filter(pa.array(may_be_near(table, similarity))).to_batches()

    sketch = B.kept(signed.select("node", "size", "sketch").dropDuplicates(["node"]), "sketches")
    of_a, of_b = (sketch.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")

    def meet(pair: pa.Table, told: pa.Table) -> pa.Table:
        if not pair.num_rows:
            return pair.select(["a", "b"])
        found, of = shingle_sets(*B.flat(told.column("text")), shingle)
        node = told.column("node").to_numpy()
        order = np.argsort(node)
        a, b = (order[np.searchsorted(node[order], pair.column(c).to_numpy())].tolist() for c in ("a", "b"))
        bounds = of.tolist()

        def near(x: int, y: int) -> bool:
            both = np.sort(np.concatenate([found[bounds[x] : bounds[x + 1]], found[bounds[y] : bounds[y + 1]]]))
            n = int((both[1:] == both[:-1]).sum())
            return n >= similarity * (len(both) - n) - 1e-9

        return pair.select(["a", "b"]).take(pa.array(linking(a, b, near), pa.int64()))

    def verified(met: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are near, but for pairs that others have connected before them."""
        pairs = B.kept(met.distinct().join(of_a, "a").join(of_b, "b").mapInArrow(not_ruled_out, "a long, b long"), "pairs")
        # Texts that candidates connect meet in one task, once each.  A group too large for that is cut into parts by the
        # hash of a text; a pair goes to the tile of its two parts, and a text once to each tile where it has a pair.
        asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        home = asked.join(components(pairs).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("home"))
        one = B.kept(signed.select("row", "node", "bytes").join(home, "node").groupBy("node", "home").agg(F.min("row").alias("row"), F.min("bytes").alias("bytes")), "homes")
        large = one.groupBy("home").agg(F.sum("bytes").alias("total")).filter(F.col("total") > group_bytes).select("home", F.ceil(2 * F.col("total") / max(1, group_bytes)).alias("parts"))
        part = one.join(large, "home", "left").select("node", "row", "bytes", "home", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).alias("part"))
        left, right = (part.select(F.col("node").alias(x), "home", F.col("part").alias(f"part_{x}"), F.col("row").alias(f"row_{x}"), F.col("bytes").alias(f"bytes_{x}")) for x in "ab")
        tile = F.xxhash64("home", F.least("part_a", "part_b"), F.greatest("part_a", "part_b")).alias("tile")
        placed = B.kept(pairs.join(left, "a").join(right.drop("home"), "b").select("a", "b", tile, *(f"{c}_{x}" for c in ("row", "bytes") for x in "ab")), "placed")
        called = placed.select(F.explode(F.array(*(F.struct(F.col(x).alias("node"), F.col(f"row_{x}").alias("row"), F.col(f"bytes_{x}").alias("bytes")) for x in "ab"))).alias("text"), "tile").select("text.*", "tile").distinct()
        tasks = max(16, (called.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES)
        bucket = F.pmod(F.xxhash64("tile"), F.lit(tasks)).alias("bucket")
        body = F.coalesce(F.col(f"kept.`{text_col}`").cast("binary"), F.lit(b"")).alias("text")
        wanted = called.groupBy("row").agg(F.collect_set(bucket).alias("value"))
        told = beside(wanted, "node", body).select(F.explode("value").alias("bucket"), "node", "text").groupBy("bucket")
        met = placed.select(bucket, "a", "b").groupBy("bucket").cogroup(told)
        return B.kept(met.applyInArrow(lambda pair, told: meet(pair, told), "a long, b long"), "near")

    # First SimHash, and some neighbours by size under each shingle, which connect most families.
    prints = B.kept(signed.groupBy("fp").agg(F.min("node").alias("lead")), "prints")
    leads = [prints.select(F.col("fp").alias(x), F.col("lead").alias(f"lead_{x}")) for x in "ab"]
    alike = fingerprint_links(prints, distance).join(leads[0], "a").join(leads[1], "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    equal = signed.select("node", "fp").join(prints, "fp").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    bare = signed.select("node", "size", F.lit(0).cast("long").alias("root"), "keys", "sketch")
    met = alike.unionByName(equal).unionByName(meeting(bare, _neighbours))
    some = verified(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    # Then all that meet under a shingle and that the links so far leave apart.
    group = components(some).withColumnRenamed("node", "of")
    apart = sketch.select("node").join(group, F.col("node") == F.col("of"), "left").select(F.col("node").alias("of"), F.coalesce("root", "node").alias("root"))
    once = signed.select("node", "size", "keys", "sketch").dropDuplicates(["node"])
    links = some.unionByName(verified(meeting(once.join(apart, F.col("node") == F.col("of")).select("node", "size", "root", "keys", "sketch"), _across)))
    root = components(links).withColumnRenamed("node", "of")
    member = signed.select("row", "node", F.col(f"kept.`{id_col}`").alias("id")).join(root, F.col("node") == F.col("of"), "left")
    least = F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"]
    stays = member.groupBy(F.coalesce("root", "node").alias("root")).agg(least.alias("row")).select("row")
    return beside(stays.withColumn("value", F.lit(True)), "kept").filter("value").select("kept.*")
