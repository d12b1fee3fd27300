"""Nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced partitions (router.py),
and a small classifier learns from it where a vector and its neighbours lie.  The
classifier gives every vector of the table its partition and sends each query to the
most probable ones, until their probabilities reach a mass.  That mass is the least
that finds the wanted share of true neighbours of audited queries, which are compared
with the whole table.  Partitions hold each different vector once, and one that
outgrows a task is dealt out to several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .router import Router, fitted

#: Different vectors that graph and classifier are fitted on, about, and the most entries of them.
SAMPLE, SAMPLE_ENTRIES = 8192, 1 << 23
#: Vectors of a partition about; at most so many partitions; vectors that a task holds about.
PART_ROWS, MOST_PARTS, TASK_ROWS = 1024, 256, 1 << 16
#: Queries that are compared with the whole table, about, and the share of their neighbours to be found.
AUDITED, RECALL = 256, 0.95
_CELLS = 1 << 22


def _groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors by length: length, rows, and the vectors as doubles."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dims in np.unique(size).tolist():
        rows = np.flatnonzero(size == dims)
        part = column.take(pa.array(rows)) if len(rows) < len(size) else column
        yield dims, rows, part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _squared(q: np.ndarray, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Squared distances but for rounding."""
    return np.maximum((q * q).sum(axis=1)[:, None] + norms[None, :] - 2 * (q @ x.T), 0)


def _slack(q: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """How far rounding may carry such a distance."""
    return 1e-12 * q.shape[1] * ((q * q).sum(axis=1) + norms.max(initial=0.0))


class Part:
    """Different vectors of one task, each with its rows' smallest ids."""

    def __init__(self, nodes: pa.Array, x: np.ndarray, ids: pa.ListArray):
        self.x, self.norms = x, (x * x).sum(axis=1)
        self.at = {n: i for i, n in enumerate(nodes.to_pylist())}
        self.ids = ids.flatten()
        self.size = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.order = pc.rank(self.ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)

    def nearest(self, q: np.ndarray, nodes: list[str], ids: pa.Array, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The k nearest rows of each query but itself: query, id, distance."""
        near = _squared(q, self.x, self.norms)
        last = np.partition(near, min(k, near.shape[1] - 1), axis=1)[:, min(k, near.shape[1] - 1)]
        query, member = np.nonzero(near <= (last + 2 * _slack(q, self.norms))[:, None])
        off = self.x[member] - q[query]
        score = np.sqrt(np.einsum("kd,kd->k", off, off))
        fan = self.size[member]
        run = np.cumsum(fan)
        row = np.repeat(self.first[member] - (run - fan), fan) + np.arange(int(run[-1]))
        query, member, score = (np.repeat(v, fan) for v in (query, member, score))
        own_class = np.array([self.at.get(n, -1) for n in nodes])
        own_id = pc.index_in(ids, value_set=self.ids).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        own_order = np.where(own_id >= 0, self.order[own_id], -1)
        own = np.flatnonzero((member == own_class[query]) & (self.order[row] == own_order[query]))
        _, once = np.unique(query[own], return_index=True)
        rest = np.ones(len(query), bool)
        rest[own[once]] = False
        query, row, score = query[rest], row[rest], score[rest]
        order = np.lexsort((self.order[row], score, query))
        query, row, score = query[order], row[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[keep], self.ids.take(pa.array(row[keep])), score[keep]


def _audit(classes: DataFrame, router: Router, q: np.ndarray, own: list[str], k: int) -> tuple[float, float]:
    """The least mass with RECALL of the queries' k nearest different vectors, and the share that it finds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)]
        name = {n: i for i, n in enumerate(own)}
        for batch in batches:
            for dims, rows, x in _groups(batch.column("v")):
                if dims != q.shape[1]:
                    continue
                near, part = _squared(q, x, (x * x).sum(axis=1)), batch.column("part").to_numpy()[rows]
                for i, n in enumerate(batch.column("node").take(pa.array(rows)).to_pylist()):
                    if n in name:
                        near[name[n], i] = np.inf
                near, part = np.hstack([held[0], near]), np.hstack([held[1], np.broadcast_to(part, near.shape)])
                least = np.argpartition(near, k - 1, axis=1)[:, :k]
                held = [np.take_along_axis(near, least, 1), np.take_along_axis(part, least, 1)]
        real = np.isfinite(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(real)[0]), pa.array(held[0][real]), pa.array(held[1][real])], ["q", "near", "part"])

    best = Window.partitionBy("q").orderBy("near", "part")
    found = classes.mapInArrow(scan, "q long, near double, part long").withColumn("no", F.row_number().over(best)).filter(F.col("no") <= k).collect()
    if not found:
        return np.inf, 1.0
    before = router.mass_before(q)[[r["q"] for r in found], [r["part"] for r in found]]
    mass = float(np.sort(before)[int(np.ceil(RECALL * len(before))) - 1])
    return mass, float((before <= mass).mean())


def nearest(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, part_rows: int = PART_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """The k nearest other rows of each row for which `asks` holds: query_id, rank, id, score, probes, recall.

    score is the Euclidean distance in double precision; ties go to the smaller id, a null id
    behind all others.  Vectors that are null, empty or zero, or hold null, NaN or infinite
    components, take no part.  Vectors of different lengths are no neighbours; only the
    commonest length (of equally common ones the longest) is searched by the learned partitions,
    others among all of their length.  Rows that repeat an id and vector are rows of their own,
    as queries and as neighbours.  probes: partitions searched for the query; recall: the share
    of audited queries' neighbours in the partitions probed for them.  Other columns are not
    read; an empty table gives an empty result, and a query without other vectors no row.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v, infinite = F.col(vector_col).cast(kind), F.lit(float("inf"))
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != infinite)) & F.exists(v, lambda c: c != 0)
    rows = B.kept(vectors.filter(good).select(F.col(id_col).alias("id"), v.alias("v"), F.md5(F.array_join(v, ",")).alias("node"), F.coalesce(asks, F.lit(False)).alias("asks")), "vectors")
    of, schema = B.id_type(vectors, id_col), "query_id {0}, rank int, id {0}, score double, probes int, recall double"
    none = rows.sparkSession.createDataFrame([], schema.format(of))
    # Of equal vectors only the smallest ids can be among the nearest, one more than k as a query is not its own neighbour.
    least = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last())
    listed = rows.select("id", "v", "node").withColumn("no", F.row_number().over(least)).filter(F.col("no") <= k + 1)
    held = F.transform(F.array_sort(F.collect_list(F.struct("no", "id"))), lambda x: x["id"])
    classes = B.kept(listed.groupBy("node").agg(F.first("v").alias("v"), held.alias("ids")), "classes")
    lengths = {r["dims"]: r["n"] for r in classes.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()}
    if not lengths:
        return none
    dims = max(lengths, key=lambda d: (lengths[d], d))
    n, parts = lengths[dims], 1
    while parts < MOST_PARTS and 2 * parts * part_rows <= n:
        parts *= 2
    others = {d: parts + i for i, d in enumerate(sorted(set(lengths) - {dims}))}
    share = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    wanted = min(SAMPLE, max(32 * parts, SAMPLE_ENTRIES // dims))
    sample = classes.filter(F.size("v") == dims).filter(share < wanted / n).select("v").toArrow()["v"].combine_chunks()
    sampled = next((x for _, _, x in _groups(sample)), np.zeros((0, dims)))
    router = fitted(sampled[np.lexsort(sampled.T[::-1])], parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.zeros(batch.num_rows, np.int64)
            for d, at, x in _groups(batch.column("v")) if batch.num_rows else ():
                part[at] = router.probability(x).argmax(axis=1) if d == dims else others[d]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    index = B.kept(classes.mapInArrow(place, f"node string, v {kind}, ids array<{of}>, part long"), "index")
    size = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    tasks = [max(1, -(-size.get(p, 0) // task_rows)) for p in range(parts + len(others))]
    base = np.cumsum([0, *tasks]).tolist()
    asked = B.kept(rows.filter("asks").groupBy("id", "node").agg(F.first("v").alias("v"), F.count("*").alias("copies")), "asked")
    n_asked = asked.count()
    if not n_asked:
        return none
    audited = asked.filter(F.size("v") == dims).filter(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) < AUDITED / n_asked * (1 << 30)).select("node", "v").distinct().orderBy("node").toArrow()
    mass, recall = np.inf, 1.0
    if audited.num_rows and parts > 1:
        mass, recall = _audit(index, router, next(_groups(audited["v"].combine_chunks()))[2], audited["node"].to_pylist(), k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [[]] * batch.num_rows
            for d, at, x in _groups(batch.column("v")) if batch.num_rows else ():
                hit = router.mass_before(x) <= mass if d == dims else None
                for i, row in enumerate(at.tolist()):
                    to[row] = np.flatnonzero(hit[i]).tolist() if d == dims else [others[d]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int64()))], [*batch.schema.names, "parts"])

    bases, counts = (F.array(*map(F.lit, x)) for x in (base[:-1], tasks))
    pick = lambda a: F.get(a, F.col("part").cast("int"))
    columns = ["shard", "query", "node", "v", "ids", "id", "copies", "probes"]
    kept = index.select((pick(bases) + F.pmod(F.xxhash64("node"), pick(counts))).cast("int").alias("shard"), F.lit(0).alias("query"), "node", "v", "ids", F.lit(None).cast(of).alias("id"), F.lit(0).cast("long").alias("copies"), F.lit(0).alias("probes"))
    sent = asked.mapInArrow(route, f"id {of}, node string, v {kind}, copies long, parts array<long>").select("*", F.size("parts").alias("probes"), F.explode("parts").alias("part"))
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), pick(counts) - 1)).alias("no"))
    sent = sent.select((pick(bases) + F.col("no")).cast("int").alias("shard"), F.lit(1).alias("query"), "node", "v", F.lit(None).cast(f"array<{of}>").alias("ids"), "id", "copies", "probes")
    dealt = kept.select(columns).unionByName(sent.select(columns)).repartitionById(base[-1], F.col("shard")).sortWithinPartitions("shard", "query")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts_, held = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shard", "query")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                shard, query = key[:, s].tolist()
                if shard != at:
                    at, parts_, held = shard, [], None
                piece = batch.slice(s, e - s)
                if not query:
                    parts_.append(piece)
                    continue
                if held is None and parts_:
                    table = pa.Table.from_batches(parts_).combine_chunks()
                    held = Part(table["node"].chunk(0), next(_groups(table["v"].chunk(0)))[2], table["ids"].chunk(0))
                    parts_ = []
                if held is None:
                    continue
                step = max(1, _CELLS // len(held.x))
                for f in range(0, e - s, step):
                    some = piece.slice(f, step)
                    who, ids, score = held.nearest(next(_groups(some.column("v")))[2], some.column("node").to_pylist(), some.column("id"), k)
                    who = pa.array(who)
                    yield pa.RecordBatch.from_arrays([some.column("id").take(who), some.column("node").take(who), some.column("copies").take(who), some.column("probes").take(who), ids, pa.array(score)], ["query_id", "node", "copies", "probes", "id", "score"])

    found = dealt.mapInArrow(search, f"query_id {of}, node string, copies long, probes int, id {of}, score double")
    best = Window.partitionBy("query_id", "node").orderBy("score", F.col("id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    each = top.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("query_id", "rank", "id", "score", "probes", F.lit(recall).alias("recall"))
