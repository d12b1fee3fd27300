"""Embedding near-dedup: one small-world graph per shard, every vector sent to every shard.

Equal vectors are one.  A shard's task builds its graph (hnsw.py), audits the
recall of links on sampled members, a vector's link with itself left out, against
an exact scan and widens the beam until the audit passes; where no beam does, all
queries are compared with the whole shard; a query whose whole beam links is asked again with a
wider one, and at last against the whole shard.  Pairs are verified by cosine in
double precision.  What leaves a task are numbers of links, and for each batch
of queries a star for every group that its links connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import components, spanning
from .hnsw import HNSW

#: Vectors of a shard about; more vectors make more shards.
SHARD_ROWS = 32_768
LEAST_SHARDS = 6
BEAM, WIDEST = 32, 256
#: Members that an audit asks with, and the share of their links with others that a beam has to find.
AUDITED, RECALL = 2048, 0.99
QUERIES = 512


class Shard:
    def __init__(self, nodes: list[str], vectors: np.ndarray, copies: np.ndarray, cosine: float):
        self.nodes, self.copies, self.cosine = np.array(nodes), copies, cosine
        self.exact = self.unit(vectors)
        self.single = self.exact.astype(np.float32)
        self.graph = HNSW(self.single)
        self.beam = 0

    @staticmethod
    def unit(vectors: np.ndarray) -> np.ndarray:
        wide = vectors.astype(np.float64)
        wide /= np.abs(wide).max(axis=1, keepdims=True)
        return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))

    def _verified(self, exact: np.ndarray, row: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.concatenate([np.einsum("kd,kd->k", exact[row[s : s + 65536]], self.exact[member[s : s + 65536]]) >= self.cosine for s in range(0, len(row), 65536)] or [np.zeros(0, bool)])
        return row[near], member[near]

    def _scan(self, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links by comparing with the whole shard."""
        out = []
        for s in range(0, len(exact), 32):
            row, member = np.nonzero(exact[s : s + 32].astype(np.float32) @ self.single.T >= self.cosine - 1e-4)
            out.append((row + s, member))
        row, member = (np.concatenate(x) for x in zip(*out, strict=True))
        return self._verified(exact, row, member)

    def _search(self, exact: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links that a beam finds, and the queries whose whole beam is that near."""
        ids, sims = self.graph.search(exact.astype(np.float32), beam)
        near = (sims >= self.cosine - 1e-4) & (ids >= 0)
        row, column = np.nonzero(near)
        return *self._verified(exact, row, ids[row, column]), np.flatnonzero(near.all(axis=1))

    def _audit(self) -> None:
        """The least beam that finds the links of sampled members with others; beyond WIDEST where none does."""
        pick = np.linspace(0, len(self.nodes) - 1, min(AUDITED, len(self.nodes))).astype(np.int64)
        sample = self.exact[pick]
        row, member = self._scan(sample)
        other = member != pick[row]
        true = {*zip(row[other].tolist(), member[other].tolist(), strict=True)}
        self.beam = BEAM
        while self.beam <= WIDEST and self.beam < len(self.nodes):
            row, member, full = self._search(sample, self.beam)
            wide = set(full.tolist())  # full beams are asked again in any case
            wanted = {p for p in true if p[0] not in wide}
            if len(wanted & {*zip(row.tolist(), member.tolist(), strict=True)}) >= RECALL * len(wanted):
                break
            self.beam *= 2

    def links(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (query, member) pair whose cosine reaches the bound."""
        exact = self.unit(vectors)
        if not self.beam:
            self._audit()
        rows, members, open_, beam = [], [], np.arange(len(exact)), self.beam
        while len(open_) and beam <= WIDEST and beam < len(self.nodes):
            row, member, full = self._search(exact[open_], beam)
            over = ~np.isin(row, full)
            rows.append(open_[row[over]])
            members.append(member[over])
            open_, beam = open_[full], beam * 2
        if len(open_):
            row, member = self._scan(exact[open_])
            rows.append(open_[row])
            members.append(member)
        return np.concatenate(rows), np.concatenate(members)


FOUND = "kind int, a string, b string, n long"


def _answer(shard: Shard, nodes: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    row, member = shard.links(vectors)
    other = shard.nodes[member] != nodes[row]
    row, member = row[other], member[other]
    count = np.bincount(row, shard.copies[member], minlength=len(nodes)).astype(np.int64)
    names, at = np.unique(np.concatenate([shard.nodes, nodes]), return_inverse=True)
    a, b = spanning(at[len(shard.nodes) + row], at[member])
    hit = np.flatnonzero(count)
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64()]
    columns = [[0] * len(hit) + [1] * len(a), [*nodes[hit].tolist(), *names[a].tolist()], [None] * len(hit) + names[b].tolist(), [*count[hit].tolist(), *[None] * len(a)]]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "a", "b", "n"])


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Link vectors by cosine: id, n_links (other rows linked), component_id (smallest id reachable), kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing, nor do vectors of different lengths.  Rows with equal vectors link with each
    other.  A null id is never smallest; kept is id = component_id, and true for null ids
    of groups without any id.  Other columns are not read; an empty table gives an empty
    result.
    """
    v = F.col(vector_col).cast("array<float>")
    infinite = F.lit(float("inf"))
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite)) | ~F.exists(v, lambda x: x != 0)
    rows = B.kept(vectors.select(F.col(id_col).alias("id"), F.when(~bad, v).alias("v"), F.when(~bad, F.md5(F.array_join(v, ","))).alias("node")), "vectors")
    distinct = B.kept(rows.filter("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.min("id").alias("low"), F.count("*").alias("copies")), "distinct")
    shards = max(LEAST_SHARDS, -(-distinct.count() // shard_rows))
    of = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    column = [F.size("v").alias("dims"), "node", "v", "copies"]
    index = distinct.select(of.alias("shard"), F.lit(0).alias("query"), *column)
    asked = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("query"), *column)
    dealt = index.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("dims", "shard", "query")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dims", "shard", "query")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                dims, number, query = key[:, s].tolist()
                part = batch.slice(s, e - s)
                nodes = part.column("node").to_pylist()
                matrix = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                if at != (dims, number):
                    at, held, shard = (dims, number), [], None
                if not query:
                    held.append((nodes, matrix, part.column("copies").to_numpy()))
                    continue
                if shard is None and held:
                    shard = Shard(sum((h[0] for h in held), []), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), cosine)
                    held = []
                if shard is not None:
                    for q in range(0, len(nodes), QUERIES):
                        yield from _answer(shard, np.array(nodes[q : q + QUERIES]), matrix[q : q + QUERIES])

    found = B.kept(dealt.mapInArrow(task, FOUND), "found")
    count = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    root = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "of")
    named = distinct.select("node", "low", "copies").join(root, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node")).drop("of")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    told = named.join(least, "root").join(count, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(told, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
