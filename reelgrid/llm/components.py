"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Links that a task holds at once, about; a table of no more of them is settled by one task.
HELD = 1 << 19


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: every member but the smallest, and the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars, which connect the same; made again whenever HELD more links have come."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    fresh, schema = 0, None

    def stars() -> tuple[np.ndarray, np.ndarray]:
        return spanning(*map(np.concatenate, zip(*held, strict=True)))

    for b in batches:
        if b.num_rows:
            schema = b.schema
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in "uv"))
            fresh += b.num_rows
            if fresh > HELD:
                held, fresh = [stars()], 0
    if held:
        u, v = stars()
        for k in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)], schema.field(c).type) for x, c in ((u, "u"), (v, "v"))], ["u", "v"])


def _settled(star: DataFrame) -> bool:
    """Does every node point at one other at most, and none of those at another?"""
    points = star.unionByName(star.select(F.col("v").alias("u"), "v"))
    told = points.groupBy("u").agg((F.min("v") != F.max("v")).alias("apart"))
    return not told.agg(F.max("apart")).first()[0]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b: comparable, no nulls) to rows node, root: the smallest node of each linked node's component.

    Nodes that are smallest themselves, or have no links but to themselves, have no row.
    A task first makes stars of the links it holds.  What is left of few links (HELD) is settled
    by one task, however many tasks made them.  Of more, each round halves the distance to the
    smallest node; tables of a round lie in the shared folder, so nothing depends on an executor
    that made them.
    """
    kind = links.schema["a"].dataType.simpleString()

    def thinned(star: DataFrame) -> DataFrame:
        return star.mapInArrow(_thinned, f"u {kind}, v {kind}")

    star = B.kept(thinned(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "links")
    for _ in range(rounds):
        if star.count() <= HELD:
            return thinned(star.coalesce(1)).select(F.col("u").alias("node"), F.col("v").alias("root"))
        if _settled(star):
            return star.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))  # several tasks may have named a link
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        star = B.kept(thinned(small.distinct()), "links")
    raise RuntimeError("the components have not settled")
