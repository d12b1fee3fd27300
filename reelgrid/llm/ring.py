"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at several places of the ring (virtual nodes).  Rows fall into
slices of the ring, and a slice belongs to the first node clockwise.  A shard takes
what its capacity holds, and what is left over goes on clockwise to the next shard
with room.  Capacities are the mean times `load`; with a load of 1 they sum up to
the number of rows and differ by one at most, so counts do.  Only counts of slices
reach the driver, a table whose size depends on the number of shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

#: Slices for each shard and at least; parts in which the rows of a slice are counted; places of a shard on the ring.
SLICES_A_SHARD, SLICES = 32, 1024
SALTS = 64
VIRTUAL = 64


def slices_for(shards: int) -> int:
    """Slices of a ring, a power of two: many more than shards, so that each shard owns some."""
    return max(SLICES, 1 << (SLICES_A_SHARD * shards - 1).bit_length())


def nodes(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Places on the ring (0 to 2**60), in order, and whose they are.  Those of a shard do not depend on other shards."""
    seats = sorted((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in seats], np.int64), np.array([s for _, s in seats], np.int64)


def owners(shards: int, slices: int = SLICES) -> np.ndarray:
    """The shard that each slice belongs to."""
    place, shard = nodes(shards)
    return shard[np.searchsorted(place, np.arange(slices) * ((1 << 60) // slices)) % len(place)]


def spread(counts: np.ndarray, shards: int, load: float = 1.0) -> list[list[tuple[int, int]]]:
    """For each slice of counts the (shard, rows) that it fills, in order: own shards first, then what overflows."""
    total = int(counts.sum())
    if load == 1.0:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    elif load > 1:
        room = [-int(-total * load // shards)] * shards
    else:
        raise ValueError("shards cannot hold less than all rows")
    place, shard = nodes(shards)
    ring = shard.tolist()
    first = np.searchsorted(place, np.arange(len(counts)) * ((1 << 60) // len(counts)))
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    left = [(s, at, frozenset(), n) for s, (at, n) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)) if n]
    while left:
        over = []
        for s, at, met, n in left:
            while (to := ring[at % len(ring)]) in met:
                at += 1
            if take := min(n, room[to]):
                out[s].append((to, take))
                room[to] -= take
            if n > take:
                over.append((s, at + 1, met | {to}, n - take))
        left = over
    return out


def _plan(cells: dict[tuple[int, int], int], shards: int, slices: int, load: float) -> dict[str, np.ndarray]:
    """Runs of ranks within cells (slice and salt) with the shard and first slot of each."""
    counts = np.zeros(slices, np.int64)
    for (s, _), n in cells.items():
        counts[s] += n
    parts = spread(counts, shards, load)
    used, start, shard, slot = [0] * shards, [], [], []
    open_: dict[int, list[list[int]]] = {s: [list(p) for p in parts[s]] for s in range(slices)}
    for (s, salt), n in sorted(cells.items()):
        rank = 0
        while rank < n:
            to, room = open_[s][0]
            take = min(room, n - rank)
            start.append((s * SALTS + salt) << 40 | rank)
            shard.append(to)
            slot.append(used[to])
            used[to] += take
            rank += take
            open_[s][0][1] -= take
            if not open_[s][0][1]:
                open_[s].pop(0)
    return {"start": np.array(start, np.int64), "shard": np.array(shard, np.int32), "slot": np.array(slot, np.int64)}


def ring_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, load: float = 1.0) -> DataFrame:
    """Put every row into one of `shards` shards: id, size, text_crc32, shard, slot (gapless from 0 within the shard).

    A row's place on the ring follows its text, so equal texts stand together and are parted
    only where a shard is full; of a slice the rows that overflow are the last by hash and
    value of the id.  No shard holds more than its capacity: the mean times `load`, for a load
    of 1 the mean rounded up or down.  More load means fewer rows that overflow, and fewer that
    move when shards are added.  size is the text's UTF-8 bytes plus 1; a null text has none.
    Rows that repeat in all of these are interchangeable; null ids come first.  Other columns
    are not read; an empty table gives an empty result.
    """
    slices, text = slices_for(shards), F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.lit(slices)).cast("int").alias("slice"),
        F.pmod(F.xxhash64(F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = B.kept(slim, "ring")
    cells = {(r["slice"], r["salt"]): r["count"] for r in rows.groupBy("slice", "salt").count().collect()}  # slices x SALTS at most
    plan = docs.sparkSession.sparkContext.broadcast(_plan(cells, shards, slices, load))
    rank = F.row_number().over(Window.partitionBy("slice", "salt").orderBy("id", "size", "text_crc32")) - 1
    ranked = rows.withColumn("key", ((F.col("slice") * SALTS + F.col("salt")).cast("long") * F.lit(1 << 40)) + rank).drop("slice", "salt")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = plan.value
        for batch in batches:
            key = batch.column("key").to_numpy()
            at = np.searchsorted(told["start"], key, "right") - 1
            columns = [*batch.columns[:3], pa.array(told["shard"][at]), pa.array(told["slot"][at] + key - told["start"][at])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "text_crc32", "shard", "slot"])

    return ranked.mapInArrow(place, f"id {B.id_type(docs, id_col)}, size long, text_crc32 long, shard int, slot long")
