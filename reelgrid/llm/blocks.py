"""Bundles of whole documents that travel as one compressed row, and the shared folder they lie in.

A block holds some MB of documents as an Arrow table.  Operators that compare
documents with each other ask about the *content* of a block (hashes, packed
into arrays), and what comes back goes to the block, not to single documents:
a string that stands in a third of all documents is asked for once per block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  A session without it is refused, as a local folder would be one machine's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/reelgrid"  # one machine is all there is
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, and outlives any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As kept, dealt into files by the hash of `key`: grouping and cogrouping by it later moves the other side only.

    The table leaves no entry in the catalog; its files stay in the shared folder.
    """
    spark = df.sparkSession
    path, table = shared_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and the bounds of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no rows
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The rows in tables of about `limit` bytes of `column`, and at least one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            take = max(1, int(np.searchsorted(bounds, bounds[at] + limit - size, "right")) - 1 - at)
            if held and bounds[at + take] - bounds[at] + size > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.slice(at, take))
            size += int(bounds[at + take] - bounds[at])
            at += take
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


BLOCKS = "block long, n_rows long, n_bytes long, payload binary"


def packed(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, more: list[Column] = ()) -> DataFrame:
    """The documents in blocks, a table of the shared folder: columns `id` (as it is), `text` (UTF-8, null as empty) and `more`."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, table in enumerate(slices(batches, "text", block_bytes)):
            size = int(flat(table.column("text"))[1][-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k]), pa.array([table.num_rows]), pa.array([size]), pa.array([to_bytes(table)], pa.binary())], ["block", "n_rows", "n_bytes", "payload"]
            )

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *more)
    return kept_by(slim.mapInArrow(bundle, BLOCKS), "blocks", "block")


def buckets_for(blocks: DataFrame, each: int = 4) -> int:
    """A bucket for every `each` blocks' worth of bytes, 16 at least."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(16, total // (each * BLOCK_BYTES))


def id_type(docs: DataFrame, id_col: str) -> str:
    return T.StructType([docs.schema[id_col]])[0].dataType.simpleString()
