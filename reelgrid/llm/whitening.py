"""Embedding whitening: the leading components of a covariance that is never formed.

Entries are fixed to integers first, so sums and deviations are exact.  Each pass
over the distinct vectors computes Xt(XQ) of the centred rows for a block of
columns Q, on the executors; what the driver holds are a few columns as long as
a vector.  A pass's block joins those before it by QR, and Rayleigh-Ritz over all
of them gives the components, until the residuals certify every one.  Blocks
stay and widen twofold because spectra of embeddings are nearly flat: a single
block of fixed width would need hundreds of passes to part one component from
the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Columns of the first block, and the most that the driver keeps before it starts again from the best of them.
BLOCK, BASIS = 16, 2048
#: A component is certified when its residual is so small against the largest eigenvalue.
RESIDUAL = 1e-13
PASSES = 200
#: Eigenvalues under this share of the largest are rounding; they belong to no component.
RANK = 1e-12
_LOW = (1 << 32) - 1


def _matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _summed(parts: DataFrame, kind: str) -> dict[int, tuple]:
    """Partial sums (at, values) of tasks, added up by place: as many rows as a vector or a block has entries."""
    rows = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    return {r["at"]: r["value"] for r in rows.collect()}


class Spread:
    """Centred distinct vectors: their number, sums and trace, and V times a block of columns."""

    def __init__(self, fit: DataFrame, dims: int):
        self.fit, self.dims = fit, dims

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * dims + 1, object)  # sums of high and low halves, and rows
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("x"))
                    total += np.concatenate([(x >> 32).sum(axis=0), (x & _LOW).sum(axis=0), [len(x)]]).astype(object)
            high = [int(v) for v in total]
            yield pa.RecordBatch.from_arrays([pa.array([[v >> 32 for v in high]], pa.list_(pa.int64())), pa.array([[v & _LOW for v in high]], pa.list_(pa.int64()))], ["high", "low"])

        told = fit.mapInArrow(sums, "high array<long>, low array<long>")
        rows = told.select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "v")).groupBy("at").agg(F.sum(F.col("v.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("v.low").cast("decimal(38,0)")).alias("low")).collect()
        whole = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
        self.sums = [(whole[k] << 32) + whole[dims + k] for k in range(dims)]
        self.n = whole[2 * dims]
        self.mean = np.array([s / self.n for s in self.sums])

    def trace(self) -> float:
        mean = self.mean

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((float(((_matrix(b.column("x")) - mean) ** 2).sum()) for b in batches if b.num_rows), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([[total]], pa.list_(pa.float64()))], ["part"])

        return _summed(self.fit.mapInArrow(squares, "part array<double>"), "double")[0] / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q by one pass: each task adds up Xt(X q) of its centred rows."""
        mean = self.mean

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("x")) - mean
                    total += x.T @ (x @ q)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["part"])

        told = _summed(self.fit.mapInArrow(product, "part array<double>"), "double")
        return np.array([told[k] for k in range(q.size)]).reshape(q.shape) / self.n


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns that span what the block adds to the basis; twice, so that rounding is taken out as well."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        block, r = np.linalg.qr(block)
        block = block[:, np.abs(np.diag(r)) > 1e-10]
    return block


def leading(spread: Spread, k: int, block: int = BLOCK, basis: int = BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors as columns; fewer where the rank is less."""
    d = spread.dims
    k = min(k, d)
    rng = np.random.default_rng(0)
    held, image = np.zeros((d, 0)), np.zeros((d, 0))
    fresh, width = rng.normal(size=(d, min(block, d))), block
    for _ in range(PASSES):
        fresh = _orthonormal(fresh, held)
        if not fresh.shape[1] and held.shape[1] < d:  # the residuals lie in the basis: go on in a direction not yet met
            fresh = _orthonormal(rng.normal(size=(d, min(width, d - held.shape[1]))), held)
        if fresh.shape[1]:
            held, image = np.hstack([held, fresh]), np.hstack([image, spread.times(fresh)])
        inner = held.T @ image
        value, mix = np.linalg.eigh((inner + inner.T) / 2)
        value, mix = value[::-1], mix[:, ::-1]
        ritz, ahead = held @ mix, image @ mix
        rest = ahead - ritz * value
        size = np.linalg.norm(rest, axis=0)
        if held.shape[1] == d or (size[:k] <= RESIDUAL * max(value[0], 0.0)).all():
            real = value[:k] > RANK * max(value[0], 0.0)
            return value[:k][real], ritz[:, :k][:, real]
        if held.shape[1] + 2 * width > max(basis, 4 * block):  # start again from the best, whose images are known
            keep = max(basis // 2, 2 * block)
            held, image, width = ritz[:, :keep], ahead[:, :keep], block
        width = min(2 * width, basis // 4, d - held.shape[1])
        fresh = np.hstack([rest[:, :width], rng.normal(size=(d, max(0, width - rest.shape[1])))])  # residuals, and new directions beside them
    raise RuntimeError(f"{k} components are not certified after {PASSES} passes; the largest residual is {size[:k].max():.3g}")


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row the sum of (n x - S)^2, exact; null where a long can't hold it."""
    reach = max((max(abs(n * int(lo) - s), abs(n * int(hi) - s)) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), sums, strict=True)), default=0)
    if reach * reach * len(sums) < 1 << 63 and n * max(-int(x.min()), int(x.max())) < 1 << 63:
        off = x * n - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    told = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in told]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """Whiten by the leading components: id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * entry).  The covariance is that of the distinct x vectors,
    n of them.  A row for each row of vectors and component, numbered from 1 by falling
    eigenvalue.  Vectors that are null or hold null, NaN or infinite entries are dropped, as are
    empty ones and, in a table of several lengths, those not of the commonest (of equally common
    ones the longest).  Components of no spread do not exist: equal vectors throughout, or one
    vector, give no rows.  deviation is null where a long can't hold it.  Null ids and repeated
    rows give rows like any other; other columns are not read; an empty table gives an empty result.
    """
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = B.kept(vectors.filter(good).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * scale)).alias("x")), "fixed")
    schema = f"id {B.id_type(vectors, id_col)}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = rows.sparkSession.createDataFrame([], schema)
    common = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).limit(1).collect()
    if not common:
        return none
    dims = common[0]["dims"]
    rows = rows.filter(F.size("x") == dims)
    spread = Spread(B.kept(rows.select("x").distinct(), "distinct"), dims)
    value, vector = leading(spread, components)
    if not len(value):
        return none
    share = value / spread.trace()
    white = vector / np.sqrt(value)
    error = float(np.abs(white.T @ spread.times(white) - np.eye(len(value))).max())
    k, n, sums, mean = len(value), spread.n, spread.sums, spread.mean

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            told, m = _deviation(x, n, sums), len(x)
            columns = [
                batch.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(told, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(((x - mean) @ white).ravel()),
                pa.array(np.tile(share, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(task, schema)
