"""Whitening and routed search against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

BAD = [(9000, None), (9001, [float("nan")] * 8), (9002, [1.0, None]), (9003, [float("inf")] * 8), (9004, [])]


def table(spark, x, more=(), ids=None, kind="float"):
    data = [(int(k) if k is not None else None, [float(v) for v in row]) for k, row in zip(ids if ids is not None else range(len(x)), x)] + list(more)
    df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>")
    return df.withColumn("id", F.lit("clash")).withColumn("x", F.lit(1)).withColumn("node", F.lit(2)).withColumn("part", F.lit(3))


def fixed(x):
    x = np.floor(256 * np.asarray(x, np.float64)).astype(np.int64)
    return x, np.unique(x, axis=0)


def whitened_by_numpy(x, k=4):
    x, fit = fixed(x)
    n, total = len(fit), fit.sum(axis=0)
    off = fit - total / n
    value, vector = np.linalg.eigh(off.T @ off / n)
    value, vector = value[::-1], vector[:, ::-1]
    white = (x - total / n) @ vector[:, :k] / np.sqrt(value[:k])
    return n, ((n * x - total) ** 2).sum(axis=1), white, value[:k] / value.sum()


@pytest.mark.parametrize("dims, rows", [(8, 300), (40, 500), (3, 50)])
def test_whitened(spark, dims, rows):
    from reelgrid.llm.whitening import whitened

    rng = np.random.default_rng(dims)
    x = (rng.normal(size=(rows, dims)) * np.linspace(1.5, 0.2, dims)).astype(np.float32)
    x[10:30] = x[10]  # repeated vectors count once
    ids = [None, *range(1, rows)]
    got = whitened(table(spark, x, [(i, (v * (dims // len(v) + 1))[:dims] if v else v) for i, v in BAD if i != 9002] + [(9002, [1.0, None])], ids)).collect()
    k = min(4, dims)
    n, deviation, white, share = whitened_by_numpy(x, k)
    by = defaultdict(dict)
    for r in got:
        by[r["id"]][r["component"]] = r
    assert len(got) == rows * k and set(by) == set(ids)
    found = np.array([[by[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((found * white).sum(axis=0))
    assert np.abs(found * sign - white).max() < 1e-9
    for i, own in zip(ids, deviation):
        assert all((r["n"], r["deviation"]) == (n, own) for r in by[i].values())
    assert np.allclose([by[1][c + 1]["explained"] for c in range(k)], share, rtol=1e-9)
    assert {r["identity_error"] for r in got}.pop() < 1e-9


def test_whitened_edges(spark):
    from reelgrid.llm.whitening import whitened

    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitened(none).count() == 0 and whitened(table(spark, [], BAD)).count() == 0
    assert whitened(table(spark, [[1.0, 2.0]] * 5)).count() == 0  # no spread
    rank = whitened(table(spark, [[t, 2 * t, 0.0] for t in range(6)])).collect()
    assert len(rank) == 6 and {r["component"] for r in rank} == {1} and abs(rank[0]["explained"] - 1) < 1e-9
    mixed = whitened(table(spark, [[0.0, 1.0], [1.0, 0.0], [0.5, 0.9]], [(7, [1.0, 2.0, 3.0])])).collect()
    assert {r["id"] for r in mixed} == {0, 1, 2}
    huge = whitened(table(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 5.0]], kind="double")).collect()
    assert len(huge) >= 3 and {r["deviation"] for r in huge} >= {None}


def test_leading_starts_again(spark):
    """A basis that holds little is started again from the best columns, and still certifies."""
    from reelgrid.llm import blocks
    from reelgrid.llm.whitening import Spread, leading

    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(400, 60)) * np.linspace(900, 100, 60)).astype(np.int64)
    df = blocks.kept(spark.createDataFrame([([int(v) for v in r],) for r in x], "x array<long>"), "fit")
    value, vector = leading(Spread(df, 60), 3, block=6, basis=24)
    off = x - x.mean(axis=0)
    want, axes = np.linalg.eigh(off.T @ off / len(x))
    assert np.allclose(value, want[::-1][:3], rtol=1e-10) and np.allclose(np.abs((vector * axes[:, ::-1][:, :3]).sum(axis=0)), 1)


def brute(rows, k=10):
    """rows: (id, vector) that take part; of each query the k nearest others."""
    want = Counter()
    for i, (q, v) in enumerate(rows):
        if q is not None and q % 100 == 0:
            near = sorted((float(np.sqrt(((np.float64(v) - np.float64(w)) ** 2).sum())), p is None, p or 0, p) for j, (p, w) in enumerate(rows) if j != i and len(w) == len(v))
            want.update((q, no + 1, p, round(s, 9)) for no, (s, _, _, p) in enumerate(near[:k]))
    return want


def test_nearest_exact_parts(spark):
    """Where all partitions are probed (one partition), rows equal brute force: ties, copies, nulls, lengths, hot groups over tasks."""
    from reelgrid.llm.routed_search import nearest

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[50:110] = x[50]  # a fifth of the rows are one vector, a query among them
    ids = [*range(40, 340)]
    ids[5] = None
    more = [(100, [float(v) for v in x[60]]), (100, [float(v) for v in x[60]]), (9100, [1.0, 2.0]), (9200, [1.0, 3.0]), (9300, [0.0] * 6), (9400, None), (9500, [1.0, float("nan")])]
    got = nearest(table(spark, x, more, ids), F.col("vec_id") % 100 == 0, task_rows=64).collect()
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x)] + more[:4]
    assert Counter((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in got) == brute(rows)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(none, F.col("vec_id") % 100 == 0).count() == 0
    assert nearest(table(spark, x[:3], ids=[1, 2, 3]), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest(table(spark, x[:1], ids=[100]), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_recall(spark):
    """Many partitions over planted clusters and over no structure at all: recall, and scores that are the measure itself."""
    from reelgrid.llm.routed_search import nearest

    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    for x in (centre[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16)), rng.normal(size=(3000, 16))):
        x = x.astype(np.float32)
        got = nearest(table(spark, x, ids=range(0, 30000, 10)), F.col("vec_id") % 100 == 0, part_rows=180).collect()
        wide, found, true = x.astype(np.float64), defaultdict(set), 0
        for r in got:
            found[r["query_id"]].add(r["id"])
            assert abs(r["score"] - np.linalg.norm(wide[r["query_id"] // 10] - wide[r["id"] // 10])) < 1e-12
        for q in range(0, 3000, 10):
            near = np.linalg.norm(wide - wide[q], axis=1)
            near[q] = np.inf
            true += len(found[q * 10] & {int(i) * 10 for i in np.argsort(near)[:10]})
        assert true >= 0.9 * 3000 and len(found) == 300


def test_balanced_parts():
    from reelgrid.llm.router import balanced_parts, neighbour_graph

    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 12)) * 4
    own = np.repeat(np.arange(8), 64)
    x = centre[own] + rng.normal(size=(512, 12))
    label = balanced_parts(neighbour_graph(x), 8)
    assert (np.bincount(label) == 64).all()
    graph = neighbour_graph(x)
    assert (label[graph] == label[:, None]).mean() > 0.9  # few neighbours are cut apart
