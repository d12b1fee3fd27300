"""A shard whose graph finds nothing."""

import numpy as np


def test_failed_audit_ends_in_a_scan():
    from reelgrid.llm.embedding_dedup import Shard

    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(600, 16)), 2, axis=0) + rng.normal(size=(1200, 16)) * 0.01
    shard = Shard([str(k) for k in range(1200)], x.astype(np.float32), np.ones(1200, np.int64), 0.95)
    shard.graph.search = lambda query, beam: (np.full((len(query), beam), -1, np.int64), np.full((len(query), beam), -2.0, np.float32))
    shard.links(rng.normal(size=(64, 16)).astype(np.float32))  # a first batch without links
    row, member = shard.links(x[:10].astype(np.float32))
    assert {(k, k ^ 1) for k in range(10)} <= {*zip(row.tolist(), member.tolist())}
