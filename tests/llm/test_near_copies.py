"""The pipeline's near-copy stage against brute force: similarity 0.8 by five-word shingles, null ids, repeated rows."""

import random
from collections import Counter, defaultdict


def sets_of(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))) if w else frozenset()


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def expected(rows):
    """How many rows of each id stay."""
    sets = [sets_of(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and near(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    groups = defaultdict(list)
    for k, (i, _) in zip(label, rows, strict=True):
        groups[k].append(i)
    return Counter(min((i for i in g if i is not None), default=None) for g in groups.values())


def fixture_rows():
    rng, rows = random.Random(4), []
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 60, 150, 400]))]
        rows.append((10 * k, " ".join(words)))
        for m in range(1, 4):
            copy = list(words)
            for _ in range(max(1, len(words) * m // 90)):
                copy[rng.randrange(len(copy))] = "other"
            rows.append((None if (k + m) % 5 == 0 else 10 * k + m, " ".join(copy)))
    rows += [(7000, rows[0][1]), (0, rows[0][1]), (None, "alone twice"), (None, "alone twice"), (7001, None), (7002, ""), (7003, " \n")]
    return rows + [(7004, "same id one text a b c"), (7004, "same id another text d e f")]


def test_near_copy_stage(spark):
    import corpus_pipeline

    rows = fixture_rows()
    sets = [sets_of(t) for _, t in rows]
    assert sum(0.8 <= len(a & b) / len(a | b) <= 0.95 for k, a in enumerate(sets) for b in sets[:k] if a and b) > 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in got) == expected(rows)
    assert {(r["doc_id"], r["text"]) for r in got} <= set(rows)
    from reelgrid.llm.near_copies import without_near_copies

    assert Counter(r["doc_id"] for r in without_near_copies(docs, group_bytes=0).collect()) == expected(rows)


def test_sketches_rule_out_no_near_pair():
    import numpy as np
    import pyarrow as pa

    from reelgrid.llm.near_copies import may_be_near, parity_sketch

    rng = np.random.default_rng(3)
    rows = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for k in range(600):
        n = int(rng.choice([1, 5, 63, 64, 65, 300, 5000]))
        own, other = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        keep = int(n * rng.choice([0, 0.3, 0.8, 0.9, 1]))
        rows.append((own, np.concatenate([own[:keep], other[: int(rng.integers(0, n - keep + 1))]])))
    table = pa.table({f"sketch_{x}": [parity_sketch(np.sort(r[k])) for r in rows] for k, x in enumerate("ab")} | {f"size_{x}": [len(r[k]) for r in rows] for k, x in enumerate("ab")})
    may = may_be_near(table, 0.8)
    near = np.array([not len(a) + len(b) or len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9 for a, b in rows])
    assert may[near].all() and near.sum() > 100
    wide = np.array([len(a) >= 300 and len(np.intersect1d(a, b)) <= 0.3 * len(a) for a, b in rows])
    assert wide.sum() > 50 and not may[wide].any()


def test_pairs_that_link():
    from reelgrid.llm.near_copies import linking

    rng = random.Random(8)
    for _ in range(50):
        pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(30)]
        true = {p for p in pairs if rng.random() < 0.4}
        taken = linking([a for a, _ in pairs], [b for _, b in pairs], lambda x, y: (x, y) in true)

        def groups(links):
            label = list(range(12))
            for a, b in links:
                label = [label[b] if x == label[a] else x for x in label]
            return {frozenset(k for k in range(12) if label[k] == x) for x in label}

        assert groups([pairs[k] for k in taken]) == groups(true) and {pairs[k] for k in taken} <= true


def test_without_rows(spark):
    from reelgrid.llm.near_copies import without_near_copies

    assert without_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def bucket_of(rows):
    """One bucket's table of texts (name, group, shingles that are keys, all shingles)."""
    import numpy as np
    import pyarrow as pa

    from reelgrid.llm.near_copies import DEALT, narrow, parity_sketch

    sketches = [narrow(parity_sketch(np.sort(own))) for *_, own in rows]
    packed = [np.concatenate([k for _, _, k, _ in rows]), np.array([len(k) for _, _, k, _ in rows], np.int32), np.array([r[0] for r in rows], np.int64), np.array([len(r[3]) for r in rows], np.int64)]
    packed += [np.array([r[1] for r in rows], np.int64), np.array([len(x) for x in sketches], np.int32)]
    return pa.table({c: pa.array([x], pa.binary()) for c, x in zip(DEALT[1:], [*(x.tobytes() for x in packed), b"".join(sketches)], strict=True)})


def test_a_family_does_not_make_all_its_pairs():
    import numpy as np

    from reelgrid.llm.near_copies import _across, _neighbours

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    family = [(k, 7, base[:20], np.concatenate([base[:97], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for k in range(500)]
    found = _neighbours(bucket_of(family), 0.8)
    assert len(set(found["a"].to_pylist()) | set(found["b"].to_pylist())) == 500 and found.num_rows <= 500 * 9  # of 124,750 pairs
    assert _across(bucket_of(family), 0.8).num_rows == 0
    strangers = [(k, k, base[:1], np.concatenate([base[:1], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])) for k in range(500)]
    assert _across(bucket_of(strangers), 0.8).num_rows == 0  # that only share a line


def test_pairs_across_groups_are_brute_force():
    import numpy as np

    from reelgrid.llm.near_copies import _across

    rng = np.random.default_rng(6)
    rows = []
    for k in range(40):
        base = rng.integers(0, 1 << 63, int(rng.choice([3, 60, 300, 900])), dtype=np.uint64)
        for m in range(int(rng.integers(1, 6))):
            own = np.concatenate([base[: max(1, int(len(base) * rng.choice([1, 0.95, 0.8])))], rng.integers(0, 1 << 63, int(len(base) * rng.choice([0, 0.05, 0.2])), dtype=np.uint64)])
            rows.append((100 * k + m, 100 * k + m // 2, own[:2], own))
    found = _across(bucket_of(rows), 0.8)
    got = set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
    near = {(r[0], q[0]) for r in rows for q in rows if r[0] < q[0] and r[1] != q[1] and len(np.intersect1d(r[2], q[2])) and len(np.intersect1d(r[3], q[3])) >= 0.8 * len(np.union1d(r[3], q[3])) - 1e-9}
    assert near <= got and len(near) > 30
    assert all(a < b and a // 100 == b // 100 for a, b in got)


def test_stage_asks_simhash(spark, monkeypatch):
    import corpus_pipeline
    from reelgrid.llm import near_copies

    asked = []
    links = near_copies.fingerprint_links
    monkeypatch.setattr(near_copies, "fingerprint_links", lambda prints, distance: asked.append((prints.count(), distance)) or links(prints, distance))
    docs = spark.createDataFrame([(k, f"one two three four five {k // 2}", "en", "s", 1) for k in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2, 4, 6]
    assert asked == [(4, 4)]
