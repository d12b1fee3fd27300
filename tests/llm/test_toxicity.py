"""Toxicity scores against brute force: neighbours over all words, votes, evidence; and what held-out rows say."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_nearest_is_exact():
    from reelgrid.llm.toxicity import BlockMaxIndex

    rng = np.random.default_rng(5)
    for power in (0, 1, 2):
        x = rng.random((500, 60)) * (rng.random((500, 60)) < rng.choice([0.05, 0.2, 0.6], (500, 1))) / np.arange(1, 61) ** power
        x = x[x.any(axis=1)]
        x /= np.linalg.norm(x, axis=1)[:, None]
        doc, term = np.nonzero(x)
        index = BlockMaxIndex(60, doc, term, x[doc, term], np.zeros(len(x)), list(range(len(x))), width=16)
        for q in x[:60]:
            t = np.flatnonzero(q)
            near, score = index.nearest(t, q[t], 7)
            want = np.sort(x @ q)[::-1][:7]
            assert len(near) == min(7, (x @ q > 0).sum()) and np.allclose(score, want[: len(score)], atol=1e-6)
            assert np.allclose([x[index.ids[i]] @ q for i in near], score, atol=1e-6)


@pytest.mark.parametrize(("dense", "per_cell"), [(0, 0), (0, 1 << 30), (3, 0), (12, 1 << 30)])
def test_nearest_by_each_way(monkeypatch, dense, per_cell):
    """Frequent words from the dense table, rare ones by blocks or whole: the same neighbours, and frequent words are not read by posting."""
    from reelgrid.llm import toxicity

    monkeypatch.setattr(toxicity, "DENSE", dense)
    monkeypatch.setattr(toxicity, "PER_CELL", per_cell)
    rng = np.random.default_rng(6)
    x = rng.random((700, 90)) * (rng.random((700, 90)) < 1 / np.arange(1, 91) ** 0.7)
    x /= np.maximum(np.linalg.norm(x, axis=1)[:, None], 1e-9)
    doc, term = np.nonzero(x)
    index = toxicity.BlockMaxIndex(90, doc, term, x[doc, term], np.zeros(len(x)), list(range(len(x))), width=16)
    often = (x > 0).sum(axis=0) * dense >= 700
    assert (index.row >= 0).tolist() == often.tolist() and often.any() == bool(dense)
    place = index.at.copy()
    for w in np.flatnonzero(often):
        index.at[index.start[index.cells[w]] : index.start[index.cells[w + 1]]] = -1
    own, words = np.nonzero(x[:50])
    sums = index.frequent(own, words, x[own, words], 50)
    for q, told in zip(x[:50], sums, strict=True):
        t = np.flatnonzero(q)
        near, score = index.nearest(t, q[t], 7, told)
        assert np.allclose(score, np.sort(x @ q)[::-1][: len(score)], atol=1e-6) and len(near) == min(7, (x @ q > 1e-9).sum())
        assert np.allclose([x[index.ids[i]] @ q for i in near], score, atol=1e-6)
    assert (place >= 0).all()


def fixture_rows():
    rng = random.Random(2)
    bad, plain = ["vile", "foul", "crude"], [f"w{k}" for k in range(40)]
    rows = []
    for k in range(120):
        words = rng.choices(plain, k=rng.choice([2, 12, 30]))
        if k % 3 == 0:
            words += rng.choices(bad, k=2)
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    return rows + [(200, None), (201, ""), (202, "VILE foul"), (203, "nothing known here"), (None, "vile w1"), (None, None), (3, "vile w2 w3"), (204, "w1 w2 " * 3000), (205, rows[0][1]), (205, rows[0][1])]


@pytest.fixture(scope="module")
def tables(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(fixture_rows(), "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("label", F.lit(7)).withColumn("hash", F.lit(0))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(0, 0), (None, 1), (91, None), (999, 1), (200, 0)], "doc_id long, toxic int")
    return docs, labels


def test_score_is_brute_force(spark, tables):
    from reelgrid.llm.toxicity import CALIBRATE, _logit, fit, toxicity

    docs, labels = tables
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    label = {i: t for i, t in [(k, int(k % 3 == 0)) for k in range(90)] + [(200, 0)]}
    hashes = {r[0]: r[1] for r in spark.sql("select cast(col as long) as id, xxhash64(cast(col as long)) from explode(sequence(0, 300)) as t(col)").collect()}
    texts = {}
    for i, t in rows:
        if i in label:
            texts[i] = min(texts.get(i, t or ""), t or "")
    order = sorted(texts, key=lambda i: (hashes[i], i))
    inside = [i for k, i in enumerate(order) if k % CALIBRATE != CALIBRATE - 1]

    def bag(t):
        return Counter(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))

    n, toxic = len(inside), sum(label[i] for i in inside)
    held = {i: bag(texts[i]) for i in inside}
    df, bad = Counter(w for b in held.values() for w in b), Counter(w for i, b in held.items() for w in b if label[i])
    weight = {w: math.log((1 + n) / df[w]) * (n * (bad[w] * (n - df[w]) - (toxic - bad[w]) * (df[w] - bad[w])) ** 2 / (df[w] * (n - df[w]) * toxic * (n - toxic)) if df[w] < n else 0) for w in df}

    def unit(b):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in b.items() if weight.get(w, 0) > 0}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    examples = {i: unit(b) for i, b in held.items()}
    a, b = fit(docs, labels, "doc_id", "text", "toxic", 15, 20000).curve
    want = []
    for i, t in rows:
        q = unit(bag(t))
        cosine = sorted(((sum(x * e.get(w, 0) for w, x in q.items()), label[k]) for k, e in examples.items()), reverse=True)
        cosine = [c for c in cosine if c[0] > 0]
        if not cosine:
            want.append((str(i), toxic / n, toxic / n))
            continue
        scores = []
        least = cosine[min(15, len(cosine)) - 1][0]
        for ties in (0, 1):  # examples as near as the last one that counts may stand for each other
            near = sorted(cosine, key=lambda c: (-round(c[0], 5), c[1] != ties))[:15]
            pull = [1 / (1.05 - min(1, c)) for c, _ in near]
            vote = (sum(p * y for p, (_, y) in zip(pull, near)) + toxic / n) / (sum(pull) + 1)
            scores.append(float(1 / (1 + np.exp(-a - b * _logit(np.array([vote]))[0]))))
        want.append((str(i), min(scores), max(scores)))
        assert least > 0
    got = sorted((str(r["id"]), r["score"], r["predicted"], len(r["evidence"])) for r in toxicity(docs, labels).collect())
    want.sort()
    assert len(got) == len(want)
    for (i, score, predicted, evidence), (j, low, high) in zip(got, want, strict=True):
        assert i == j and low - 1e-3 <= score <= high + 1e-3 and predicted == (score >= 0.7)
    assert all(e <= 5 for *_, e in got)


def test_without_labels_or_rows(spark, tables):
    from reelgrid.llm.toxicity import toxicity

    docs, labels = tables
    assert {r["score"] for r in toxicity(docs, labels.filter("false")).collect()} == {0.0}
    assert {round(r["score"], 6) for r in toxicity(docs, labels.filter("toxic = 1")).collect()} == {1.0}
    assert toxicity(docs.filter("false"), labels).count() == 0


def test_bounds_hold(spark, tables):
    from reelgrid.llm.toxicity import fit

    docs, labels = tables
    votes = fit(docs, labels, "doc_id", "text", "toxic", 15, 20000, max_postings=200)
    assert 0 < len(votes.index.at) <= 200
    assert fit(docs, labels, "doc_id", "text", "toxic", 15, 20000, max_postings=0).index is None


def test_held_out(spark):
    from reelgrid.llm.queries import op7_toxicity

    sf = "/root/testdata/sf0.1"
    held = op7_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert held[held.predicted == 1].toxic.mean() >= 0.91 and held[held.toxic == 1].predicted.mean() >= 0.85
    assert (held.evidence.str.len() == 0).mean() < 0.05
