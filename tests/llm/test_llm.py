"""Operators of the llm subpackage against brute force on small fixtures with nulls, empties, ties and repeats."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EXTRA = [(5000, None), (5001, ""), (5002, "a" * 450), (None, "é" * 300), (5003, "word " * 80), (5003, "word " * 80), (5004, "x y z <|endoftext|> It's DON'T é x'.. 12.5, (a)"), (5005, "Q! q-é X Y Z the end\x0b\x0c !!")]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def key(row):
    return tuple(map(str, row))


@pytest.fixture(scope="module")
def docs(spark):
    found = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(EXTRA, "doc_id long, text string")
    return found.unionByName(extra).withColumn("id", F.lit("clash")).withColumn("block", F.lit(1))


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def covered(sequence, counts, window):
    mask = [0] * len(sequence)
    for s in range(len(sequence) - window + 1):
        if counts[tuple(sequence[s : s + window])] > 1:
            mask[s : s + window] = [1] * window
    return mask


@pytest.mark.parametrize("hot", [2048, 3, 1])
def test_suffix_dedup(docs, rows, hot):
    from reelgrid.llm.suffix_dedup import suffix_dedup

    docs, rows = docs.filter("doc_id < 60 or doc_id >= 5000 or doc_id is null"), [r for r in rows if r[0] is None or r[0] < 60 or r[0] >= 5000]
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(tuple(t[s : s + 200]) for _, t in texts for s in range(len(t) - 199))
    want = []
    for i, t in texts:
        mask = covered(t, counts, 200)
        spans = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        want.append((i, len(t), sum(mask), spans, hashlib.sha256(bytes(b for b, m in zip(t, mask) if not m)).hexdigest()))
    assert sorted(map(key, suffix_dedup(docs, with_text=False, hot=hot).collect())) == sorted(map(key, want))


@pytest.mark.parametrize("hot", [2048, 3, 1])
def test_substring_dedup(docs, rows, hot):
    from reelgrid.llm.substring_dedup import substring_dedup

    texts = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(t[s : s + 35]) for _, t in texts for s in range(len(t) - 34))
    want = []
    for i, t in texts:
        mask = covered(t, counts, 35)
        want.append((i, len(t), sum(mask), hashlib.sha256(b" ".join(w for w, m in zip(t, mask) if not m)).hexdigest()))
    assert sorted(map(key, substring_dedup(docs, with_text=False, hot=hot).collect())) == sorted(map(key, want))


@pytest.mark.parametrize("chunk", [1 << 24, 3000])
def test_decontaminate(spark, docs, rows, chunk):
    from reelgrid.llm.decontaminate import decontaminate

    more = [(900, "x y. Z"), (901, None), (902, "!!"), (None, "word word word word")]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame(more, "item_id long, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in bench.collect():
        w = word.findall(low(r["text"]))
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows[tuple(w[s : s + n])].add(str(r["item_id"]) if r["item_id"] is not None else "null")
    want = []
    for i, t in rows:
        w, items = word.findall(low(t)), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit[s : s + n] = [1] * n
                    items |= found
        want.append((i, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), sum(hit) > 0))
    assert sorted(map(key, decontaminate(docs, bench, with_text=False, chunk_bytes=chunk).collect())) == sorted(map(key, want))


def test_simhash(docs, rows):
    import xxhash

    from reelgrid.llm.simhash import simhash_groups

    prints = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[s : s + 4]).encode(), 42) for s in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(parent)
    for a in names:
        for b in names:
            if a < b and (a ^ b).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    least = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root(p)].append(i)
    want = [(i, f"{p:016x}", min(least[root(p)], default=None)) for (i, _), p in zip(rows, prints)]
    assert sorted(map(key, simhash_groups(docs).collect())) == sorted(map(key, want))


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from reelgrid.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = pack(docs, path).collect()
    assert sorted(key(tuple(r)[:5]) for r in got) == sorted(map(key, want))
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for seats in bins.values():
        at = 0
        for offset, length in sorted(seats):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_ring(docs, rows):
    from reelgrid.llm import ring

    got = ring.ring_shards(docs).collect()
    assert sorted((str(r["id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    count = Counter(r["shard"] for r in got)
    assert max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in count.items())
    # By hand: slices by text, first node clockwise, what overflows goes on to the next other shard with room.
    seats = sorted((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:15], 16), s) for s in range(8) for v in range(64))
    held = Counter(int(hashlib.md5((t or "").encode()).hexdigest()[:12], 16) % 1024 for _, t in rows)
    room = [len(rows) // 8 + (s < len(rows) % 8) for s in range(8)]
    want, open_ = Counter(), {}
    for s in sorted(held):
        point = s * (2**60 // 1024)
        round_ = [x for p, x in seats if p >= point] + [x for p, x in seats if p < point]
        open_[s] = (list(dict.fromkeys(round_)), held[s])
    for k in range(8):
        for s, (order, n) in open_.items():
            take = min(n, room[order[k]])
            room[order[k]] -= take
            want[s, order[k]] += take
            open_[s] = (order, n - take)
    place = {(str(i), zlib.crc32((t or "").encode())): int(hashlib.md5((t or "").encode()).hexdigest()[:12], 16) % 1024 for i, t in rows}
    assert Counter((place[str(r["id"]), r["text_crc32"]], r["shard"]) for r in got) == +want


def test_ring_grows():
    from reelgrid.llm import ring

    before, after = ring.owners(8), ring.owners(9)
    assert all(b == a or a == 8 for b, a in zip(before, after)) and 0.04 < np.mean(before != after) < 0.25
    assert len(set(ring.owners(1000, ring.slices_for(1000)).tolist())) == 1000
    counts = np.random.default_rng(1).integers(0, 400, 1024)
    mean = counts.sum() / 8

    def moved(load):
        x, y = (ring.spread(counts, s, load) for s in (8, 9))
        return sum(max(0, n - dict(b).get(s, 0)) for a, b in zip(x, y) for s, n in a) / counts.sum()

    for load in (1.0, 1.25):
        held = Counter()
        for parts in ring.spread(counts, 8, load):
            for s, n in parts:
                held[s] += n
        assert sum(held.values()) == counts.sum() and max(held.values()) <= math.ceil(load * mean)
    assert moved(1.25) < 0.3 and moved(1.0) < 0.5


def test_warc(spark):
    from reelgrid.llm import blocks, warc

    pages = spark.createDataFrame([(1, "http://a.b/c?d", "same"), (2, None, "same"), (3, "http://x", "same"), (None, "u", None), (5, "http://q/", ""), (6, "http://q/", "WARC/1.1\r\n\r\nWARC-Type: response\r\n")], "page_id long, url string, html string")
    path = blocks.shared_path(spark, "warc")
    extra = pages.withColumn("of", F.lit(1)).withColumn("bytes", F.lit("clash")).withColumn("digest", F.lit(None).cast("string"))
    warc.write_captures(extra.unionByName(extra.filter("page_id = 1")), path, file_bytes=4000)
    again = warc.transactions(warc.read_records(spark, path)).collect()
    assert len(again) == 7 and all(r["request"] is not None and len(r["metadata"]) == 1 for r in again)
    none = blocks.shared_path(spark, "warc")
    warc.write_captures(extra.filter("false"), none)
    assert warc.transactions(warc.read_records(spark, none)).count() == 0
    path = blocks.shared_path(spark, "warc")
    warc.write_captures(pages, path)
    got = warc.transactions(warc.read_records(spark, path)).select("response.*", F.col("metadata")[0]["fields"][0]["value"].alias("page"), "request.fields").collect()
    kinds = {r["page"]: (r["record_type"], bytes(r["payload"])) for r in got}
    assert kinds == {"1": ("revisit", b""), "2": ("revisit", b""), "3": ("response", b"same"), "": ("revisit", b""), "5": ("response", b""), "6": ("response", b"WARC/1.1\r\n\r\nWARC-Type: response\r\n")}
    assert {r["payload_digest"] for r in got if r["page"] == "1"} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}


def test_embedding_groups(spark):
    from reelgrid.llm.embedding_dedup import embedding_groups

    rng = np.random.default_rng(3)
    centre = rng.normal(size=(60, 16))
    x = np.concatenate([centre[rng.integers(0, 60, 500)] + rng.normal(size=(500, 16)) * 0.12, rng.normal(size=(100, 16)), np.repeat(centre[:1], 5, axis=0)]).astype(np.float32)
    data = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [])]
    got = {r["id"]: r for r in embedding_groups(spark.createDataFrame(data, "vec_id long, embedding array<float>"), shard_rows=100).collect()}
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1)[:, None]
    near = wide @ wide.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[k]["n_links"] for k in range(len(x)))
    assert found >= 0.99 * near.sum() > 0 and all(got[k]["n_links"] <= near[k].sum() for k in range(len(x)))
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
    assert np.mean([got[k]["component_id"] == label[k] for k in range(len(x))]) > 0.99
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 905))


@pytest.mark.parametrize("asked_bytes", [1 << 26, 2000])
def test_ppm(docs, rows, asked_bytes):
    from reelgrid.llm import ppm

    docs, rows = docs.filter("doc_id < 40 or doc_id >= 5000 or doc_id is null"), [r for r in rows if r[0] is None or r[0] < 40 or r[0] >= 5000]

    def train(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 != 1

    order, words = ppm.ORDER, re.compile(r"[^\x20\x09-\x0D]+")
    trie, tokens = [defaultdict(Counter) for _ in range(order + 1)], Counter()

    def symbols(t):
        return [66] * order + list(low(t).encode()) + [65]

    for i, t in rows:
        if train(i):
            s = symbols(t)
            for p in range(order, len(s)):
                for k in range(order + 1):
                    trie[k][tuple(s[p - k : p])][s[p]] += 1
            tokens.update([*words.findall(low(t)), "\0"])
    total, different = sum(tokens.values()), len(tokens)

    def score(t):
        s, out = symbols(t), 0.0
        for p in range(order, len(s)):
            out_of = set()
            for k in range(order, -1, -1):
                table = trie[k].get(tuple(s[p - k : p]), {})
                left = {x: n for x, n in table.items() if x not in out_of}
                if s[p] in left:
                    out += math.log10((left[s[p]] - 0.5) / sum(left.values()))
                    break
                if left:
                    out += math.log10(0.5 * len(left) / sum(left.values()))
                out_of |= set(table)
            else:
                out -= math.log10(231 - len(out_of))
        return out

    got = {(r["id"], r["n_tokens"], round(r["score"], 5)): r for r in ppm.ppm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, asked_bytes=asked_bytes).collect()}
    for i, t in rows:
        w = [*words.findall(low(t)), "\0"]
        r = got[i, len(w), round(score(t), 5)]
        assert r["held_out"] == (not train(i)) and r["n_known"] == sum(tokens[x] > 0 for x in w) and r["train_tokens"] == total
        assert abs(r["base_score"] - sum(math.log10((tokens[x] + 0.5) / (total + 0.5 * (different + 1))) for x in w)) < 1e-6


def test_empty_tables(spark):
    from reelgrid.llm.decontaminate import decontaminate
    from reelgrid.llm.embedding_dedup import embedding_groups
    from reelgrid.llm.ppm import ppm_scores
    from reelgrid.llm.ring import ring_shards
    from reelgrid.llm.simhash import simhash_groups
    from reelgrid.llm.substring_dedup import substring_dedup

    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(none).count() == 0 and simhash_groups(none).count() == 0 and ring_shards(none).count() == 0
    assert ppm_scores(none, F.lit(True)).count() == 0
    assert decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf, kept = "/root/testdata/sf0.001", {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept[name] = stage(spark, docs, sf)
        assert kept[name].columns == corpus_pipeline.DOCUMENT
        kept[name].write.mode("overwrite").parquet(f"/tmp/reelgrid-test/{name}")
        docs = spark.read.parquet(f"/tmp/reelgrid-test/{name}")
    ids = {name: {r[0] for r in spark.read.parquet(f"/tmp/reelgrid-test/{name}").select("doc_id").collect()} for name in kept}
    assert ids["toxicity"] >= ids["simhash"] == ids["substring_dedup"] == ids["decontamination"]
    pieces = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == ids["decontamination"]
