"""Cross-tokenizer alignment against a token-by-token version that tokenizes whole texts."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = [None, "", " ", "   ", "  lead  and  wide  x\n \n  y\t z  ", "▁x <|endoftext|> <s> <0x41>", "é è  日本 語　 の   x é  y", "a" * 3000, "It's  we'll DON'T\r\n  x", "\x00\x01 \x1f x \x85 y   z", "x é ﬁ 🙂🙂 ​‍", "foo\n  bar \n\n  baz .  .", "<|endoftext|>", "a b", "a b"]


def texts():
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "a", "B", "é", "日", " ", " ", "　", "'s", "1", "!", "🙂"]
    return EXTRA + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def brute(rows):
    from reelgrid.llm.alignment import _tokenizers

    of, told, count = _tokenizers(*PATHS), [], Counter()
    for i, text in rows:
        whole, groups = (" " + (text or "")).encode(), []
        a, b = of.a.encode(" " + (text or ""), add_special_tokens=False).ids, of.b.encode(text or "")
        spelt_a, spelt_b = [of.a_bytes[k] for k in a], [of.b_bytes[k] for k in b]
        if not text or b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
            a, b, spelt_a, spelt_b = [], [], [], []
        ends = [[sum(map(len, spelt[: k + 1])) for k in range(len(spelt))] for spelt in (spelt_a, spelt_b)] if len(a) < 200 else [list(__import__("itertools").accumulate(map(len, s))) for s in (spelt_a, spelt_b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        held = [defaultdict(list), defaultdict(list)]
        for side, ids in ((0, a), (1, b)):
            for k, e in zip(ids, ends[side]):
                held[side][bisect.bisect_left(cuts, e)].append(k)
        groups = [(held[0][g], held[1][g]) for g in range(len(cuts))]
        told.append((i, a, b, groups))
        count.update({(x, y) for p, q in groups for x in p for y in q})
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for i, a, b, groups in told:
        links = [(x, y) for p, q in groups for x in p for y in q]
        line = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return out, count, top


@pytest.fixture(scope="module")
def docs(spark):
    found = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(None if k == 3 else 9000 + k, t) for k, t in enumerate(texts())] + [(9000, "again"), (9000, "again")]
    return found.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumns({"id": F.lit("clash"), "block": F.lit(1), "key": F.lit(2), "n_a": F.lit(3)})


@pytest.mark.parametrize("block_bytes", [8 << 20, 1 << 15])
def test_alignment(docs, block_bytes):
    from reelgrid.llm.alignment import _tokenizers, aligned_pairs, alignment

    assert _tokenizers(*PATHS).parts and _tokenizers(*PATHS).ranks is not None
    want, count, top = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = alignment(docs, *PATHS, block_bytes=block_bytes)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    pairs = aligned_pairs(docs, *PATHS, block_bytes=block_bytes, salts=3).collect()
    assert {(r["a_id"], r["b_id"]): (r["documents"], r["best"]) for r in pairs} == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_whole_texts(monkeypatch, docs):
    """Tokenizers that may not be split by chunks take whole texts and give the same."""
    from reelgrid.llm import alignment as A

    of = A.Tokenizers(*PATHS)
    of.parts, of.ranks = False, None
    import pyarrow as pa

    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id >= 9000").collect()]
    data = pa.table({"id": [i for i, _ in rows], "text": pa.array([(t or "").encode() for _, t in rows], pa.binary())})
    one, other = A._encoded(data, of), A._encoded(data, A._tokenizers(*PATHS))
    assert one[0].equals(other[0]) and (one[2] == other[2]).all() and (one[3] == other[3]).all()


def test_empty(spark):
    from reelgrid.llm.alignment import alignment

    assert alignment(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
    assert [tuple(r)[1:] for r in alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *PATHS).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
