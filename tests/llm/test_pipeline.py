"""The whole pipeline against brute force, stage by stage, on rows with nulls, repeats, near copies and shared passages."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "item alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fixture_rows():
    rng, rows = random.Random(9), []
    shared = [f"shared{k}" for k in range(50)]
    for k in range(90):
        words = [f"d{k}w{rng.randrange(500)}" for _ in range(rng.choice([6, 60, 150]))] + ["plain", "calm"]
        if k % 6 == 0:
            words += ["vile", "foul"]
        if k % 7 == 1:
            words += shared
        if k % 8 == 3:
            words += ITEM.split()
        rows.append((k, " ".join(words)))
        if k % 5 == 2:
            words[3] = "changed"
            rows.append((100 + k if k % 2 else None, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, None), (None, None), rows[1], rows[1]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = fixture_rows()
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    return sf


def without_copies(rows):
    """Rows by group of near copies (five words, similarity 0.8): of each the smallest id's first."""

    def shingles(t):
        w = low(t).split()
        return frozenset(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                label = [label[j] if x == label[i] else x for x in label]
    groups = defaultdict(list)
    for k, row in zip(label, rows, strict=True):
        groups[k].append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def without_repeats(rows):
    words = [(t or "").split() for _, t in rows]
    counts = Counter(tuple(w[s : s + 35]) for w in words for s in range(len(w) - 34))
    out = []
    for (i, t), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - 34):
            if counts[tuple(w[s : s + 35])] > 1:
                gone.update(range(s, s + 35))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return out


def without_items(rows):
    item = WORD.findall(low(ITEM))
    windows = {tuple(item[s : s + 10]) for s in range(len(item) - 9)}
    out = []
    for i, t in rows:
        found = list(WORD.finditer(low(t)))
        hit = set()
        for s in range(len(found) - 9):
            if tuple(m[0] for m in found[s : s + 10]) in windows:
                hit.update(range(s, s + 10))
        text, spans = t, []
        for k in sorted(hit):
            if spans and spans[-1][1] == k - 1:
                spans[-1][1] = k
            else:
                spans.append([k, k])
        for a, b in reversed(spans):
            text = text[: found[a].start()] + text[found[b].end() :]
        out.append((i, text))
    return out


def as_bag(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_run_is_brute_force(spark, tables):
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    first = P.STAGES[0][1](spark, docs, tables)
    rows = list(as_bag(first).elements())
    # What toxicity scores is compared in test_toxicity.py; here: no row is made, nearly all toxic rows go and nearly all others stay.
    vile = [r for r in fixture_rows() if "vile" in (r[1] or "")]
    assert Counter(rows) <= Counter(fixture_rows())
    assert sum((Counter(rows) & Counter(vile)).values()) <= len(vile) // 5
    assert len(fixture_rows()) - len(vile) - len(rows) <= len(rows) // 10
    want = rows
    for brute in (without_copies, without_repeats, without_items):
        want = brute(want)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for i, t in want:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        lengths.update((i, k, min(2048, n - s)) for k, s in enumerate(range(0, n, 2048)))
    got = P.run(spark, tables).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in got) == lengths
    used = defaultdict(int)
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048 and len(used) == int(np.ceil(sum(used.values()) / 2048))


def test_stages_keep_rows_and_columns(spark, tables):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        none = stage(spark, docs.filter("false"), tables)
        assert none.columns == P.DOCUMENT and none.count() == 0, name
    five = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "c d", "en", "s", 3), (None, None, None, None, None), (None, "e f", "en", "s", 3), (None, "e g", "en", "s", 3)], SCHEMA)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, five, tables).count() == 5, name
