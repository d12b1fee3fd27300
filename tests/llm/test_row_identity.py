"""Pipeline stages on rows with null and repeated ids: each row has its own verdict and its own text."""

from collections import Counter

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)


def words(tag, n=60):
    return " ".join(f"{tag}{k}" for k in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labelled rows 100 to 179, toxic where even, and a benchmark item."""
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(100 + k, 1, 1 - k % 2) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, words("item", 10))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_toxic_rows_by_row(spark, tables):
    import corpus_pipeline

    labelled = [(100 + k, (words(f"c{k}x", 5) + " fine mild calm") if k % 2 else (words(f"c{k}x", 5) + " vile foul crude")) for k in range(80)]
    rows = [(None, "vile foul crude"), (None, "fine mild calm"), (7, "vile foul crude"), (7, "fine mild calm"), (7, "fine mild calm"), (8, None)]
    got = corpus_pipeline.drop_toxic(spark, frame(spark, labelled + rows), tables)
    assert got.columns == corpus_pipeline.DOCUMENT
    left = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert left == Counter([r for r in labelled if "vile" not in r[1]] + [r for r in rows if r[1] is None or "vile" not in r[1]])


def test_repeats_by_row(spark, tables):
    import corpus_pipeline

    shared = words("both", 40)
    rows = [(None, f"{shared} a b"), (None, f"c {shared}"), (None, words("own")), (None, None), (5, f"{shared} d"), (5, words("other")), (6, "")]
    got = corpus_pipeline.cut_repeats(spark, frame(spark, rows), tables).collect()
    want = [(None, "a b"), (None, "c"), (None, words("own")), (None, None), (5, "d"), (5, words("other")), (6, "")]
    assert Counter((r["doc_id"], r["source"], r["text"], r["n_chars"]) for r in got) == Counter((i, f"s{k}", t, len(t or "")) for k, (i, t) in enumerate(want))


def test_benchmark_by_row(spark, tables):
    import corpus_pipeline

    item = words("item", 10)
    rows = [(None, f"x. {item}"), (None, f"{item} y"), (None, "clean  text"), (None, None), (5, item), (5, "kept")]
    got = corpus_pipeline.cut_benchmark(spark, frame(spark, rows), tables).collect()
    want = [(None, "x. "), (None, " y"), (None, "clean  text"), (None, None), (5, ""), (5, "kept")]
    assert Counter((r["doc_id"], r["source"], r["text"], r["n_chars"]) for r in got) == Counter((i, f"s{k}", t, len(t or "")) for k, (i, t) in enumerate(want))
