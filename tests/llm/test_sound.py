"""Words that a polynomial hash would take for equal, models without training texts, sessions without a shared folder."""

import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F


def twins(bits=10):
    """Two different words of 1,024 letters whose polynomial hashes modulo 2^64 are the same for every odd base."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def pair(spark):
    shared = " ".join(f"word{k}" for k in range(34))
    return spark.createDataFrame([(k, f"{word} {shared}") for k, word in enumerate(twins())], "doc_id long, text string")


def test_substring_dedup(pair):
    from reelgrid.llm.substring_dedup import substring_dedup

    assert {r["n_removed"] for r in substring_dedup(pair, with_text=False).collect()} == {0}


def test_decontaminate(spark, pair):
    from reelgrid.llm.decontaminate import decontaminate

    item = spark.createDataFrame([(1, twins()[1])], "item_id long, text string")
    assert sorted((r["id"], r["n_hit"]) for r in decontaminate(pair, item, with_text=False).collect()) == [(0, 0), (1, 1)]


def test_near_copies(spark):
    from reelgrid.llm.near_copies import without_near_copies

    rows = [(k, word, "en", "s", 1) for k, word in enumerate(twins())]
    assert without_near_copies(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), shingle=5, similarity=0.8).count() == 2


def test_ppm_tokens(pair):
    from reelgrid.llm.ppm import ppm_scores

    told = {r["id"]: r for r in ppm_scores(pair, F.col("doc_id") == 0).collect()}
    assert (told[0]["n_tokens"], told[0]["n_known"], told[1]["n_known"]) == (36, 36, 35)


def test_ppm_little_training(spark):
    from reelgrid.llm.ppm import SYMBOLS, ppm_scores

    docs = spark.createDataFrame([(1, "hello world"), (2, "zebra quiz")], "doc_id long, text string")
    told = {r["id"]: r for r in ppm_scores(docs, F.col("doc_id") == 1).collect()}
    assert (told[1]["n_known"], told[2]["n_known"], told[2]["train_tokens"]) == (3, 1, 3) and told[2]["score"] < told[1]["score"] < 0
    import math

    for r in ppm_scores(docs, F.lit(False)).collect():
        assert r["held_out"] and r["n_known"] == r["train_tokens"] == 0 and r["base_score"] == 0
        assert abs(r["score"] + math.log10(SYMBOLS) * (len("hello world") + 1 if r["id"] == 1 else len("zebra quiz") + 1)) < 1e-9


def test_no_shared_folder(tmp_path):
    """A local session without spark.checkpoint.dir keeps its tables in a folder of the warehouse."""
    code = """
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        from reelgrid.llm.ring import ring_shards
        from reelgrid.llm.simhash import simhash_groups
        docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
        assert ring_shards(docs).count() == 2 and simhash_groups(docs).count() == 2
    """
    import os

    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{top}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
