"""From raw documents to packed training sequences: the stages in order, and a run over all of them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm import blocks
from reelgrid.llm.decontaminate import decontaminate
from reelgrid.llm.near_copies import without_near_copies
from reelgrid.llm.packing import pack
from reelgrid.llm.substring_dedup import substring_dedup
from reelgrid.llm.toxicity import toxicity

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edited(docs: DataFrame, operator: Callable[[DataFrame, str], DataFrame], changed: Column) -> DataFrame:
    """docs with the kept text of the rows that an operator has changed.

    What the operator takes for the id and hands back is the row's other columns: ids may be null or stand on several rows.
    """
    rest = F.struct("doc_id", "lang", "source", "n_chars", F.when(F.col("text").isNull(), True).alias("no_text"))
    told = operator(docs.select(rest.alias("row"), "text"), "row")
    text = F.when(F.col("id.no_text").isNull(), F.col("kept"))
    n_chars = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("id.n_chars"))
    return told.select("id.doc_id", text.alias("text"), "id.lang", "id.source", n_chars.alias("n_chars")).select(DOCUMENT)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not reject; all labels that join are learnt from."""
    verdict = toxicity(docs, _read(spark, sf_dir, "labels"), threshold=0.7, with_row=True)
    return verdict.filter("predicted = 0").select("row.*").select(DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    SimHash links are verified first; candidates that fingerprints do not reach follow, between groups that are still apart.
    """
    return without_near_copies(docs, shingle=5, similarity=0.8).select(DOCUMENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that also start elsewhere; texts without such stay as they are."""
    return _edited(docs, lambda rows, row: substring_dedup(rows, id_col=row), F.col("n_removed") > 0)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that benchmark items cover; texts without such stay as they are."""
    benchmark = _read(spark, sf_dir, "benchmark")
    return _edited(docs, lambda rows, row: decontaminate(rows, benchmark, id_col=row), F.col("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: Several stages have no SQL form; the run is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read by the next."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = blocks.kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
