"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_read(spark, sf_dir, "documents"), window=200, with_text=False).withColumnRenamed("id", "doc_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import blocks, warc

    path = blocks.shared_path(spark, "warc")
    warc.write_captures(_read(spark, sf_dir, "pages"), path, least_revisit_bytes=0)
    capture = warc.transactions(warc.read_records(spark, path, with_payload=False))
    page = F.map_from_entries(F.col("metadata")[0]["fields"])["page-id"]
    capture = blocks.kept(capture.select(F.when(page != "", page).cast("long").alias("page_id"), "response.record_id", "response.record_type", "response.refers_to", "response.payload_bytes", "response.payload_digest"), "captures")
    known = capture.filter("record_type = 'response'").groupBy(F.col("record_id").alias("of")).agg(F.max("page_id").alias("refers_page"))
    resolved = capture.join(known, F.col("refers_to") == F.col("of"), "left")
    return resolved.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048).withColumnRenamed("id", "doc_id")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_groups

    return embedding_groups(_read(spark, sf_dir, "embeddings"), cosine=0.95).withColumnRenamed("id", "vec_id")


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import ppm_scores

    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    return ppm_scores(_read(spark, sf_dir, "documents"), train).withColumnRenamed("id", "doc_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(_read(spark, sf_dir, "documents"), shingle=4, distance=4).withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    scored = toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").filter(fold != 1), threshold=0.7).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_read(spark, sf_dir, "documents"), window=35, with_text=False).withColumnRenamed("id", "doc_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10, with_text=False).withColumnRenamed("id", "doc_id")


def op10_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ring import ring_shards

    placed = ring_shards(_read(spark, sf_dir, "documents"), shards=8).withColumnRenamed("id", "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(_read(spark, sf_dir, "embeddings"), components=4).withColumnRenamed("id", "vec_id")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import alignment

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment(_read(spark, sf_dir, "documents"), *paths).withColumnRenamed("id", "doc_id")


def op13_routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .routed_search import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_ppm": op5_ppm,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_ring": op10_ring,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_routed_search": op13_routed_search,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d""",
    "op8_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents), starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM d), wins AS (SELECT doc_id, s, array_to_string(ws[s:s + 34], ' ') AS k FROM starts),
rep AS (SELECT k FROM wins GROUP BY k HAVING count(*) > 1), hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM wins WHERE k IN (SELECT k FROM rep)), gone AS (SELECT doc_id, list(i) AS l FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(l), 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(l, []), i)), ' ')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)""",
}
