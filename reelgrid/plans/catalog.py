"""Queries by operator, each with the SQL that says the same, and the tables that they are bound to."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FPS = 30
WINDOW_FRAMES = 60

#: The bindings as SQL; `Tables` has the same as DataFrames.
FRAMES = """WITH numbered AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, event_id, event_type, value, props FROM events),
flagged AS (SELECT *, (frame - 1) / 30.0 AS ts_s, (frame = 1 OR event_type = 'signup') AS cut, event_type IN ('click', 'purchase') AS detected, CAST(1 + floor(value) % 3 AS BIGINT) AS itv FROM numbered),
frames AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame) AS BIGINT) AS scene, CAST(floor((frame - 1) / 60.0 + 1e-10) AS BIGINT) AS win FROM flagged)
"""
DETECTIONS = """WITH boxed AS (SELECT o_custkey AS video, l_orderkey AS frame, o_orderdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, l_suppkey AS track, l_partkey % 8 AS cls, 0.3 + 7 * l_discount AS conf,
CAST((37 * l_partkey + 11 * l_suppkey) % 1600 AS DOUBLE) AS x1, CAST((53 * l_partkey) % 800 AS DOUBLE) AS y1, l_quantity AS qty, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
det AS (SELECT *, x1 + 20 + 6 * qty AS x2, y1 + 30 + 5 * qty AS y2 FROM boxed)
"""
SEGMENTS = FRAMES + """, runs AS (SELECT *, lag(CASE WHEN detected THEN frame END IGNORE NULLS) OVER (PARTITION BY video, scene ORDER BY frame) AS before FROM frames),
segments AS (SELECT video, scene, win, min(frame) AS frame_start, max(frame) AS frame_end, count(*) AS n_frames, CAST(sum(CASE WHEN detected THEN 1 ELSE 0 END) AS BIGINT) AS n_detected, CAST(sum(CASE WHEN detected THEN 0 ELSE 1 END) AS BIGINT) AS n_predicted, row_number() OVER (PARTITION BY video ORDER BY min(frame)) AS segment FROM runs GROUP BY video, scene, win)
"""
GRIDS = """WITH bounds AS (SELECT vec_id, list_min(embedding) AS lo, list_max(embedding) AS hi, embedding FROM embeddings),
cells AS (SELECT vec_id, i, CAST((i - 1) // 8 AS BIGINT) AS r, (i - 1) % 8 AS c, (CAST(embedding[i] AS DOUBLE) - lo) / (CAST(hi AS DOUBLE) - lo) AS v FROM bounds, range(1, 65) AS g(i))
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


class Tables:
    """The driver's tables, and what they stand for: frames, detections, segments, grids."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def frames(self) -> DataFrame:
        """Events of a user as the frames of a video."""
        per = Window.partitionBy("video").orderBy("ts", "event_id")  # the name that later windows use, so that one exchange serves all
        e = self.read("events").select(F.col("user_id").alias("video"), "ts", "event_id", "event_type", "value", "props")
        e = e.select("video", F.row_number().over(per).cast("long").alias("frame"), "event_id", "event_type", "value", "props")
        return with_scenes(
            e.withColumns(
                {
                    "ts_s": (F.col("frame") - 1) / FPS,
                    "cut": (F.col("frame") == 1) | (F.col("event_type") == "signup"),
                    "detected": F.col("event_type").isin("click", "purchase"),
                    "itv": (1 + F.floor("value") % 3).cast("long"),
                }
            )
        )

    @cached_property
    def detections(self) -> DataFrame:
        """Lines of an order as what is seen in a frame of 1920 x 1080."""
        o = self.read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        j = self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        x1, y1 = ((37 * F.col("l_partkey") + 11 * F.col("l_suppkey")) % 1600).cast("double"), ((53 * F.col("l_partkey")) % 800).cast("double")
        return j.select(
            F.col("o_custkey").alias("video"), F.col("l_orderkey").alias("frame"), "o_orderdate", (F.row_number().over(order) - 1).cast("long").alias("idx"), F.col("l_suppkey").alias("track"), (F.col("l_partkey") % 8).alias("cls"),
            (0.3 + 7 * F.col("l_discount")).alias("conf"), x1.alias("x1"), y1.alias("y1"), F.col("l_quantity").alias("qty"), "l_partkey", "l_suppkey", "l_linenumber",
            (x1 + 20 + 6 * F.col("l_quantity")).alias("x2"), (y1 + 30 + 5 * F.col("l_quantity")).alias("y2"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        return segment_rows(self.frames)

    @cached_property
    def cells(self) -> DataFrame:
        """Embeddings as grids of 8 x 8 in [0, 1], a row per cell."""
        e = self.read("embeddings").select("vec_id", "embedding", F.array_min("embedding").alias("lo"), F.array_max("embedding").alias("hi"))
        c = e.select("vec_id", "lo", "hi", F.posexplode("embedding").alias("p", "raw"))
        lo = F.col("lo").cast("double")
        return c.select("vec_id", (F.col("p") + 1).cast("long").alias("i"), F.floor(F.col("p") / 8).cast("long").alias("r"), (F.col("p") % 8).cast("long").alias("c"), ((F.col("raw").cast("double") - lo) / (F.col("hi").cast("double") - lo)).alias("v"))


def with_scenes(frames: DataFrame) -> DataFrame:
    """Scene number: running count of cuts; window: tumbling by frame start, whatever the scene."""
    per = Window.partitionBy("video").orderBy("frame")
    return frames.withColumns({"scene": F.sum(F.col("cut").cast("long")).over(per), "win": F.floor((F.col("frame") - 1) / float(WINDOW_FRAMES) + 1e-10).cast("long")})


def segment_rows(frames: DataFrame) -> DataFrame:
    """A row per run of frames of one scene and window, numbered within the video."""
    found, missed = F.col("detected").cast("long"), (~F.col("detected")).cast("long")
    rows = frames.groupBy("video", "scene", "win").agg(F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"), F.count("*").alias("n_frames"), F.sum(found).alias("n_detected"), F.sum(missed).alias("n_predicted"))
    return rows.withColumn("segment", F.row_number().over(Window.partitionBy("video").orderBy("frame_start")).cast("long"))


def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: QUERIES[name](Tables(spark, sf_dir))
