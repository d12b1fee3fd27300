"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import random
from functools import reduce
from math import floor
from operator import add

import duckdb
import pytest
from pyspark.sql import functions as F

from reelgrid.plans import registered
from reelgrid.plans.catalog import Tables, segment_rows, with_scenes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_matches_sql(spark, duck, name):
    df = registered.QUERIES[name](Tables(spark, SF))
    want = duck.sql(registered.SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_rate_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    """63 values that sum up to 3,200.00, a rate of 0.0196875: a sum of doubles is above or below by the order of its rows."""
    rng = random.Random(7)
    while True:
        cents = [rng.randrange(1, 10_000) for _ in range(62)]
        if 0 < (last := 320_000 - sum(cents)) < 10_000:
            break
    orders = [rng.sample([*cents, last], 63) for _ in range(40)]
    naive = {floor(63 / reduce(add, [c / 100 for c in o]) * 1e6 + 0.5) for o in orders}
    assert naive == {19687, 19688}
    rows = [(k, video, "view", c / 100, "{}") for video, o in enumerate(orders) for k, c in enumerate(o)]
    rows += [(0, 100, "view", float("nan"), "{}"), (0, 101, "view", None, "{}"), (0, 102, "view", 1e300, "{}"), (0, 103, "view", 1 / 3, "{}")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["video"]: r["rate_q"] for r in registered.QUERIES["agg_rate"](Tables(spark, str(tmp_path))).filter("video <> 100").collect()}
    assert got == dict.fromkeys(range(40), 19688) | {101: None, 102: 0, 103: 3000000}


def test_segments_of_a_short_stream(spark):
    cuts, found = {1, 4, 5, 10}, {1, 3, 4, 5, 7, 9, 10}
    frames = spark.createDataFrame([(1, k, k in cuts, k in found) for k in range(1, 12)], "video long, frame long, cut boolean, detected boolean")
    got = segment_rows(with_scenes(frames)).orderBy("segment").collect()
    assert [(r["frame_start"], r["frame_end"], r["scene"]) for r in got] == [(1, 3, 1), (4, 4, 2), (5, 9, 3), (10, 11, 4)]
