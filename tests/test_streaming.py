"""Segments as a stream: triggers, late frames, failure, restart from a checkpoint; and shuffles of the batch plans."""

import random

import pytest

from reelgrid.operators import timeline
from reelgrid.plans import registered
from reelgrid.plans.catalog import Tables, segment_rows, with_scenes
from reelgrid.streaming.segments import Segments, segment_stream

SCHEMA = "video long, frame long, ts timestamp, cut boolean, detected boolean, interval int, failed boolean, done boolean"


def frame(video, number, cut=False, detected=True, failed=False, done=False):
    from datetime import datetime, timedelta

    return (video, number, datetime(2024, 1, 1) + timedelta(seconds=number / 30), cut, detected, 1 + number % 2, failed, done)


def streamed(spark, folder, triggers, window=4, early=False, restart_after=None):
    """The rows that a stream gives for a list of triggers, each a file; with a stop and a start from the checkpoint in between."""
    source, out, kept = (str(folder / n) for n in ("in", "out", "checkpoint"))

    def put(k, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/part={k:03d}")

    def run():
        read = spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
        query = segment_stream(read.drop("part"), window, early=early).writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    cut = len(triggers) if restart_after is None else restart_after
    for k, rows in enumerate(triggers[:cut]):
        put(k, rows)
    run()
    if cut < len(triggers):
        for k, rows in enumerate(triggers[cut:], cut):
            put(k, rows)
        run()
    return sorted(spark.read.parquet(out).collect(), key=lambda r: (r["video"], r["segment"], r["final"], r["frame_end"]))


def bounds(rows):
    return [(r["video"], r["frame_start"], r["frame_end"], r["reason"]) for r in rows]


def test_stream_over_restart_equals_batch(spark, tmp_path):
    """Two videos in four triggers, frames of a trigger shuffled, stopped half-way: the segments of the batch, each once."""
    cuts, found = {1, 4, 5, 10}, {1, 3, 4, 5, 7, 9, 10}
    every = [[frame(v, k, k in cuts, k in found, done=k == 11) for v in (1, 2) for k in range(s, s + 3) if k <= 11] for s in (1, 4, 7, 10)]
    for part in every:
        random.Random(3).shuffle(part)
    got = streamed(spark, tmp_path, every, restart_after=2)
    assert bounds(r for r in got if r["video"] == 1) == [(1, 1, 3, "scene"), (1, 4, 4, "interval"), (1, 5, 8, "interval"), (1, 9, 9, "scene"), (1, 10, 11, "end")]
    batch = segment_rows(with_scenes(spark.createDataFrame([(v, k, k in cuts, k in found) for v in (1, 2) for k in range(1, 12)], "video long, frame long, cut boolean, detected boolean")))
    rows = {(r["video"], r["scene"]): 0 for r in batch.collect()}
    for r in got:  # the batch has windows of 60 frames: scenes are what both have
        rows[r["video"], r["scene"]] += r["n_frames"]
    assert rows == {(r["video"], r["scene"]): r["n_frames"] for r in batch.collect()}
    first = [r for r in got if r["video"] == 1]
    assert [r["n_detected"] for r in first] == [2, 1, 2, 1, 1] and first[0]["gaps"] == {"2": 1} and first[2]["gaps"] == {"2": 1} and first[3]["gaps"] == {"2": 1} and first[4]["gaps"] == {}
    assert all(r["final"] and sum(r["intervals"].values()) == r["n_frames"] and r["late"] == 0 for r in got)


def test_late_frames_and_early_rows(spark, tmp_path):
    """A frame that comes again or too late is dropped and counted by the open segment; open segments show in every trigger."""
    got = streamed(spark, tmp_path, [[frame(1, 1, True), frame(1, 3)], [frame(1, 2), frame(1, 3), frame(1, 4)], [frame(1, 5, done=True)]], early=True)
    final = [r for r in got if r["final"]]
    assert bounds(final) == [(1, 1, 4, "interval"), (1, 5, 5, "end")] and [(r["n_frames"], r["missing"], r["late"]) for r in final] == [(3, 1, 2), (1, 0, 0)]
    assert [(r["frame_end"], r["reason"]) for r in got if not r["final"]] == [(3, None)]


def test_failure_keeps_what_is_finished(spark, tmp_path):
    """The failed frame and the open segment are not reported, nor what follows; finished segments stay."""
    first = [frame(1, k, k in {1, 4, 5}, failed=k == 7) for k in range(1, 8)]
    got = streamed(spark, tmp_path, [first, [frame(1, 8), frame(1, 9, done=True)]], window=100)
    assert bounds(got) == [(1, 1, 3, "scene"), (1, 4, 4, "scene")]


def test_silent_videos_end(spark, tmp_path):
    """A video without a last frame ends once the watermark has passed it; another one's frames move the watermark."""
    later = [frame(2, 30 * 60 * 30, True), frame(2, 30 * 60 * 30 + 1)]
    got = streamed(spark, tmp_path, [[frame(1, 1, True), frame(1, 2)], later, [frame(2, 30 * 60 * 60, done=True)]], window=10**9)
    assert (1, 1, 2, "end") in bounds(got)


def test_frames_of_a_window(spark):
    """The window's last frame ends its segment at once; fractional windows too; a video that is done takes nothing more."""
    video = Segments(2.5)
    ends = [(r["frame_end"], r["reason"]) for k in range(1, 8) for r in video.take(k, k == 1, True, 1, False, k == 7)]
    assert ends == [(3, "interval"), (5, "interval"), (7, "end")]
    assert video.take(8, False, True, 1, False, False) == [] and Segments(2.5, video.state()).closed


@pytest.mark.parametrize("name", ["win_scene_index", "win_ring16", "win_ema", "win_cooldown", "dec_camera", "dec_lost", "trk_step", "agg_run_counters", "agg_segment", "win_cumulative_counters"])
def test_frames_are_shuffled_once(spark, name):
    """Numbers, scenes, windows and folds of a video all rest on one exchange by video."""
    plan = registered.QUERIES[name](Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_maps_meet_by_a_join(spark):
    plan = registered.QUERIES["sal_refresh"](Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" in plan


def test_no_kinds(spark):
    none = spark.createDataFrame([], "video long, frame long, scene long, win long, event_type string")
    assert timeline.counters(none).count() == 0
