"""Scans, windows and segments over frames in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import q6
from ..plans.catalog import FRAMES, SEGMENTS, Tables, query


def per_video() -> WindowSpec:
    return Window.partitionBy("video").orderBy("frame")


def per_scene() -> WindowSpec:
    return Window.partitionBy("video", "scene").orderBy("frame")



@query("src_frames_cv", FRAMES + "SELECT video, frame, event_id FROM frames")
def src_frames_cv(t: Tables) -> DataFrame:
    return t.frames.select("video", "frame", "event_id")


@query("src_frames_tc", FRAMES + "SELECT video, CAST((frame - 1) // 8 AS BIGINT) AS batch, count(*) AS n, min(frame) AS first_frame FROM frames GROUP BY video, batch")
def src_frames_tc(t: Tables) -> DataFrame:
    return t.frames.groupBy("video", F.floor((F.col("frame") - 1) / 8).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"))


@query("src_pts_check", FRAMES + "SELECT video, frame FROM frames WHERE abs(ts_s + CASE WHEN event_id % 97 = 0 THEN 0.002 ELSE 0 END - (frame - 1) / 30.0) > 0.001")
def src_pts_check(t: Tables) -> DataFrame:
    pts = F.col("ts_s") + F.when(F.col("event_id") % 97 == 0, 0.002).otherwise(0.0)
    return t.frames.filter((F.abs(pts - (F.col("frame") - 1) / 30.0) > 0.001) | F.isnan(pts)).select("video", "frame")


@query("src_first_then_rest", FRAMES + "SELECT video, count(*) AS n, CAST(sum(frame) AS BIGINT) AS s FROM frames GROUP BY video")
def src_first_then_rest(t: Tables) -> DataFrame:
    again = t.frames.filter("frame = 1").unionByName(t.frames.filter("frame > 1"))
    return again.groupBy("video").agg(F.count("*").alias("n"), F.sum("frame").alias("s"))


@query("src_limit", FRAMES + "SELECT video, frame, event_type FROM frames WHERE frame <= 10")
def src_limit(t: Tables) -> DataFrame:
    return t.frames.filter("frame <= 10").select("video", "frame", "event_type")


@query("src_prepass_scenes", FRAMES + "SELECT DISTINCT video, frame AS scene_start FROM frames WHERE frame = 1 OR event_type = 'signup'")
def src_prepass_scenes(t: Tables) -> DataFrame:
    starts = t.frames.filter("event_type = 'signup'").select("video", F.col("frame").alias("scene_start"))
    return t.frames.select("video", F.lit(1).cast("long").alias("scene_start")).unionByName(starts).distinct()


@query("win_tumbling", FRAMES + "SELECT video, win, count(*) AS n FROM frames GROUP BY video, win")
def win_tumbling(t: Tables) -> DataFrame:
    return t.frames.groupBy("video", "win").agg(F.count("*").alias("n"))


@query("win_scene_index", FRAMES + "SELECT video, frame, scene FROM frames")
def win_scene_index(t: Tables) -> DataFrame:
    return t.frames.select("video", "frame", "scene")


SEGMENT_COLUMNS = "video, segment, scene, win, frame_start, frame_end, n_frames, n_detected, n_predicted"


@query("win_segment_islands", SEGMENTS + "SELECT video, segment, scene, win FROM segments")
def win_segment_islands(t: Tables) -> DataFrame:
    return t.segments.select("video", "segment", "scene", "win")


def agg_segment(segments: DataFrame) -> DataFrame:
    """Segment rows with times and why each ended: the last of a video at its end, others at a cut or a window."""
    nxt = F.lead("scene").over(Window.partitionBy("video").orderBy("segment"))
    reason = F.when(nxt.isNull(), "end").when(nxt != F.col("scene"), "scene").otherwise("interval")
    return segments.select(*SEGMENT_COLUMNS.split(", "), q6((F.col("frame_start") - 1) / 30.0).alias("start_q"), q6(F.col("frame_end") / 30.0).alias("end_q"), reason.alias("reason"))


@query(
    "agg_segment",
    SEGMENTS
    + f"""SELECT {SEGMENT_COLUMNS}, CAST(floor((frame_start - 1) / 30.0 * 1e6 + 0.5) AS BIGINT) AS start_q, CAST(floor(frame_end / 30.0 * 1e6 + 0.5) AS BIGINT) AS end_q,
CASE WHEN lead(scene) OVER w IS NULL THEN 'end' WHEN lead(scene) OVER w <> scene THEN 'scene' ELSE 'interval' END AS reason FROM segments WINDOW w AS (PARTITION BY video ORDER BY segment)""",
)
def agg_segment_query(t: Tables) -> DataFrame:
    return agg_segment(t.segments)


def detection_gaps(frames: DataFrame) -> DataFrame:
    """Frames since the last real detection of the scene, for each detection that has one before it."""
    before = F.last(F.when(F.col("detected"), F.col("frame")), ignorenulls=True).over(per_scene().rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumn("before", before).filter("detected AND before IS NOT NULL").withColumn("gap", F.col("frame") - F.col("before"))


@query("win_detection_gap", SEGMENTS + "SELECT video, frame, frame - before AS gap FROM runs WHERE detected AND before IS NOT NULL")
def win_detection_gap(t: Tables) -> DataFrame:
    return detection_gaps(t.frames).select("video", "frame", "gap")


@query("agg_gap_hist", SEGMENTS + "SELECT video, scene, win, frame - before AS gap, count(*) AS n FROM runs WHERE detected AND before IS NOT NULL GROUP BY ALL")
def agg_gap_hist(t: Tables) -> DataFrame:
    return detection_gaps(t.frames).groupBy("video", "scene", "win", "gap").agg(F.count("*").alias("n"))


@query("agg_interval_hist", FRAMES + "SELECT video, itv, count(*) AS n FROM frames GROUP BY video, itv")
def agg_interval_hist(t: Tables) -> DataFrame:
    return t.frames.groupBy("video", "itv").agg(F.count("*").alias("n"))


@query("agg_reason_hist", FRAMES + "SELECT event_type AS reason, count(*) AS n FROM frames GROUP BY reason")
def agg_reason_hist(t: Tables) -> DataFrame:
    return t.frames.groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


@query("agg_run_counters", FRAMES + "SELECT video, count(*) AS n_frames, count_if(cut) AS n_resets, count_if(detected) AS n_detected FROM frames GROUP BY video")
def agg_run_counters(t: Tables) -> DataFrame:
    return t.frames.groupBy("video").agg(F.count("*").alias("n_frames"), F.count_if("cut").alias("n_resets"), F.count_if("detected").alias("n_detected"))


@query("agg_rate", FRAMES + "SELECT video, CASE WHEN sum(value) > 0 THEN CAST(floor(count(*) / sum(value) * 1e6 + 0.5) AS BIGINT) END AS rate_q FROM frames GROUP BY video")
def agg_rate(t: Tables) -> DataFrame:
    # Decimals are summed exactly: where the rate is half a millionth, a sum of doubles rounds by the order of its rows.
    exact = F.col("value").try_cast("decimal(28,10)")
    inexact = F.count_if(F.col("value").isNotNull() & F.coalesce(exact.cast("double") != F.col("value"), F.lit(True)))
    total = F.when(inexact == 0, F.sum(exact).cast("double")).otherwise(F.sum("value"))
    return t.frames.groupBy("video").agg(F.when(total > 0, q6(F.count("*") / total)).alias("rate_q"))


@query("win_prev_frame_delta", FRAMES + "SELECT video, frame, CAST(floor(abs(value - lag(value) OVER (PARTITION BY video ORDER BY frame)) * 1e6 + 0.5) AS BIGINT) AS delta_q FROM frames")
def win_prev_frame_delta(t: Tables) -> DataFrame:
    return t.frames.select("video", "frame", q6(F.abs(F.col("value") - F.lag("value").over(per_video()))).alias("delta_q"))


@query("win_ring16", FRAMES + "SELECT video, frame, count(*) OVER w AS held, CASE WHEN count(*) OVER w = 16 THEN CAST(floor(max(value) OVER w * 1e6 + 0.5) AS BIGINT) END AS top_q FROM frames WINDOW w AS (PARTITION BY video, scene ORDER BY frame ROWS 15 PRECEDING)")
def win_ring16(t: Tables) -> DataFrame:
    ring = per_scene().rowsBetween(-15, 0)
    held = F.count("*").over(ring)
    return t.frames.select("video", "frame", held.alias("held"), F.when(held == 16, q6(F.max("value").over(ring))).alias("top_q"))


@query("win_motion_range", FRAMES + "SELECT video, frame, count(*) OVER (PARTITION BY video, scene ORDER BY frame RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS held FROM frames")
def win_motion_range(t: Tables) -> DataFrame:
    return t.frames.select("video", "frame", F.count("*").over(per_scene().rangeBetween(-12, 0)).alias("held"))


def run_lengths(frames: DataFrame, flag: str) -> DataFrame:
    """How many frames in a row, up to this one, the flag has held within the video; 0 where it does not."""
    island = F.sum((~F.col(flag)).cast("long")).over(per_video())
    marked = frames.withColumn("island", island)
    return marked.withColumn("run", F.sum(F.col(flag).cast("long")).over(Window.partitionBy("video", "island").orderBy("frame")))


RUNS = FRAMES + ", isl AS (SELECT *, sum(CASE WHEN detected THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY frame) AS island FROM frames), runl AS (SELECT *, CAST(sum(CASE WHEN detected THEN 1 ELSE 0 END) OVER (PARTITION BY video, island ORDER BY frame) AS BIGINT) AS run FROM isl)\n"


@query("win_stable_run", RUNS + "SELECT video, frame, run FROM runl")
def win_stable_run(t: Tables) -> DataFrame:
    return run_lengths(t.frames, "detected").select("video", "frame", "run")


@query("win_measurement_runs", RUNS + "SELECT video, max(run) AS longest FROM runl GROUP BY video")
def win_measurement_runs(t: Tables) -> DataFrame:
    return run_lengths(t.frames, "detected").groupBy("video").agg(F.max("run").alias("longest"))


@query("sal_fallback", RUNS + "SELECT video, min(frame) AS disabled_at FROM runl WHERE run >= 3 GROUP BY video")
def sal_fallback(t: Tables) -> DataFrame:
    return run_lengths(t.frames, "detected").filter("run >= 3").groupBy("video").agg(F.min("frame").alias("disabled_at"))


@query("win_stable_duration", RUNS + "SELECT video, frame, CAST(floor((ts_s - min(ts_s) OVER (PARTITION BY video, island)) * 1e6 + 0.5) AS BIGINT) AS held_q FROM runl WHERE detected")
def win_stable_duration(t: Tables) -> DataFrame:
    runs = run_lengths(t.frames, "detected").filter("detected")
    return runs.select("video", "frame", q6(F.col("ts_s") - F.min("ts_s").over(Window.partitionBy("video", "island"))).alias("held_q"))


@query("win_switch_count", FRAMES + "SELECT video, count_if(event_type <> before) AS switches FROM (SELECT video, event_type, lag(event_type) OVER (PARTITION BY video ORDER BY frame) AS before FROM frames) GROUP BY video")
def win_switch_count(t: Tables) -> DataFrame:
    return t.frames.withColumn("before", F.lag("event_type").over(per_video())).groupBy("video").agg(F.count_if(F.col("event_type") != F.col("before")).alias("switches"))


@query("win_fixed_interval", FRAMES + "SELECT video, frame FROM (SELECT video, frame, row_number() OVER (PARTITION BY video, scene ORDER BY frame) AS k FROM frames) WHERE (k - 1) % 5 = 0")
def win_fixed_interval(t: Tables) -> DataFrame:
    return t.frames.withColumn("k", F.row_number().over(per_scene())).filter("(k - 1) % 5 = 0").select("video", "frame")


COUNTERS = FRAMES + ", kinds AS (SELECT DISTINCT event_type AS key FROM frames), counters AS (SELECT video, frame, segment_no, key, CAST(sum(CASE WHEN event_type = key THEN 1 ELSE 0 END) OVER (PARTITION BY video, key ORDER BY frame) AS BIGINT) AS total FROM (SELECT *, scene * 4294967296 + win AS segment_no FROM frames) CROSS JOIN kinds)\n"


def running(frames: DataFrame) -> DataFrame:
    """video, frame, segment_no and totals: an array (key, total) of how many frames of each kind there have been; a row per frame, one window.

    The kinds are read from the table first; they are a handful.
    """
    kinds = [r["event_type"] for r in frames.select("event_type").distinct().orderBy("event_type").collect()]
    totals = [F.struct(F.lit(k).alias("key"), F.sum((F.col("event_type") == F.lit(k)).cast("long")).over(per_video()).alias("total")) for k in kinds if k is not None]
    return frames.select("video", "frame", (F.col("scene") * (1 << 32) + F.col("win")).alias("segment_no"), (F.array(*totals) if totals else F.array().cast("array<struct<key:string,total:bigint>>")).alias("totals"))


def counters(frames: DataFrame) -> DataFrame:
    """Running totals of each kind of event, a row per frame and kind."""
    return running(frames).select("video", "frame", "segment_no", F.inline("totals"))


@query("win_cumulative_counters", COUNTERS + "SELECT video, frame, key, total FROM counters")
def win_cumulative_counters(t: Tables) -> DataFrame:
    return counters(t.frames).select("video", "frame", "key", "total")


@query("agg_snapshot", COUNTERS + "SELECT video, segment_no, key, max(total) AS total FROM counters GROUP BY ALL")
def agg_snapshot(t: Tables) -> DataFrame:
    last = running(t.frames).groupBy("video", "segment_no").agg(F.max_by("totals", "frame").alias("totals"))
    return last.select("video", "segment_no", F.inline("totals"))


def deltas(snapshots: DataFrame) -> DataFrame:
    """What each segment adds to every counter; a counter not seen before counts from 0."""
    before = F.lag("total").over(Window.partitionBy("video", "key").orderBy("segment_no"))
    return snapshots.withColumn("delta", F.col("total") - F.coalesce(before, F.lit(0)))


@query("agg_delta", COUNTERS + "SELECT video, segment_no, key, total - coalesce(lag(total) OVER (PARTITION BY video, key ORDER BY segment_no), 0) AS delta FROM (SELECT video, segment_no, key, max(total) AS total FROM counters GROUP BY ALL)")
def agg_delta(t: Tables) -> DataFrame:
    return deltas(agg_snapshot(t)).select("video", "segment_no", "key", "delta")


@query("aud_counter_monotone", COUNTERS + "SELECT video, frame, key FROM (SELECT *, lag(total) OVER (PARTITION BY video, key ORDER BY frame) AS before FROM (SELECT video, frame, key, total - CASE WHEN (video + frame) % 31 = 0 THEN 2 ELSE 0 END AS total FROM counters)) WHERE total < before")
def aud_counter_monotone(t: Tables) -> DataFrame:
    told = counters(t.frames).withColumn("total", F.col("total") - F.when((F.col("video") + F.col("frame")) % 31 == 0, 2).otherwise(0))
    return falls(told)


def falls(told: DataFrame) -> DataFrame:
    """Frames at which a counter (video, key, frame, total) is less than before."""
    before = F.lag("total").over(Window.partitionBy("video", "key").orderBy("frame"))
    return told.withColumn("before", before).filter("total < before").select("video", "frame", "key")


@query("snk_progress", FRAMES + "SELECT video, frame, concat('Frame ', frame) AS line FROM frames WHERE frame % 50 = 0")
def snk_progress(t: Tables) -> DataFrame:
    return t.frames.filter("frame % 50 = 0").select("video", "frame", F.concat(F.lit("Frame "), F.col("frame").cast("string")).alias("line"))


@query("agg_timing_phases", FRAMES + "SELECT video, event_type AS phase, CAST(floor(sum(nxt - ts_s) * 1e6 + 0.5) AS BIGINT) AS seconds_q FROM (SELECT *, lead(ts_s) OVER (PARTITION BY video ORDER BY frame) AS nxt FROM frames) WHERE nxt IS NOT NULL GROUP BY video, phase")
def agg_timing_phases(t: Tables) -> DataFrame:
    """Seconds from each switch of phase to the next, summed by phase."""
    spans = t.frames.withColumn("nxt", F.lead("ts_s").over(per_video())).filter("nxt IS NOT NULL")
    return spans.groupBy("video", F.col("event_type").alias("phase")).agg(q6(F.sum(F.col("nxt") - F.col("ts_s"))).alias("seconds_q"))


@query("agg_age_bins", SEGMENTS + "SELECT CASE WHEN age <= 1e-9 THEN '0' WHEN age <= 0.05 + 1e-9 THEN '0-.05' WHEN age <= 0.1 + 1e-9 THEN '.05-.1' ELSE 'over_.1' END AS bin, count(*) AS n FROM (SELECT (CASE WHEN detected THEN 0 ELSE frame - before END) / 30.0 AS age FROM runs WHERE detected OR before IS NOT NULL) GROUP BY bin")
def agg_age_bins(t: Tables) -> DataFrame:
    """How old each frame's last real measurement is."""
    last = F.last(F.when(F.col("detected"), F.col("frame")), ignorenulls=True).over(per_scene())
    aged = t.frames.select(((F.col("frame") - last) / 30.0).alias("age")).filter("age IS NOT NULL")
    return aged.groupBy(_age_bin(F.col("age")).alias("bin")).agg(F.count("*").alias("n"))


def _age_bin(age: Column) -> Column:
    tol = 1e-9
    return F.when(age <= tol, "0").when(age <= 0.05 + tol, "0-.05").when(age <= 0.1 + tol, ".05-.1").otherwise("over_.1")


@query("agg_cache_age_bins", SEGMENTS + "SELECT CAST(least(4, floor(((frame - before) / 30.0 + 1e-9) * 10)) AS BIGINT) AS bin, count(*) AS n FROM runs WHERE before IS NOT NULL GROUP BY bin")
def agg_cache_age_bins(t: Tables) -> DataFrame:
    before = F.last(F.when(F.col("detected"), F.col("frame")), ignorenulls=True).over(per_scene().rowsBetween(Window.unboundedPreceding, -1))
    aged = t.frames.select(((F.col("frame") - before) / 30.0).alias("age")).filter("age IS NOT NULL")
    return aged.groupBy(F.least(F.lit(4), F.floor((F.col("age") + 1e-9) * 10)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("jn_measurement_asof", SEGMENTS + "SELECT video, frame, CASE WHEN detected THEN frame ELSE before END AS measured FROM runs")
def jn_measurement_asof(t: Tables) -> DataFrame:
    last = F.last(F.when(F.col("detected"), F.col("frame")), ignorenulls=True).over(per_scene())
    return t.frames.select("video", "frame", last.alias("measured"))
