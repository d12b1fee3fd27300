"""Audits of segment rows (what they return are violations), the lines that carry such rows, and statistics of runs and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import q6
from ..plans.catalog import FPS, FRAMES, GRIDS, SEGMENTS, WINDOW_FRAMES, Tables, query

#: Segment rows as told by a run, some of them wrong, so that audits have something to find.
TOLD = SEGMENTS + """, told AS (SELECT video, segment, scene + CASE WHEN (video + segment) % 61 = 0 THEN 2 ELSE 0 END AS scene, win, frame_start + CASE WHEN (video + segment) % 53 = 0 THEN 1 ELSE 0 END AS frame_start, frame_end, n_frames, n_detected + CASE WHEN (video + segment) % 59 = 0 THEN 1 ELSE 0 END AS n_detected, n_predicted FROM segments)
"""
ROW = ["video", "segment", "scene", "win", "frame_start", "frame_end", "n_frames", "n_detected", "n_predicted"]
ROW_SCHEMA = ", ".join(f"{c} long" for c in ROW)


def _wrong(every: int, by: int) -> Column:
    return F.when((F.col("video") + F.col("segment")) % every == 0, by).otherwise(0)


def told(t: Tables) -> DataFrame:
    s = t.segments
    return s.withColumns({"scene": F.col("scene") + _wrong(61, 2), "frame_start": F.col("frame_start") + _wrong(53, 1), "n_detected": F.col("n_detected") + _wrong(59, 1)}).select(*[F.col(c).cast("long") for c in ROW])


def _by_segment() -> Window:
    return Window.partitionBy("video").orderBy("segment")


@query("aud_seg_contiguity", TOLD + "SELECT video, segment FROM (SELECT *, lag(frame_end) OVER w AS prior, row_number() OVER w AS position FROM told WINDOW w AS (PARTITION BY video ORDER BY segment)) WHERE segment <> position OR frame_start <> coalesce(prior, 0) + 1 OR frame_end - frame_start + 1 <> n_frames")
def aud_seg_contiguity(t: Tables) -> DataFrame:
    w = _by_segment()
    s = told(t).withColumns({"prior": F.coalesce(F.lag("frame_end").over(w), F.lit(0)), "position": F.row_number().over(w)})
    return s.filter("segment <> position OR frame_start <> prior + 1 OR frame_end - frame_start + 1 <> n_frames").select("video", "segment")


@query("aud_seg_partition", TOLD + "SELECT video, segment, n_frames, n_detected + n_predicted AS accounted FROM told WHERE n_frames <> n_detected + n_predicted")
def aud_seg_partition(t: Tables) -> DataFrame:
    return told(t).filter("n_frames <> n_detected + n_predicted").select("video", "segment", "n_frames", (F.col("n_detected") + F.col("n_predicted")).alias("accounted"))


@query("aud_seg_scene", TOLD + "SELECT video, segment, scene FROM (SELECT *, lag(scene) OVER (PARTITION BY video ORDER BY segment) AS prior FROM told) WHERE scene NOT IN (coalesce(prior, 0), coalesce(prior, 0) + 1)")
def aud_seg_scene(t: Tables) -> DataFrame:
    s = told(t).withColumn("prior", F.coalesce(F.lag("scene").over(_by_segment()), F.lit(0)))
    return s.filter("scene <> prior AND scene <> prior + 1").select("video", "segment", "scene")


@query("aud_seg_time", TOLD + "SELECT video, segment FROM (SELECT *, (frame_start - 1) / 30.0 AS s, frame_end / 30.0 AS e, lag(frame_end / 30.0) OVER (PARTITION BY video ORDER BY segment) AS prior FROM told) WHERE abs(s - coalesce(prior, 0)) > 1e-6 OR e <= s OR abs(e - s - n_frames / 30.0) > 1e-6")
def aud_seg_time(t: Tables) -> DataFrame:
    s = told(t).withColumns({"s": (F.col("frame_start") - 1) / FPS, "e": F.col("frame_end") / FPS})
    s = s.withColumn("prior", F.coalesce(F.lag("e").over(_by_segment()), F.lit(0.0)))
    return s.filter((F.abs(F.col("s") - F.col("prior")) > 1e-6) | (F.col("e") <= F.col("s")) | (F.abs(F.col("e") - F.col("s") - F.col("n_frames") / FPS) > 1e-6)).select("video", "segment")


@query("aud_seg_hist", TOLD + ", planned AS (SELECT video, scene, win, CAST(sum(n) AS BIGINT) AS planned FROM (SELECT video, scene, win, itv, count(*) AS n FROM frames WHERE itv > 1 OR event_id % 89 <> 0 GROUP BY ALL) GROUP BY ALL) SELECT segment, s.video, n_frames, coalesce(planned, 0) AS planned FROM segments s LEFT JOIN planned p ON s.video = p.video AND s.scene = p.scene AND s.win = p.win WHERE n_frames <> coalesce(planned, 0)")
def aud_seg_hist(t: Tables) -> DataFrame:
    key = ["video", "scene", "win"]
    scheduled = t.frames.filter("itv > 1 OR event_id % 89 <> 0").groupBy(*key, "itv").agg(F.count("*").alias("n"))
    s = t.segments.join(scheduled.groupBy(*key).agg(F.sum("n").alias("planned")), key, "left").withColumn("planned", F.coalesce("planned", F.lit(0)))
    return s.filter("n_frames <> planned").select("video", "segment", "n_frames", "planned")


@query("aud_seg_gaps", TOLD + ", g AS (SELECT video, CAST(sum(CASE WHEN detected AND before IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS gaps, count(DISTINCT CASE WHEN detected THEN scene END) AS scenes FROM runs GROUP BY video), c AS (SELECT video, CAST(sum(n_detected) AS BIGINT) AS calls FROM told GROUP BY video) SELECT video, gaps, calls, scenes FROM g JOIN c USING (video) WHERE gaps <> calls - scenes")
def aud_seg_gaps(t: Tables) -> DataFrame:
    # Per scene first: detections of a scene but its first each end a gap.
    scenes = t.frames.filter("detected").groupBy("video", "scene").agg((F.count("*") - 1).alias("gaps"))
    g = t.frames.select("video").distinct().join(scenes, "video", "left").groupBy("video").agg(F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"), F.count("scene").alias("scenes"))
    calls = told(t).groupBy("video").agg(F.sum("n_detected").alias("calls"))
    return g.join(calls, "video").filter("gaps <> calls - scenes").select("video", "gaps", "calls", "scenes")


@query("aud_seg_conserve", TOLD + ", whole AS (SELECT video, count(*) AS n_frames, CAST(sum(CASE WHEN detected THEN 1 ELSE 0 END) AS BIGINT) AS n_detected FROM frames GROUP BY video), parts AS (SELECT video, CAST(sum(n_frames) AS BIGINT) AS f, CAST(sum(n_detected) AS BIGINT) AS d FROM told GROUP BY video), both_ AS (SELECT video, 'n_frames' AS key, f AS told, n_frames AS whole FROM parts JOIN whole USING (video) UNION ALL SELECT video, 'n_detected', d, n_detected FROM parts JOIN whole USING (video)) SELECT * FROM both_ WHERE told <> whole")
def aud_seg_conserve(t: Tables) -> DataFrame:
    keys = ["n_frames", "n_detected"]
    whole = t.frames.groupBy("video").agg(F.count("*").alias("n_frames"), F.count_if("detected").alias("n_detected")).unpivot("video", keys, "key", "whole")
    parts = told(t).groupBy("video").agg(*[F.sum(k).alias(k) for k in keys]).unpivot("video", keys, "key", "told")
    return parts.join(whole, ["video", "key"]).filter("told <> whole")


@query("aud_segment_input", FRAMES + "SELECT video, frame FROM (SELECT video, frame, lag(frame) OVER (PARTITION BY video ORDER BY frame) AS prior FROM frames WHERE event_id % 97 <> 0) WHERE frame <> coalesce(prior, 0) + 1")
def aud_segment_input(t: Tables) -> DataFrame:
    kept = t.frames.filter("event_id % 97 <> 0").select("video", "frame")
    prior = F.coalesce(F.lag("frame").over(Window.partitionBy("video").orderBy("frame")), F.lit(0))
    return kept.withColumn("prior", prior).filter("frame <> prior + 1").select("video", "frame")


@query("aud_map_valid", "SELECT vec_id, CAST(len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v) OR v < -0.000001 OR v > 1.000001)) AS BIGINT) AS n_bad FROM embeddings WHERE n_bad > 0")
def aud_map_valid(t: Tables) -> DataFrame:
    bad = F.filter("embedding", lambda v: v.isNull() | F.isnan(v) | (v < -0.000001) | (v > 1.000001))
    return t.read("embeddings").select("vec_id", F.size(bad).cast("long").alias("n_bad")).filter("n_bad > 0")


LINE = "concat('Segment: ', to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in ROW) + ")))"


def lines(rows: DataFrame) -> DataFrame:
    return rows.select("video", "segment", F.concat(F.lit("Segment: "), F.to_json(F.struct(*ROW))).alias("line"))


@query("snk_segment_line", TOLD + f"SELECT video, segment, {LINE} AS line FROM told")
def snk_segment_line(t: Tables) -> DataFrame:
    return lines(told(t))


@query("src_log_segments", TOLD + f"SELECT {', '.join(ROW)} FROM told WHERE (video + segment) % 11 <> 0")
def src_log_segments(t: Tables) -> DataFrame:
    """Lenient reading: lines cut short, and lines without the marker, give no row."""
    cut = F.when((F.col("video") + F.col("segment")) % 11 == 0, F.substring("line", 1, 30)).otherwise(F.col("line"))
    log = lines(told(t)).select(cut.alias("line")).filter(F.col("line").startswith("Segment: "))
    parsed = log.select(F.from_json(F.regexp_replace("line", "^Segment: ", ""), ROW_SCHEMA).alias("s"))
    return parsed.select("s.*").filter("n_predicted IS NOT NULL")


@query("src_log_summary", TOLD + "SELECT video, CAST(sum(n_frames) AS BIGINT) AS n_frames, count(*) AS n_segments FROM told GROUP BY video HAVING video % 13 <> 0")
def src_log_summary(t: Tables) -> DataFrame:
    """Logs that hold one summary; those with two are refused."""
    total = told(t).groupBy("video").agg(F.sum("n_frames").alias("n_frames"), F.count("*").alias("n_segments"))
    log = total.select("video", F.concat(F.lit("Summary: "), F.to_json(F.struct("n_frames", "n_segments"))).alias("line"))
    log = log.unionAll(log.filter("video % 13 = 0"))
    one = log.groupBy("video").agg(F.count("*").alias("n"), F.min("line").alias("line")).filter("n = 1")
    return one.select("video", F.from_json(F.regexp_replace("line", "^Summary: ", ""), "n_frames long, n_segments long").alias("s")).select("video", "s.*")


@query("snk_encoder_pick", "SELECT r_name AS device, coalesce(min_by(n_name, n_nationkey) FILTER (n_nationkey % 3 = 0), 'libx264') AS encoder FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def snk_encoder_pick(t: Tables) -> DataFrame:
    """First of the candidates in order that passed its probe; libx264 where none did."""
    passed = t.read("nation").filter("n_nationkey % 3 = 0").groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("found"))
    return t.read("region").join(passed, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("device"), F.coalesce("found", F.lit("libx264")).alias("encoder"))


@query("jn_event_windows", TOLD + ", asked AS (SELECT video, frame, (frame - 1) / 30.0 AS s, (frame + 29) / 30.0 AS e FROM frames WHERE event_type = 'purchase') SELECT a.video, a.frame, g.segment FROM asked a JOIN segments g ON a.video = g.video AND (g.frame_start - 1) / 30.0 < a.e AND g.frame_end / 30.0 > a.s")
def jn_event_windows(t: Tables) -> DataFrame:
    """Segments that overlap [start, end); a segment lies within one tumbling window, and a second within two, which are joined by."""
    windows = F.array_distinct(F.array(*[F.floor((F.col("frame") + k) / WINDOW_FRAMES).cast("long") for k in (-1, FPS - 2)]))
    asked = t.frames.filter("event_type = 'purchase'").select("video", "frame", F.explode(windows).alias("win"))
    g = t.segments.select("video", "win", "segment", "frame_start", "frame_end")
    return asked.join(g, ["video", "win"]).filter(f"frame_start - 1 < frame + {FPS - 1} AND frame_end > frame - 1").select("video", "frame", "segment")


@query("agg_workload", FRAMES + "SELECT CAST(sum(least(n, 60)) AS BIGINT) AS scheduled, count(*) AS runs FROM (SELECT video, count(*) AS n FROM frames GROUP BY video)")
def agg_workload(t: Tables) -> DataFrame:
    return t.frames.groupBy("video").agg(F.count("*").alias("n")).agg(F.sum(F.least("n", F.lit(60))).alias("scheduled"), F.count("*").alias("runs"))


@query("agg_median_runs", "SELECT event_type, CAST(floor(median(value) * 1e6 + 0.5) AS BIGINT) AS median_value, count(*) AS runs FROM events WHERE user_id % 7 <> 0 GROUP BY event_type HAVING count(*) = count(CASE WHEN isfinite(value) THEN 1 END)")
def agg_median_runs(t: Tables) -> DataFrame:
    """Median of runs that are no warm-up; kept where all values are finite."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    g = t.read("events").filter("user_id % 7 <> 0").groupBy("event_type").agg(F.median("value").alias("m"), F.count("*").alias("runs"), F.count_if(bad).alias("bad"))
    return g.filter("bad = 0").select("event_type", q6(F.col("m")).alias("median_value"), "runs")


@query("agg_change", GRIDS + ", pairs AS (SELECT a.vec_id, (a.r // 2) * 4 + a.c // 2 AS tile, abs(a.v - b.v) AS d FROM cells a JOIN cells b ON a.vec_id = b.vec_id + 1 AND a.i = b.i), tiles AS (SELECT vec_id, tile, avg(d) AS m FROM pairs GROUP BY ALL) SELECT vec_id, CAST(floor(avg(m) * 1e6 + 0.5) AS BIGINT) AS mean_change, CAST(floor(max(m) * 1e6 + 0.5) AS BIGINT) AS tile_change FROM tiles GROUP BY vec_id")
def agg_change(t: Tables) -> DataFrame:
    """Mean absolute difference from the grid before, of all cells and of the 4 x 4 tile that differs most (tiles are of one size)."""
    now = t.cells.select("vec_id", "i", "r", "c", "v")
    before = t.cells.select((F.col("vec_id") + 1).alias("vec_id"), "i", F.col("v").alias("old"))
    tile = F.floor(F.col("r") / 2) * 4 + F.floor(F.col("c") / 2)
    tiles = now.join(before, ["vec_id", "i"]).groupBy("vec_id", tile.alias("tile")).agg(F.avg(F.abs(F.col("v") - F.col("old"))).alias("m"))
    return tiles.groupBy("vec_id").agg(q6(F.avg("m")).alias("mean_change"), q6(F.max("m")).alias("tile_change"))


@query("agg_theil_sen", FRAMES + "SELECT video, frame, CASE WHEN n < 3 THEN 0 ELSE slope END AS slope FROM (SELECT b.video, b.frame, (SELECT count(*) FROM frames f WHERE f.video = b.video AND f.scene = b.scene AND f.frame BETWEEN b.frame - 7 AND b.frame) AS n, coalesce((SELECT CAST(floor(median((j.value - i.value) / (j.ts_s - i.ts_s)) * 1e6 + 0.5) AS BIGINT) FROM frames i JOIN frames j ON i.video = j.video AND i.scene = j.scene AND i.frame < j.frame WHERE i.video = b.video AND i.scene = b.scene AND i.frame BETWEEN b.frame - 7 AND b.frame AND j.frame BETWEEN b.frame - 7 AND b.frame), 0) AS slope FROM frames b)")
def agg_theil_sen(t: Tables) -> DataFrame:
    """Median of the slopes between any two of the last 8 samples of a scene; 0 for fewer than three."""
    near = Window.partitionBy("video", "scene").orderBy("frame").rowsBetween(-7, 0)
    s = t.frames.select("video", "frame", F.collect_list(F.struct("ts_s", "value")).over(near).alias("s"))
    slopes = F.expr("sort_array(flatten(transform(s, (b, j) -> transform(filter(slice(s, 1, j), a -> b.ts_s - a.ts_s > 1e-6), a -> (b.value - a.value) / (b.ts_s - a.ts_s)))))")
    n = F.size("l")
    middle = (F.element_at("l", F.floor((n + 1) / 2).cast("int")) + F.element_at("l", (F.floor(n / 2) + 1).cast("int"))) / 2
    return s.withColumn("l", slopes).select("video", "frame", F.when((F.size("s") < 3) | (n == 0), F.lit(0).cast("long")).otherwise(q6(middle)).alias("slope"))
