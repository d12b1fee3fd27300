"""Decisions that depend on the decisions before them: folds over frames in order, a scene or a video at a time."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import q6
from ..plans.catalog import DETECTIONS, FRAMES, Tables, query

FOLDED = FRAMES.replace("WITH ", "WITH RECURSIVE ", 1) + ", fm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video, scene ORDER BY frame) AS k FROM frames)\n"


def fold(df: DataFrame, keys: list[str], order: list[str], out: str, start: Callable[[], object], step: Callable[[object, dict], tuple[object, tuple]]) -> DataFrame:
    """keys, order and what `step` makes of each row, in order within its keys: step(state, row) -> (state, values of `out`).

    Rows stream through in order; a task holds one state, however long a group is.  Their place within the group, a window, is what
    deals and sorts them: rows that already lie together by some of the keys are not shuffled again.
    """
    dealt = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    own = [*keys, *order]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own) + ", " + out
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            names, made = batch.schema.names, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = dict(zip(names, row, strict=True))
                if values["_place"] == 1:
                    state = start()
                state, found = step(state, values)
                made.append((*(values[c] for c in own), *found))
            columns = zip(*made, strict=True) if made else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def ema(frames: DataFrame, share: float = 0.65) -> DataFrame:
    """Exponential mean of `value` within the scene: share of the fresh value and the rest of the mean before."""

    def step(before: float | None, row: dict) -> tuple[float, tuple]:
        now = row["value"] if before is None else share * row["value"] + (1 - share) * before
        return now, (now,)

    return fold(frames.select("video", "scene", "frame", "value"), ["video", "scene"], ["frame"], "ema double", lambda: None, step)


@query("win_ema", FOLDED + ", r AS (SELECT video, scene, k, frame, value AS e FROM fm WHERE k = 1 UNION ALL SELECT f.video, f.scene, f.k, f.frame, 0.65::DOUBLE * f.value + 0.35::DOUBLE * r.e FROM r JOIN fm f ON f.video = r.video AND f.scene = r.scene AND f.k = r.k + 1) SELECT video, frame, CAST(floor(e * 1e6 + 0.5) AS BIGINT) AS ema_q FROM r")
def win_ema(t: Tables) -> DataFrame:
    return ema(t.frames).select("video", "frame", q6(F.col("ema")).alias("ema_q"))


def cooled(frames: DataFrame, interval: int) -> DataFrame:
    """Frames that ask (`detected`) and are answered: none within `interval` frames of the last that was."""

    def step(last: int | None, row: dict) -> tuple[int | None, tuple]:
        granted = row["detected"] and (last is None or row["frame"] - last >= interval)
        return (row["frame"] if granted else last), (granted,)

    return fold(frames.select("video", "scene", "frame", "detected"), ["video", "scene"], ["frame"], "granted boolean", lambda: None, step)


@query("win_cooldown", FOLDED + ", r AS (SELECT video, scene, k, frame, detected AS granted, CASE WHEN detected THEN frame END AS last FROM fm WHERE k = 1 UNION ALL SELECT f.video, f.scene, f.k, f.frame, f.detected AND (r.last IS NULL OR f.frame - r.last >= 5), CASE WHEN f.detected AND (r.last IS NULL OR f.frame - r.last >= 5) THEN f.frame ELSE r.last END FROM r JOIN fm f ON f.video = r.video AND f.scene = r.scene AND f.k = r.k + 1) SELECT video, frame, granted FROM r")
def win_cooldown(t: Tables) -> DataFrame:
    return cooled(t.frames, 5).select("video", "frame", "granted")


def holds(frames: DataFrame) -> DataFrame:
    """Frames missed in a row, and frames seen since the subject (`event_type` of detected frames) last changed; kept over misses."""

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        key, missed, since = state
        if not row["detected"]:
            state = (key, missed + 1, since)
        else:
            state = (row["event_type"], 0, since + 1 if row["event_type"] == key else 0)
        return state, state[1:]

    return fold(frames.select("video", "scene", "frame", "detected", "event_type"), ["video", "scene"], ["frame"], "missed long, since long", lambda: (None, 0, 0), step)


@query("win_hold_counters", FOLDED + ", r AS (SELECT video, scene, k, frame, CASE WHEN detected THEN event_type END AS key, CASE WHEN detected THEN 0 ELSE 1 END AS missed, 0 AS since FROM fm WHERE k = 1 UNION ALL SELECT f.video, f.scene, f.k, f.frame, CASE WHEN f.detected THEN f.event_type ELSE r.key END, CASE WHEN f.detected THEN 0 ELSE r.missed + 1 END, CASE WHEN NOT f.detected THEN r.since WHEN f.event_type = r.key THEN r.since + 1 ELSE 0 END FROM r JOIN fm f ON f.video = r.video AND f.scene = r.scene AND f.k = r.k + 1) SELECT video, frame, CAST(missed AS BIGINT) AS missed, CAST(since AS BIGINT) AS since FROM r")
def win_hold_counters(t: Tables) -> DataFrame:
    return holds(t.frames).select("video", "frame", "missed", "since")


def adaptive_cuts(frames: DataFrame, least_frames: int = 5, factor: float = 3.0, floor: float = 0.10) -> DataFrame:
    """Cuts by the change of `value` against the median of up to 30 changes since the last cut; the first frame is one."""

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        before, last, history = state
        cut = before is None
        if not cut:
            delta = abs(row["value"] - before)
            cut = row["frame"] - last >= least_frames and delta > max(floor, (median(history) if history else 0.0) * factor)
            history.append(delta)
        if cut:
            history.clear()
            last = row["frame"]
        return (row["value"], last, history), (cut,)

    return fold(frames.select("video", "frame", "value"), ["video"], ["frame"], "cut boolean", lambda: (None, 0, deque(maxlen=30)), step)


@query(
    "win_median30",
    FOLDED
    + """, r AS (SELECT video, frame, value, true AS cut, frame AS last, CAST([] AS DOUBLE[]) AS h FROM fm WHERE frame = 1
UNION ALL SELECT video, frame, value, cut, CASE WHEN cut THEN frame ELSE last END, CASE WHEN cut THEN CAST([] AS DOUBLE[]) ELSE list_append(h, delta)[-30:] END FROM (SELECT f.video, f.frame, f.value, abs(f.value - r.value) AS delta, r.last, r.h, f.frame - r.last >= 5 AND abs(f.value - r.value) > greatest(0.1::DOUBLE, coalesce(list_aggregate(r.h, 'median'), 0) * 3) AS cut FROM r JOIN fm f ON f.video = r.video AND f.frame = r.frame + 1))
SELECT video, frame, cut FROM r""",
)
def win_median30(t: Tables) -> DataFrame:
    return adaptive_cuts(t.frames).select("video", "frame", "cut")


def sources(frames: DataFrame) -> DataFrame:
    """Detect or predict: detected where nothing is measured in the scene yet or the interval (`itv`) has passed, else predicted from the measured frame."""

    def step(measured: int | None, row: dict) -> tuple[int, tuple]:
        detect = measured is None or row["frame"] - measured >= row["itv"]
        measured = row["frame"] if detect else measured
        return measured, ("detected" if detect else "predicted", measured)

    return fold(frames.select("video", "scene", "frame", "itv"), ["video", "scene"], ["frame"], "source string, measured long", lambda: None, step)


@query("trk_step", FOLDED + ", r AS (SELECT video, scene, k, frame, frame AS measured FROM fm WHERE k = 1 UNION ALL SELECT f.video, f.scene, f.k, f.frame, CASE WHEN f.frame - r.measured >= f.itv THEN f.frame ELSE r.measured END FROM r JOIN fm f ON f.video = r.video AND f.scene = r.scene AND f.k = r.k + 1) SELECT video, frame, CASE WHEN frame = measured THEN 'detected' ELSE 'predicted' END AS source, measured FROM r")
def trk_step(t: Tables) -> DataFrame:
    return sources(t.frames).select("video", "frame", "source", "measured")


SEEN = DETECTIONS.replace("WITH ", "WITH RECURSIVE ", 1) + """, spots AS (SELECT video, frame, min(o_orderdate) AS day FROM det GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY day, frame) AS no FROM spots),
ranked AS MATERIALIZED (SELECT video, no, list({'track': track % 5, 'cls': cls, 'score': conf} ORDER BY conf DESC, idx) AS c FROM det JOIN placed USING (video, frame) GROUP BY ALL)
"""


def ranked_lists(t: Tables) -> DataFrame:
    """Frames of a video in order with their candidates, best first."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("o"), "idx", (F.col("track") % 5).alias("track"), "cls", F.col("conf").alias("score"))))
    g = t.detections.groupBy("video", "frame", "o_orderdate").agg(best.alias("c"))
    no = F.row_number().over(Window.partitionBy("video").orderBy("o_orderdate", "frame")).cast("long")
    return g.select("video", no.alias("no"), F.transform("c", lambda x: F.struct(x["track"].alias("track"), x["cls"].alias("cls"), x["score"].alias("score"))).alias("c"))


def subjects(frames: DataFrame, hold: int = 3, switch: float = 1.15, patience: int = 2, keep: float = 0.92) -> DataFrame:
    """Which candidate (of the list c, best first) each frame follows: the one before while it holds, else the best; none while one is missed for a few frames."""

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        tracked, missed, since = state
        best = row["c"][0] if row["c"] else None
        own = next((c for c in row["c"] if (c["track"], c["cls"]) == tracked), None)
        if best is None or (own is None and tracked is not None and missed < patience):
            return (tracked, missed + 1, since), (None, missed + 1)
        stays = own is not None and (own is best or (since < hold and own["score"] * switch >= best["score"]) or own["score"] >= best["score"] * keep)
        chosen = own if stays else best
        key = (chosen["track"], chosen["cls"])
        return (key, 0, since + 1 if key == tracked else 0), (chosen["track"], 0)

    return fold(frames, ["video"], ["no"], "subject long, missed long", lambda: (None, 0, 0), step)


@query(
    "dec_subject",
    SEEN
    + """, r AS (SELECT video, no, c[1].track AS track, c[1].cls AS cls, 0 AS missed, 0 AS since, c[1].track AS subject FROM ranked WHERE no = 1
UNION ALL SELECT video, no, CASE WHEN gone THEN track ELSE pick.track END, CASE WHEN gone THEN cls ELSE pick.cls END, CASE WHEN gone THEN missed + 1 ELSE 0 END, CASE WHEN gone THEN since WHEN pick.track = track AND pick.cls = cls THEN since + 1 ELSE 0 END, CASE WHEN NOT gone THEN pick.track END
FROM (SELECT *, own IS NULL AND missed < 2 AS gone, CASE WHEN own IS NOT NULL AND ((own.track = best.track AND own.cls = best.cls) OR (since < 3 AND own.score * 1.15::DOUBLE >= best.score) OR own.score >= best.score * 0.92::DOUBLE) THEN own ELSE best END AS pick FROM (SELECT f.video, f.no, r.track, r.cls, r.missed, r.since, f.c[1] AS best, list_filter(f.c, lambda x: x.track = r.track AND x.cls = r.cls)[1] AS own FROM r JOIN ranked f ON f.video = r.video AND f.no = r.no + 1)))
SELECT video, no, subject, CAST(missed AS BIGINT) AS missed FROM r""",
)
def dec_subject(t: Tables) -> DataFrame:
    return subjects(ranked_lists(t))


def pairs_active(frames: DataFrame, threshold: float = 0.8, ease: float = 0.12) -> DataFrame:
    """Whether the two best persons (class 0) are shown together; easier while they are."""

    def step(active: bool, row: dict) -> tuple[bool, tuple]:
        score = [c["score"] for c in row["c"] if c["cls"] == 0][:2]
        active = len(score) == 2 and not score[1] < score[0] * (threshold - ease if active else threshold)
        return active, (active,)

    return fold(frames, ["video"], ["no"], "pair boolean", lambda: False, step)


@query("dec_pair", SEEN + ", p AS MATERIALIZED (SELECT video, no, list_filter(c, lambda x: x.cls = 0) AS c FROM ranked), r AS (SELECT video, no, coalesce(c[2].score >= c[1].score * 0.8::DOUBLE, false) AS pair FROM p WHERE no = 1 UNION ALL SELECT f.video, f.no, coalesce(f.c[2].score >= f.c[1].score * (CASE WHEN r.pair THEN 0.8::DOUBLE - 0.12::DOUBLE ELSE 0.8::DOUBLE END), false) FROM r JOIN p f ON f.video = r.video AND f.no = r.no + 1) SELECT video, no, pair FROM r")
def dec_pair(t: Tables) -> DataFrame:
    return pairs_active(ranked_lists(t))


def spring_step(at: float, goal: float, speed: float, dt: float, tau: float, top: float) -> tuple[float, float]:
    """geometry.spring for one value."""
    omega, off = 2 / max(tau, 1e-4), at - goal
    k, decay = speed + omega * off, math.exp(-2 / max(tau, 1e-4) * dt)
    value = at + max(-top * dt, min(top * dt, goal + (off + k * dt) * decay - at))
    if (goal - at) * (goal - value) <= 0:
        return goal, 0.0
    return value, max(-top, min(top, (speed - omega * k * dt) * decay))


def camera_paths(frames: DataFrame, width: int = 1920, crop: int = 608, fps: int = 30, tau: float = 0.35, target: float = 0.2, dead: float = 0.05, speed: float = 0.6) -> DataFrame:
    """Where the crop's middle stands (x): on the target at a scene's first frame, then behind it by a spring with a dead zone.

    frames: video, scene, frame, x (null where nothing is seen: it stays), confidence.
    """

    def step(state: tuple | None, row: dict) -> tuple[tuple | None, tuple]:
        half = crop / 2
        inside = lambda v: max(half, min(width - half, v))
        if row["x"] is None:
            at = state[0] if state else width / 2
            return state, (at, 0.0)
        if state is None:
            at = inside(row["x"])
            return (at, at, 0.0), (at, 0.0)
        at, goal, v = state
        sure = max(0.15, min(1.0, row["confidence"]))
        share, x = 1 - math.exp(-1 / fps / (target / (0.55 + 0.65 * sure))), row["x"]
        if abs(x - at) <= crop * dead:
            x, goal, v = at, at, 0.0
        goal = inside(goal + (x - goal) * share)
        moved, v = spring_step(at, goal, v, 1 / fps, tau, width * speed * (0.35 + 0.65 * sure))
        now = inside(moved)
        return (now, goal, v if now == moved else 0.0), (now, v if now == moved else 0.0)

    return fold(frames.select("video", "scene", "frame", "x", "confidence"), ["video", "scene"], ["frame"], "center double, speed double", lambda: None, step)


CAMERA = FOLDED + """, seen AS MATERIALIZED (SELECT video, scene, k, frame, value * 15 AS x, greatest(0.15::DOUBLE, least(1.0::DOUBLE, itv / 3.0::DOUBLE)) AS sure FROM fm), r AS (SELECT video, scene, k, frame, greatest(304.0::DOUBLE, least(1616.0::DOUBLE, x)) AS pos, greatest(304.0::DOUBLE, least(1616.0::DOUBLE, x)) AS goal, 0.0::DOUBLE AS v FROM seen WHERE k = 1
UNION ALL SELECT video, scene, k, frame, greatest(304.0::DOUBLE, least(1616.0::DOUBLE, moved)), goal, CASE WHEN moved BETWEEN 304 AND 1616 THEN nv ELSE 0.0::DOUBLE END FROM (SELECT *, CASE WHEN (goal - pos) * (goal - val) <= 0 THEN goal ELSE val END AS moved, CASE WHEN (goal - pos) * (goal - val) <= 0 THEN 0.0::DOUBLE ELSE greatest(-top, least(top, (v - w * kk / 30) * dec)) END AS nv
FROM (SELECT *, pos + greatest(-top / 30, least(top / 30, goal + (pos - goal + kk / 30) * dec - pos)) AS val FROM (SELECT *, v + w * (pos - goal) AS kk, exp(-w / 30) AS dec, 1920 * 0.6::DOUBLE * (0.35::DOUBLE + 0.65::DOUBLE * sure) AS top
FROM (SELECT video, scene, k, frame, sure, pos, 2 / 0.35::DOUBLE AS w, CASE WHEN still THEN 0.0::DOUBLE ELSE v END AS v, greatest(304.0::DOUBLE, least(1616.0::DOUBLE, CASE WHEN still THEN pos ELSE goal + (x - goal) * (1 - exp(-1 / 30.0::DOUBLE / (0.2::DOUBLE / (0.55::DOUBLE + 0.65::DOUBLE * sure)))) END)) AS goal
FROM (SELECT f.video, f.scene, f.k, f.frame, f.x, f.sure, r.pos, r.goal, r.v, abs(f.x - r.pos) <= 608 * 0.05::DOUBLE AS still FROM r JOIN seen f ON f.video = r.video AND f.scene = r.scene AND f.k = r.k + 1))))))
"""


@query("dec_camera", CAMERA + "SELECT video, frame, CAST(floor(pos * 1e3 + 0.5) AS BIGINT) AS center FROM r")
def dec_camera(t: Tables) -> DataFrame:
    seen = t.frames.select("video", "scene", "frame", (F.col("value") * 15).alias("x"), (F.col("itv") / 3.0).alias("confidence"))
    return camera_paths(seen).select("video", "frame", F.floor(F.col("center") * 1e3 + 0.5).cast("long").alias("center"))


def losses(frames: DataFrame, patience: int = 2, fps: int = 30, width: int = 1920) -> DataFrame:
    """What a crop does where its subject is missing: it holds for `patience` frames, then eases to the middle; x where it is seen."""
    ease = 1 - 0.97 ** (30 / fps)

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        at, missed = state
        if row["x"] is not None:
            at, missed, kind = row["x"], 0, "seen"
        else:
            missed += 1
            kind = "held" if missed <= patience else "eased"
            at += (width / 2 - at) * ease if kind == "eased" else 0.0
        return (at, missed), (kind, at)

    return fold(frames.select("video", "scene", "frame", "x"), ["video", "scene"], ["frame"], "kind string, center double", lambda: (width / 2, 0), step)


@query("dec_lost", FOLDED + ", r AS (SELECT video, scene, k, frame, CASE WHEN detected THEN 0 ELSE 1 END AS missed, CASE WHEN detected THEN value * 15 ELSE 960.0::DOUBLE END AS pos FROM fm WHERE k = 1 UNION ALL SELECT f.video, f.scene, f.k, f.frame, CASE WHEN f.detected THEN 0 ELSE r.missed + 1 END, CASE WHEN f.detected THEN f.value * 15 WHEN r.missed < 2 THEN r.pos ELSE r.pos + (960 - r.pos) * (1 - pow(0.97::DOUBLE, 1)) END FROM r JOIN fm f ON f.video = r.video AND f.scene = r.scene AND f.k = r.k + 1) SELECT video, frame, CASE WHEN missed = 0 THEN 'seen' WHEN missed <= 2 THEN 'held' ELSE 'eased' END AS kind, CAST(floor(pos * 1e3 + 0.5) AS BIGINT) AS center FROM r")
def dec_lost(t: Tables) -> DataFrame:
    seen = t.frames.select("video", "scene", "frame", F.when(F.col("detected"), F.col("value") * 15).alias("x"))
    return losses(seen).select("video", "frame", "kind", F.floor(F.col("center") * 1e3 + 0.5).cast("long").alias("center"))


@query("dec_scene_reset", FRAMES + "SELECT video, scene, min(frame) AS frame, 960.0::DOUBLE AS center_x, 540.0::DOUBLE AS center_y, 1.0::DOUBLE AS zoom FROM frames GROUP BY video, scene")
def dec_scene_reset(t: Tables) -> DataFrame:
    """The state that each scene starts from: the frame's middle and the least zoom; all else is forgotten, as folds go by scene."""
    g = t.frames.groupBy("video", "scene").agg(F.min("frame").alias("frame"))
    return g.select("*", F.lit(960.0).alias("center_x"), F.lit(540.0).alias("center_y"), F.lit(1.0).alias("zoom"))


@query("trk_stability", FRAMES + ", isl AS (SELECT *, sum(CASE WHEN detected THEN 0 ELSE 1 END) OVER (PARTITION BY video, scene ORDER BY frame) AS island FROM frames) SELECT video, frame, CASE WHEN NOT detected THEN 1 WHEN ts_s - since >= 0.25 THEN 3 WHEN ts_s - since >= 0.1 - 1e-9 THEN 2 ELSE 1 END AS interval_frames FROM (SELECT *, min(CASE WHEN detected THEN ts_s END) OVER (PARTITION BY video, scene, island) AS since FROM isl)")
def trk_stability(t: Tables) -> DataFrame:
    """How many frames until the next detection, by how long all has been stable (here: detected)."""
    island = F.sum((~F.col("detected")).cast("long")).over(Window.partitionBy("video", "scene").orderBy("frame"))
    s = t.frames.withColumn("island", island).withColumn("since", F.min(F.when(F.col("detected"), F.col("ts_s"))).over(Window.partitionBy("video", "scene", "island")))
    held = F.col("ts_s") - F.col("since")
    return s.select("video", "frame", F.when(~F.col("detected"), 1).when(held >= 0.25, 3).when(held >= 0.1 - 1e-9, 2).otherwise(1).alias("interval_frames"))
