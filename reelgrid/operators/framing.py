"""Where a crop should stand: regions, targets padded and fitted, lookahead, and gates of measured boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp, q6
from ..plans.catalog import DETECTIONS, FPS, FRAMES, GRIDS, Tables, query

WIDTH, HEIGHT = 1920, 1080
#: A 9:16 crop of the full height.
BASE_W, BASE_H = 608, 1080
LEAST_ZOOM, MOST_ZOOM = 1.0, 1.6

Q = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"


@query("prj_region_center", """SELECT mode, w, lft, rgt, CAST(floor((lft + rgt) / 2.0 * 1e6 + 0.5) AS BIGINT) AS center FROM (SELECT mode, w, CASE mode WHEN 'middle' THEN (w - w // 2) // 2 WHEN 'right' THEN w - w // 2 ELSE 0 END AS lft, CASE mode WHEN 'none' THEN w WHEN 'middle' THEN (w - w // 2) // 2 + w // 2 WHEN 'right' THEN w ELSE w // 2 END AS rgt FROM (SELECT DISTINCT CAST(600 + p_size AS BIGINT) AS w FROM part), (VALUES ('none'), ('left'), ('middle'), ('right')) m(mode))""")
def prj_region_center(t: Tables) -> DataFrame:
    """Bounds of the half-width region of each mode, and its middle."""
    w, mode, half = F.col("w"), F.col("mode"), F.floor(F.col("w") / 2)
    left = F.when(mode == "middle", F.floor((w - half) / 2)).when(mode == "right", w - half).otherwise(F.lit(0).cast("long"))
    right = F.when(mode.isin("none", "right"), w).when(mode == "middle", F.floor((w - half) / 2) + half).otherwise(half)
    widths = t.read("part").select((600 + F.col("p_size")).cast("long").alias("w")).distinct()
    r = widths.select("w", F.explode(F.array(*map(F.lit, ("none", "left", "middle", "right")))).alias("mode")).select("mode", "w", left.alias("lft"), right.alias("rgt"))
    return r.withColumn("center", q6((F.col("lft") + F.col("rgt")) / 2.0))


def observation(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """Bounds within the frame, padded and fitted: zoom, and the fit's size before it."""
    left, top = clamp(x1, 0.0, float(WIDTH)), clamp(y1, 0.0, float(HEIGHT))
    right, bottom = F.greatest(clamp(x2, 0.0, float(WIDTH)), left + 1), F.greatest(clamp(y2, 0.0, float(HEIGHT)), top + 1)
    w, h = right - left, bottom - top
    fit_w = F.least(F.lit(float(WIDTH)), w + 2 * F.greatest(w * 0.12, F.lit(16.0)))
    fit_h = F.least(F.lit(float(HEIGHT)), h + 2 * F.greatest(h * 0.16, F.lit(20.0)))
    return {"fit_w": fit_w, "fit_h": fit_h, "zoom": clamp(F.least(BASE_W / fit_w, BASE_H / fit_h), LEAST_ZOOM, MOST_ZOOM), "mid_x": (left + right) / 2, "mid_y": (top + bottom) / 2}


OBSERVED = DETECTIONS + """, fit AS (SELECT *, least(1920.0::DOUBLE, (x2 - x1) + 2 * greatest((x2 - x1) * 0.12::DOUBLE, 16.0::DOUBLE)) AS fit_w, least(1080.0::DOUBLE, (y2 - y1) + 2 * greatest((y2 - y1) * 0.16::DOUBLE, 20.0::DOUBLE)) AS fit_h FROM det), obs AS (SELECT *, greatest(1.0::DOUBLE, least(1.6::DOUBLE, least(608 / fit_w, 1080 / fit_h))) AS zoom FROM fit)
"""


@query("dec_observation", OBSERVED + f"SELECT frame, idx, {Q.format('fit_w')} AS fit_w, {Q.format('fit_h')} AS fit_h, {Q.format('zoom')} AS zoom, {Q.format('greatest(304 / zoom, least(1920 - 304 / zoom, (x1 + x2) / 2))')} AS cx, {Q.format('greatest(540 / zoom, least(1080 - 540 / zoom, (y1 + y2) / 2))')} AS cy FROM obs")
def dec_observation(t: Tables) -> DataFrame:
    """Zoom and middle of the crop for each box, the middle kept so far inside that the crop fits."""
    d = t.detections.select("frame", "idx", "x1", "y1", "x2", "y2")
    o = d.withColumns(observation(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    half_w, half_h = (BASE_W / 2) / F.col("zoom"), (BASE_H / 2) / F.col("zoom")
    cx, cy = F.greatest(half_w, F.least(WIDTH - half_w, F.col("mid_x"))), F.greatest(half_h, F.least(HEIGHT - half_h, F.col("mid_y")))
    return o.select("frame", "idx", q6(F.col("fit_w")).alias("fit_w"), q6(F.col("fit_h")).alias("fit_h"), q6(F.col("zoom")).alias("zoom"), q6(cx).alias("cx"), q6(cy).alias("cy"))


@query("dec_single", DETECTIONS + f"SELECT frame, idx, {Q.format('greatest(0.2::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * conf + 0.2::DOUBLE * (qty / 50) + 0.2::DOUBLE * (cls / 7.0::DOUBLE)))')} AS confidence FROM det")
def dec_single(t: Tables) -> DataFrame:
    """Confidence of a single subject from those of detection, rank (here qty) and saliency (here cls)."""
    blend = 0.6 * F.col("conf") + 0.2 * (F.col("qty") / 50) + 0.2 * (F.col("cls") / 7.0)
    return t.detections.select("frame", "idx", q6(clamp(blend, 0.2, 1.0)).alias("confidence"))


@query("dec_pair_obs", DETECTIONS + f"SELECT frame, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, {Q.format('greatest(0.25::DOUBLE, least(1.0::DOUBLE, (min(conf) + max(conf)) / 2))')} AS confidence FROM det WHERE idx < 2 GROUP BY frame HAVING count(*) = 2")
def dec_pair_obs(t: Tables) -> DataFrame:
    """Union of the boxes of a frame's first two, with their mean confidence."""
    g = t.detections.filter("idx < 2").groupBy("frame").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.min("conf").alias("lo"), F.max("conf").alias("hi"), F.count("*").alias("n"))
    return g.filter("n = 2").select("frame", "x1", "y1", "x2", "y2", q6(clamp((F.col("lo") + F.col("hi")) / 2, 0.25, 1.0)).alias("confidence"))


@query("trk_gap_limit", FRAMES + "SELECT video, frame, greatest(1, CAST(floor(0.1::DOUBLE * (24 + event_id % 37) + 1e-9) AS BIGINT)) AS by_age, least(itv + 3, CASE WHEN event_id % 2 = 0 THEN 3 ELSE itv + 3 END, greatest(1, CAST(floor(0.1::DOUBLE * (24 + event_id % 37) + 1e-9) AS BIGINT))) AS gap FROM frames")
def trk_gap_limit(t: Tables) -> DataFrame:
    """The longest gap between detections: as asked, at most 3 for a careful profile, and no longer than a value may age."""
    by_age = F.greatest(F.lit(1).cast("long"), F.floor(0.1 * (24 + F.col("event_id") % 37) + 1e-9).cast("long"))
    asked = F.col("itv") + 3
    careful = F.when(F.col("event_id") % 2 == 0, F.lit(3).cast("long")).otherwise(asked)
    return t.frames.select("video", "frame", by_age.alias("by_age"), F.least(asked, careful, by_age).alias("gap"))


@query("sal_refresh", GRIDS + f"SELECT vec_id, i, {Q.format('0.65::DOUBLE * v + 0.35::DOUBLE * old')} AS v FROM (SELECT vec_id, i, v, lag(v) OVER w AS old, lag(vec_id) OVER w AS prior FROM cells WINDOW w AS (PARTITION BY i ORDER BY vec_id)) WHERE prior = vec_id - 1")
def sal_refresh(t: Tables) -> DataFrame:
    """A fresh map blended with the one before, cell by cell; maps with a cell that is not within [0, 1] are refused."""
    lo = F.array_min("embedding").cast("double")
    v = F.transform("embedding", lambda x: (x.cast("double") - lo) / (F.array_max("embedding").cast("double") - lo))
    d = blended(t.read("embeddings").select("vec_id", v.alias("v")))
    return d.select("vec_id", F.posexplode("v").alias("p", "v")).select("vec_id", (F.col("p") + 1).cast("long").alias("i"), q6(F.col("v")).alias("v"))


def blended(maps: DataFrame, share: float = 0.65) -> DataFrame:
    """maps (vec_id, v: array) that have a map before them (vec_id - 1), each blended with it; whole maps meet, by an equi-join."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & x.between(-1e-6, 1 + 1e-6))
    old = maps.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("old"))
    both = maps.filter(fine).join(old, "vec_id")
    return both.select("vec_id", F.zip_with("v", "old", lambda a, b: share * a + (1 - share) * b).alias("v"))


@query("dec_lookahead", FRAMES + f"SELECT video, frame, {Q.format('value + greatest(-1920.0::DOUBLE, least(1920.0::DOUBLE, (value - prior) * 30)) * (0.15::DOUBLE * (itv / 3.0::DOUBLE))')} AS target FROM (SELECT *, lag(value) OVER (PARTITION BY video, scene ORDER BY frame) AS prior FROM frames) WHERE prior IS NOT NULL")
def dec_lookahead(t: Tables) -> DataFrame:
    """Where the target will be: its velocity, within the frame's size a second, times 0.15 s and the confidence (here itv / 3)."""
    prior = F.lag("value").over(Window.partitionBy("video", "scene").orderBy("frame"))
    f = t.frames.select("video", "frame", "value", "itv", prior.alias("prior")).filter("prior IS NOT NULL")
    ahead = F.col("value") + clamp((F.col("value") - F.col("prior")) * FPS, -float(WIDTH), float(WIDTH)) * (0.15 * clamp(F.col("itv") / 3.0, 0.0, 1.0))
    return f.select("video", "frame", q6(ahead).alias("target"))
