"""Poses of 17 points (x, y, confidence) in a box: what they prove, how they move, what a crop can hang on, and when an old one still counts.

A pose is an array in its track's row; geometry is array expressions, and a pose meets
the one before it by a window over the frames of its track.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.camera import focus_bounds
from ..functions.geometry import finite, let, q6
from ..plans.catalog import DETECTIONS, Tables, query
from .grids import total
from .overlaps import overlap, owner

Q = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"

# Places in a pose of 17 points.
SHOULDERS, HIPS = (5, 6), (11, 12)
TORSO, LIMBS = (*SHOULDERS, *HIPS), (7, 8, 9, 10, 13, 14, 15, 16)


def _struct(**parts: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def _trues(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda v: v))


def assess(points: Column, box: Column, sure: float = 0.35) -> Column:
    """What a pose proves of itself: valid, torso (17 flags each), torso_reliable, face_reliable, limb_reliable, reason.

    points: array of x, y, c; box: x1, y1, x2, y2.  Points count from `sure` within the box and 12 % around it, torso points
    from 0.5.  A torso is reliable with three points on both ends that are neither collapsed nor stretched; a face is not needed.
    Poses that are null or not of 17 points, and empty or non-finite boxes, prove nothing.
    """
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    unit_w, unit_h = (F.nullif(v, F.lit(0.0)) for v in (w, h))
    shape = F.coalesce((F.size(points) == 17) & finite(box["x1"]) & finite(box["y1"]) & finite(box["x2"]) & finite(box["y2"]) & (w > 0) & (h > 0), F.lit(False))

    def counts(p: Column) -> Column:
        near = p["x"].between(box["x1"] - 0.12 * w, box["x2"] + 0.12 * w) & p["y"].between(box["y1"] - 0.12 * h, box["y2"] + 0.12 * h)
        return F.coalesce(finite(p["x"]) & finite(p["y"]) & finite(p["c"]) & (p["c"] >= sure) & near, F.lit(False))

    valid = F.when(shape, F.transform(points, counts)).otherwise(F.array_repeat(F.lit(False), 17))
    torso = lambda v: F.transform(v, lambda on, i: on & i.isin(*TORSO) & (F.get(points, i)["c"] >= max(0.5, sure)))

    def graded(s: Column) -> Column:
        at = lambda i: _struct(on=F.get(s["torso"], F.lit(i)), x=(F.get(points, F.lit(i))["x"] - box["x1"]) / unit_w, y=(F.get(points, F.lit(i))["y"] - box["y1"]) / unit_h)
        return let(_struct(a=at(5), b=at(6), c=at(11), d=at(12)), lambda p: told(s, p))

    def told(s: Column, p: Column) -> Column:
        mean = lambda i, j, k: F.when(p[i]["on"] & p[j]["on"], (p[i][k] + p[j][k]) / 2).when(p[i]["on"], p[i][k]).otherwise(p[j][k])
        tall = length(mean("a", "b", "x") - mean("c", "d", "x"), mean("a", "b", "y") - mean("c", "d", "y"))
        odd = lambda i, j, low, high: p[i]["on"] & p[j]["on"] & ~length(p[i]["x"] - p[j]["x"], p[i]["y"] - p[j]["y"]).between(low, high)
        reason = F.when(~shape, "invalid_pose").when(_trues(s["torso"]) < 3, "insufficient_torso").when(~tall.between(0.10, 1.10) | odd("a", "b", 0.035, 1.15) | odd("c", "d", 0.025, 1.0), "collapsed_or_implausible_torso").otherwise("reliable_torso")
        face, limb = _trues(F.slice(s["valid"], 1, 5)) >= 2, _trues(F.transform(s["valid"], lambda v, i: v & i.isin(*LIMBS))) >= 2
        return let(reason, lambda r: _struct(valid=s["valid"], torso=s["torso"], torso_reliable=r == "reliable_torso", face_reliable=face, limb_reliable=limb, reason=r))

    return let(valid, lambda v: let(_struct(valid=v, torso=torso(v)), graded))


def pose_motion(before: Column, now: Column) -> Column:
    """How far torso and limbs have moved within their boxes: torso (infinite where two reliable torsos do not share three points), limb (0 without shared ones), and
    how many points each rests on.  before, now: structs of points, box and evidence (of assess)."""
    place = lambda s, i, k: (F.get(s["points"], i)[k] - s["box"][f"{k}1"]) / (s["box"][f"{k}2"] - s["box"][f"{k}1"])
    shared = lambda what, i: F.get(before["evidence"][what], i) & F.get(now["evidence"][what], i)
    moves = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: _struct(torso=shared("torso", i), limb=shared("valid", i) & i.isin(*LIMBS), far=length(place(now, i, "x") - place(before, i, "x"), place(now, i, "y") - place(before, i, "y"))))

    def told(m: Column) -> Column:
        some = lambda k: F.transform(F.filter(m, lambda x: x[k]), lambda x: x["far"])
        return let(_struct(torso=some("torso"), limb=some("limb")), lambda s: _struct(torso=F.when(F.size(s["torso"]) >= 3, F.array_max(s["torso"])).otherwise(float("inf")), limb=F.coalesce(F.array_max(s["limb"]), F.lit(0.0)), torso_points=F.size(s["torso"]), limb_points=F.size(s["limb"])))

    nothing = _struct(torso=F.lit(float("inf")), limb=F.lit(0.0), torso_points=F.lit(0), limb_points=F.lit(0))
    sound = F.coalesce(before["evidence"]["torso_reliable"] & now["evidence"]["torso_reliable"], F.lit(False))
    return F.when(sound, let(moves, told)).otherwise(nothing)


def pose_cues(points: Column, box: Column, frame_w: Column, frame_h: Column, sure: float) -> Column:
    """What a crop can hang on: head (estimated box), has_pose, eye_y, body_cx, shoulder_y, shoulder_span, the body's bounds, and whether both ankles are seen.

    Null for poses with under two counting points, or with neither a body nor a head; points are array of x, y, c, 17 of them.
    """
    x1, y1, x2, y2 = (box[k] for k in ("x1", "y1", "x2", "y2"))
    pw, ph = F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1)

    def counts(p: Column) -> Column:
        near_x = (p["x"] >= F.greatest(F.lit(0.0), x1 - pw * 0.12)) & (p["x"] < F.least(frame_w.cast("double"), x2 + pw * 0.12))
        near_y = (p["y"] >= F.greatest(F.lit(0.0), y1 - ph * 0.12)) & (p["y"] < F.least(frame_h.cast("double"), y2 + ph * 0.12))
        return F.coalesce(finite(p["x"]) & finite(p["y"]) & finite(p["c"]) & (p["c"] >= sure) & near_x & near_y, F.lit(False))

    seen = F.transform(points, lambda p: F.when(counts(p), F.struct(p["x"].alias("x"), p["y"].alias("y"))))

    def parts(v: Column) -> Column:
        at = lambda i: F.get(v, F.lit(i))
        mid = lambda i, j: F.when(at(i).isNotNull() & at(j).isNotNull(), _struct(x=(at(i)["x"] + at(j)["x"]) / 2, y=(at(i)["y"] + at(j)["y"]) / 2)).otherwise(F.coalesce(at(i), at(j)))
        gap = lambda i, j: length(at(i)["x"] - at(j)["x"], at(i)["y"] - at(j)["y"])
        face = F.filter(F.slice(v, 1, 5), lambda p: p.isNotNull())
        some = F.filter(v, lambda p: p.isNotNull())
        body = F.filter(F.slice(v, 6, 12), lambda p: p.isNotNull())
        known = _struct(anchor=F.coalesce(mid(1, 2), at(0)), shoulders=mid(5, 6), hips=mid(11, 12), span=F.abs(at(5)["x"] - at(6)["x"]), eyes=gap(1, 2), ears=gap(3, 4), face=face, some=some, body=F.size(body), ankles=at(15).isNotNull() & at(16).isNotNull())
        return let(known, lambda k: F.when(F.size(k["some"]) >= 2, headed(k)))

    def headed(k: Column) -> Column:
        values = lambda a, axis: F.transform(a, lambda p: p[axis])
        mean = lambda axis: total(values(k["face"], axis)) / F.size(k["face"])
        width = F.greatest((F.array_max(values(k["face"], "x")) - F.array_min(values(k["face"], "x"))) * 1.5, pw * 0.18, k["eyes"] * 3.0, k["ears"] * 1.2, k["span"] * 0.38)  # nulls are skipped
        centre = _struct(x=F.coalesce(k["anchor"]["x"], mean("x")), y=F.coalesce(k["anchor"]["y"], mean("y")), w=F.least(width, pw * 0.75, ph * 0.65))
        head = let(centre, lambda c: _struct(x1=F.greatest(F.lit(0.0), c["x"] - c["w"] / 2), y1=F.greatest(F.lit(0.0), c["y"] - c["w"] * 1.25 * 0.45), x2=F.least(frame_w.cast("double"), c["x"] + c["w"] / 2), y2=F.least(frame_h.cast("double"), c["y"] + c["w"] * 1.25 * 0.55)))
        whole = (k["body"] >= 2) & (k["shoulders"].isNotNull() | k["hips"].isNotNull())
        return let(_struct(head=F.when(F.size(k["face"]) >= 2, head), body=whole), lambda q: F.when(q["body"] | q["head"].isNotNull(), told(k, q)))

    def told(k: Column, q: Column) -> Column:
        xs, ys = (F.transform(k["some"], lambda p: p[axis]) for axis in ("x", "y"))
        both = k["shoulders"].isNotNull() & k["hips"].isNotNull()
        only = lambda c: F.when(q["body"], c)
        return _struct(
            head=q["head"],
            has_pose=q["body"],
            eye_y=k["anchor"]["y"],
            body_cx=F.when(both, (k["shoulders"]["x"] + k["hips"]["x"]) / 2).otherwise(F.coalesce(k["shoulders"]["x"], k["hips"]["x"], k["anchor"]["x"])),
            shoulder_y=k["shoulders"]["y"],
            shoulder_span=k["span"],
            body_top_y=only(F.least(y1, F.array_min(ys), q["head"]["y1"])),
            body_bottom_y=only(F.greatest(y2, F.array_max(ys))),
            body_min_x=only(F.least(x1, F.array_min(xs))),
            body_max_x=only(F.greatest(x2, F.array_max(xs))),
            body_bottom_confident=k["ankles"],
        )

    return F.when(F.size(points) == 17, let(seen, parts))


# Poses out of embeddings: a standing figure whose points wander by the entries; keys choose what is no pose.

#: Where the points of a standing figure lie in its box, in hundredths.
FIGURE = [(50, 10), (46, 8), (54, 8), (42, 10), (58, 10), (32, 25), (68, 25), (25, 40), (75, 40), (22, 55), (78, 55), (38, 55), (62, 55), (37, 77), (63, 77), (36, 97), (64, 97)]

POSES = (
    """WITH lv AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor((CAST(e AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE)) / (CAST(list_max(embedding) AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE)) * 256) / 256) AS v FROM embeddings),
pose AS (SELECT vec_id, label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame, v, x1, y1, x1 + CASE WHEN vec_id % 41 = 0 THEN 0 ELSE 160 + (vec_id * 17) % 200 END AS x2, y1 + 300 + (vec_id * 29) % 180 AS y2, CASE WHEN (vec_id // 20) % 2 = 0 THEN 0.0625::DOUBLE ELSE 0.25::DOUBLE END AS amp FROM (SELECT *, CAST((vec_id * 131) % 1500 AS DOUBLE) AS x1, CAST((vec_id * 71) % 600 AS DOUBLE) AS y1 FROM lv)),
figure AS (SELECT k, x / 100::DOUBLE AS fx, y / 100::DOUBLE AS fy FROM (VALUES """
    + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(FIGURE))
    + """) AS f(k, x, y)),
pts AS (SELECT p.vec_id, p.video, p.frame, p.x1, p.y1, p.x2, p.y2, k, CASE WHEN p.vec_id % 19 = 0 AND k = 0 THEN 'nan'::DOUBLE ELSE x1 + (x2 - x1) * (fx + (v[3 * k + 1] - 0.5::DOUBLE) * amp) END AS x, y1 + (y2 - y1) * (CASE WHEN p.vec_id % 13 = 0 AND k IN (11, 12) THEN 0.27::DOUBLE ELSE fy END + (v[3 * k + 2] - 0.5::DOUBLE) * amp) AS y, 0.25::DOUBLE + 0.75::DOUBLE * v[3 * k + 3] AS c FROM pose p, figure WHERE p.vec_id % 31 <> 0 AND k < CASE WHEN p.vec_id % 37 = 0 THEN 16 ELSE 17 END),
marked AS (SELECT *, valid AND k IN (5, 6, 11, 12) AND c >= 0.5 AS torso, (x - x1) / (x2 - x1) AS nx, (y - y1) / (y2 - y1) AS ny FROM (SELECT *, coalesce(isfinite(x) AND c >= 0.35::DOUBLE AND x BETWEEN x1 - 0.12::DOUBLE * (x2 - x1) AND x2 + 0.12::DOUBLE * (x2 - x1) AND y BETWEEN y1 - 0.12::DOUBLE * (y2 - y1) AND y2 + 0.12::DOUBLE * (y2 - y1), false) AS valid FROM pts WHERE vec_id % 37 <> 0 AND x2 > x1)),
ends AS (SELECT vec_id, count_if(valid) AS n_valid, count_if(torso) AS n_torso, count_if(valid AND k < 5) AS n_face, count_if(valid AND k IN (7, 8, 9, 10, 13, 14, 15, 16)) AS n_limb, count_if(torso AND k IN (5, 6)) AS ns, count_if(torso AND k IN (11, 12)) AS nh, avg(nx) FILTER (torso AND k IN (5, 6)) AS sx, avg(ny) FILTER (torso AND k IN (5, 6)) AS sy, avg(nx) FILTER (torso AND k IN (11, 12)) AS hx, avg(ny) FILTER (torso AND k IN (11, 12)) AS hy,
sqrt(pow(max(nx) FILTER (k = 5) - max(nx) FILTER (k = 6), 2) + pow(max(ny) FILTER (k = 5) - max(ny) FILTER (k = 6), 2)) AS ds, sqrt(pow(max(nx) FILTER (k = 11) - max(nx) FILTER (k = 12), 2) + pow(max(ny) FILTER (k = 11) - max(ny) FILTER (k = 12), 2)) AS dh FROM marked GROUP BY vec_id),
evidence AS (SELECT p.vec_id, p.video, p.frame, coalesce(n_valid, 0) AS n_valid, coalesce(n_torso, 0) AS n_torso, coalesce(n_face, 0) >= 2 AS face, coalesce(n_limb, 0) >= 2 AS limb, CASE WHEN n_valid IS NULL THEN 'invalid_pose' WHEN n_torso < 3 THEN 'insufficient_torso' WHEN NOT (sqrt(pow(sx - hx, 2) + pow(sy - hy, 2)) BETWEEN 0.1::DOUBLE AND 1.1::DOUBLE) OR (ns = 2 AND NOT (ds BETWEEN 0.035::DOUBLE AND 1.15::DOUBLE)) OR (nh = 2 AND NOT (dh BETWEEN 0.025::DOUBLE AND 1.0::DOUBLE)) THEN 'collapsed_or_implausible_torso' ELSE 'reliable_torso' END AS reason FROM pose p LEFT JOIN ends USING (vec_id))
"""
)


def poses(t: Tables) -> DataFrame:
    """The same as DataFrame: vec_id, video, frame, v (64 values 0 to 1), box, points."""
    n = F.col("vec_id")
    lo, hi = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    frame = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    e = t.read("embeddings").select("vec_id", F.col("label").alias("video"), frame.alias("frame"), "embedding", lo.alias("lo"), hi.alias("hi"))
    e = e.withColumn("v", F.transform("embedding", lambda x: F.floor((x.cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256) / 256)).drop("embedding", "lo", "hi")
    x1, y1 = ((n * 131) % 1500).cast("double"), ((n * 71) % 600).cast("double")
    e = e.withColumn("box", _struct(x1=x1, y1=y1, x2=x1 + F.when(n % 41 == 0, 0).otherwise(160 + (n * 17) % 200), y2=y1 + 300 + (n * 29) % 180))
    amp = F.when(F.floor(n / 20) % 2 == 0, 0.0625).otherwise(0.25)
    box, v = F.col("box"), lambda i: F.get("v", i)
    figure = F.array(*[_struct(x=F.lit(x / 100), y=F.lit(y / 100)) for x, y in FIGURE])

    def point(f: Column, k: Column) -> Column:
        x = box["x1"] + (box["x2"] - box["x1"]) * (f["x"] + (v(3 * k) - 0.5) * amp)
        y = box["y1"] + (box["y2"] - box["y1"]) * (F.when((n % 13 == 0) & k.isin(*HIPS), 0.27).otherwise(f["y"]) + (v(3 * k + 1) - 0.5) * amp)
        return _struct(x=F.when((n % 19 == 0) & (k == 0), float("nan")).otherwise(x), y=y, c=0.25 + 0.75 * v(3 * k + 2))

    points = F.when(n % 31 != 0, F.transform(F.slice(figure, 1, F.when(n % 37 == 0, 16).otherwise(17)), point))
    return e.withColumn("points", points)


def assessed(t: Tables) -> DataFrame:
    return poses(t).withColumn("evidence", assess(F.col("points"), F.col("box")))


@query("agg_pose_evidence", POSES + "SELECT vec_id, reason, reason = 'reliable_torso' AS torso, face, limb, n_valid, n_torso FROM evidence")
def agg_pose_evidence(t: Tables) -> DataFrame:
    e = F.col("evidence")
    return assessed(t).select("vec_id", e["reason"].alias("reason"), e["torso_reliable"].alias("torso"), e["face_reliable"].alias("face"), e["limb_reliable"].alias("limb"), _trues(e["valid"]).cast("long").alias("n_valid"), _trues(e["torso"]).cast("long").alias("n_torso"))


def with_motion(d: DataFrame, keys: list[str], lag: int = 1) -> DataFrame:
    """d (points, box, evidence, frame) with `before` (those of the same keys `lag` frames earlier; null if that frame has none) and `motion`."""
    now = F.struct("points", "box", "evidence", "frame")
    d = d.withColumn("before", F.lag(now).over(Window.partitionBy(*keys).orderBy("frame")))
    d = d.withColumn("before", F.when(F.col("before.frame") == F.col("frame") - lag, F.col("before")))
    return d.withColumn("motion", F.when(F.col("before").isNotNull(), pose_motion(F.col("before"), now)))


#: What has moved since the pose `{0}` frames before.
MOTION = """, moves AS (SELECT b.vec_id, count_if(a.torso AND b.torso) AS n_torso, count_if(a.valid AND b.valid AND a.k IN (7, 8, 9, 10, 13, 14, 15, 16)) AS n_limb, max(sqrt(pow(b.nx - a.nx, 2) + pow(b.ny - a.ny, 2))) FILTER (a.torso AND b.torso) AS torso, max(sqrt(pow(b.nx - a.nx, 2) + pow(b.ny - a.ny, 2))) FILTER (a.valid AND b.valid AND a.k IN (7, 8, 9, 10, 13, 14, 15, 16)) AS limb
FROM marked a JOIN marked b ON a.video = b.video AND a.frame + {0} = b.frame AND a.k = b.k JOIN evidence ea ON ea.vec_id = a.vec_id AND ea.reason = 'reliable_torso' JOIN evidence eb ON eb.vec_id = b.vec_id AND eb.reason = 'reliable_torso' GROUP BY b.vec_id)
"""


@query("agg_pose_motion", POSES + MOTION.format(1) + f"SELECT p.vec_id, CASE WHEN n_torso >= 3 THEN {Q.format('torso')} END AS torso_q, {Q.format('coalesce(limb, 0)')} AS limb_q, coalesce(n_torso, 0) AS torso_points, coalesce(n_limb, 0) AS limb_points FROM pose p LEFT JOIN moves USING (vec_id) WHERE frame > 1")
def agg_pose_motion(t: Tables) -> DataFrame:
    """Null for a torso that has no measured motion, which the operator has as infinite."""
    m = F.col("motion")
    d = with_motion(assessed(t), ["video"]).filter("motion IS NOT NULL")
    return d.select("vec_id", F.when(m["torso"] < float("inf"), q6(m["torso"])).alias("torso_q"), q6(m["limb"]).alias("limb_q"), m["torso_points"].cast("long").alias("torso_points"), m["limb_points"].cast("long").alias("limb_points"))


CUES = (
    POSES
    + """, ok AS (SELECT * FROM (SELECT *, coalesce(isfinite(x) AND c >= 0.35::DOUBLE AND x >= greatest(0, x1 - greatest(1, x2 - x1) * 0.12::DOUBLE) AND x < least(1920, x2 + greatest(1, x2 - x1) * 0.12::DOUBLE) AND y >= greatest(0, y1 - greatest(1, y2 - y1) * 0.12::DOUBLE) AND y < least(1080, y2 + greatest(1, y2 - y1) * 0.12::DOUBLE), false) AS seen FROM pts WHERE vec_id % 37 <> 0) WHERE seen),
known AS (SELECT vec_id, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2, greatest(1, min(x2 - x1)) AS pw, greatest(1, min(y2 - y1)) AS ph, count(*) AS n, count_if(k < 5) AS nf, count_if(k >= 5) AS nb, coalesce(avg(x) FILTER (k IN (1, 2)), max(x) FILTER (k = 0)) AS ax, coalesce(avg(y) FILTER (k IN (1, 2)), max(y) FILTER (k = 0)) AS ay, avg(x) FILTER (k < 5) AS fx, avg(y) FILTER (k < 5) AS fy, max(x) FILTER (k < 5) - min(x) FILTER (k < 5) AS wide, avg(x) FILTER (k IN (5, 6)) AS sx, avg(y) FILTER (k IN (5, 6)) AS sy, avg(x) FILTER (k IN (11, 12)) AS hx, avg(y) FILTER (k IN (11, 12)) AS hy,
abs(max(x) FILTER (k = 5) - max(x) FILTER (k = 6)) AS span, sqrt(pow(max(x) FILTER (k = 1) - max(x) FILTER (k = 2), 2) + pow(max(y) FILTER (k = 1) - max(y) FILTER (k = 2), 2)) AS eyes, sqrt(pow(max(x) FILTER (k = 3) - max(x) FILTER (k = 4), 2) + pow(max(y) FILTER (k = 3) - max(y) FILTER (k = 4), 2)) AS ears, min(x) AS lx, max(x) AS rx, min(y) AS ty, max(y) AS by_, count_if(k IN (15, 16)) = 2 AS ankles FROM ok GROUP BY vec_id HAVING count(*) >= 2),
headed AS (SELECT *, nb >= 2 AND (sx IS NOT NULL OR hx IS NOT NULL) AS body, CASE WHEN nf >= 2 THEN least(greatest(wide * 1.5, pw * 0.18::DOUBLE, coalesce(eyes * 3, 0), coalesce(ears * 1.2::DOUBLE, 0), coalesce(span * 0.38::DOUBLE, 0)), pw * 0.75, ph * 0.65::DOUBLE) END AS hw FROM known),
cues AS (SELECT *, greatest(0, coalesce(ax, fx) - hw / 2) AS h1, CASE WHEN hw IS NOT NULL THEN greatest(0, coalesce(ay, fy) - hw * 1.25 * 0.45::DOUBLE) END AS h2, CASE WHEN hw IS NOT NULL THEN least(1920, coalesce(ax, fx) + hw / 2) END AS h3, CASE WHEN hw IS NOT NULL THEN least(1080, coalesce(ay, fy) + hw * 1.25 * 0.55::DOUBLE) END AS h4 FROM headed WHERE body OR hw IS NOT NULL)
"""
)


@query(
    "agg_pose_cues",
    CUES
    + f"""SELECT vec_id, body AS has_pose, ankles, CASE WHEN hw IS NOT NULL THEN {Q.format('h1')} END AS head_x1, {Q.format('h2')} AS head_y1, {Q.format('h3')} AS head_x2, {Q.format('h4')} AS head_y2, {Q.format('ay')} AS eye_y, {Q.format('CASE WHEN sx IS NOT NULL AND hx IS NOT NULL THEN (sx + hx) / 2 ELSE coalesce(sx, hx, ax) END')} AS body_cx, {Q.format('sy')} AS shoulder_y, {Q.format('span')} AS shoulder_span,
CASE WHEN body THEN {Q.format('least(y1, ty, coalesce(h2, y1))')} END AS top, CASE WHEN body THEN {Q.format('greatest(y2, by_)')} END AS bottom, CASE WHEN body THEN {Q.format('least(x1, lx)')} END AS lft, CASE WHEN body THEN {Q.format('greatest(x2, rx)')} END AS rgt FROM cues""",
)
def agg_pose_cues(t: Tables) -> DataFrame:
    c = F.col("cues")
    d = poses(t).withColumn("cues", pose_cues(F.col("points"), F.col("box"), F.lit(1920), F.lit(1080), 0.35)).filter("cues IS NOT NULL")
    told = {"head_x1": c["head"]["x1"], "head_y1": c["head"]["y1"], "head_x2": c["head"]["x2"], "head_y2": c["head"]["y2"], "eye_y": c["eye_y"], "body_cx": c["body_cx"], "shoulder_y": c["shoulder_y"], "shoulder_span": c["shoulder_span"], "top": c["body_top_y"], "bottom": c["body_bottom_y"], "lft": c["body_min_x"], "rgt": c["body_max_x"]}
    return d.select("vec_id", c["has_pose"].alias("has_pose"), c["body_bottom_confident"].alias("ankles"), *[q6(v).alias(k) for k, v in told.items()])


# When a pose counts.


def same_box(old: Column, new: Column, tolerance: float = 0.2) -> Column:
    """Whether a box (struct) has about the size and place of an older one."""
    ow, oh = (F.greatest(F.lit(1.0), old[f"{a}2"] - old[f"{a}1"]) for a in "xy")
    low, high = 1 - tolerance, 1 / (1 - tolerance)
    sized = ((new["x2"] - new["x1"]) / ow).between(low, high) & ((new["y2"] - new["y1"]) / oh).between(low, high)
    return sized & (F.abs(new["x1"] - old["x1"]) < ow * tolerance) & (F.abs(new["y1"] - old["y1"]) < oh * tolerance)


def reliable_pose(track: dict[str, Column], pose: dict[str, Column], oldest: float) -> Column:
    """Whether a track's pose may stand for a look at the picture.

    track: reliable, confidence, id; pose: has_pose, torso_reliable, id, current (remapped to this very frame), gap (frames since
    it was measured), age (seconds), same_scene, same_size.  What is null does not count.
    """
    ok = track["reliable"] & pose["has_pose"] & (track["confidence"] >= 0.45) & (track["id"] == pose["id"]) & pose["current"] & (pose["gap"] >= 0) & pose["same_scene"] & pose["same_size"]
    return F.coalesce(ok & (pose["age"] >= 0) & (pose["age"] <= oldest + 1e-8) & pose["torso_reliable"], F.lit(False))


@query(
    "sal_reliable_pose",
    CUES + ", has AS (SELECT vec_id, body FROM cues) SELECT vec_id, coalesce(vec_id % 5 > 0 AND body AND 0.3::DOUBLE + 0.7::DOUBLE * v[52] >= 0.45::DOUBLE AND vec_id % 7 > 0 AND vec_id % 11 > 0 AND vec_id % 17 > 0 AND vec_id % 23 > 0 AND vec_id % 6 / 10 <= 0.35::DOUBLE + 1e-8 AND reason = 'reliable_torso', false) AS reliable FROM pose LEFT JOIN has USING (vec_id) LEFT JOIN evidence USING (vec_id)",
)
def sal_reliable_pose(t: Tables) -> DataFrame:
    n = F.col("vec_id")
    d = assessed(t).withColumn("cues", pose_cues(F.col("points"), F.col("box"), F.lit(1920), F.lit(1080), 0.35))
    track = {"reliable": n % 5 > 0, "confidence": 0.3 + 0.7 * F.get("v", F.lit(51)), "id": F.when(n % 7 > 0, n)}
    pose = {"has_pose": F.col("cues.has_pose"), "torso_reliable": F.col("evidence.torso_reliable"), "id": n, "current": n % 11 > 0, "gap": n % 6, "age": n % 6 / 10, "same_scene": n % 17 > 0, "same_size": n % 23 > 0}
    return d.select("vec_id", reliable_pose(track, pose, 0.35).alias("reliable"))


def pose_stability(subjects: DataFrame, frame: list[str], order: str) -> DataFrame:
    """A row per frame: stable, and the reason of the first subject (by `order`) that is not: pose_missing, torso_motion, reliable_limb_motion.

    subjects: points and motion (of with_motion); a frame is stable where every subject has a pose now and before and neither torso nor limbs moved far.
    """
    m = F.col("motion")
    missing = F.col("points").isNull() | F.col("before").isNull() | F.col("before.points").isNull()
    why = F.when(missing, "pose_missing").when(m["torso"] > 0.10, "torso_motion").when(m["limb"] > 0.18, "reliable_limb_motion")
    g = subjects.withColumn("why", why).groupBy(*frame).agg(F.min(F.when(F.col("why").isNotNull(), F.struct(order, "why"))).alias("first"))
    return g.select(*frame, F.col("first").isNull().alias("stable"), F.col("first.why").alias("reason"))


@query(
    "sal_pose_stable",
    POSES + MOTION.format(2) + """SELECT video, frame, reason IS NULL AS stable, reason FROM (SELECT video, (frame + 1) // 2 AS frame, min_by(why, frame) FILTER (why IS NOT NULL) AS reason FROM (SELECT p.video, p.frame, CASE WHEN p.vec_id % 31 = 0 OR o.vec_id IS NULL OR o.vec_id % 31 = 0 THEN 'pose_missing' WHEN coalesce(n_torso, 0) < 3 OR torso > 0.1::DOUBLE THEN 'torso_motion' WHEN limb > 0.18::DOUBLE THEN 'reliable_limb_motion' END AS why FROM pose p LEFT JOIN pose o ON o.video = p.video AND o.frame = p.frame - 2 LEFT JOIN moves m ON m.vec_id = p.vec_id) GROUP BY ALL)""",
)
def sal_pose_stable(t: Tables) -> DataFrame:
    """Two poses of a video make a frame here, the subjects 0 and 1."""
    d = assessed(t).withColumns({"subject": (F.col("frame") - 1) % 2, "frame": F.floor((F.col("frame") + 1) / 2).cast("long")})
    return pose_stability(with_motion(d, ["video", "subject"]), ["video", "frame"], "subject")


def extension_reason(track: dict[str, Column], pose: dict[str, Column], others: Column, mask: dict[str, Column], frame: dict[str, Column], oldest: float = 0.1) -> Column:
    """'extended' where a pose past its interval may be used a little longer, else the first reason against it.

    frame: adaptive, safe, identities_stable; track: reliable, confidence, box, id; pose: box (where it was measured), torso_reliable,
    stable (measurements in a row); others: array of reliable, id, box, confidence (all people of the frame); mask: stable,
    observations, measured_with_track, age, change, gap, same_scene (null observations: no mask).
    """
    b = track["box"]
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    grown = {"x1": b["x1"] - 0.15 * w, "y1": b["y1"] - 0.15 * h, "x2": b["x2"] + 0.15 * w, "y2": b["y2"] + 0.15 * h}

    def against(o: Column) -> Column:
        c = o["box"]
        touch = (F.least(grown["x2"], c["x2"]) > F.greatest(grown["x1"], c["x1"])) & (F.least(grown["y2"], c["y2"]) > F.greatest(grown["y1"], c["y1"]))
        area = F.greatest(F.lit(0.0), c["x2"] - c["x1"]) * F.greatest(F.lit(0.0), c["y2"] - c["y1"])
        weighs = o["confidence"] * area * 1.5 >= track["confidence"] * F.greatest(F.lit(1.0), w * h)
        return F.when(~o["reliable"], "tracking_unreliable").when(o["id"] == track["id"], None).when(touch, "near_competitor").when(weighs, "prominent_competitor")

    rival = F.get(F.filter(F.transform(others, against), lambda x: x.isNotNull()), F.lit(0))
    fresh = mask["measured_with_track"] & (mask["age"] >= 0) & (mask["age"] <= oldest + 1e-9) & (mask["gap"] >= 0) & mask["same_scene"] & mask["change"].between(0, 0.08)
    return (
        F.when(~frame["adaptive"], "profile_disabled")
        .when(~frame["safe"], "unsafe_frame")
        .when(~frame["identities_stable"], "identity_changed")
        .when(~F.coalesce(track["reliable"], F.lit(False)), "tracking_unreliable")
        .when((track["confidence"] < 0.5) | ~same_box(pose["box"], b, 0.08), "track_motion")
        .when(~pose["torso_reliable"], "torso_unreliable")
        .when(F.coalesce(pose["stable"], F.lit(0)) < 2, "pose_history_or_motion")
        .when(rival.isNotNull(), rival)
        .when(~F.coalesce(mask["stable"] & (mask["observations"] >= 2), F.lit(False)), "mask_unstable_or_missing")
        .when(~F.coalesce(fresh, F.lit(False)), "mask_stale_or_changed")
        .otherwise("extended")
    )


def trustworthy(track: dict[str, Column], pose: dict[str, Column], extension: Column, interval: int, fps: int, oldest: float, fresh: bool = True) -> Column:
    """Whether the pose kept of a track may stand in for a new one; with fresh false only whether it is worth looking at first.

    track: reliable, box, id; pose (nulls: none kept): box, id, gap (frames), age (seconds), same_scene, has_pose, torso_reliable; extension: extension_reason.
    """
    most = max(interval, math.ceil(oldest * fps)) if fresh else max(2, interval * 2, math.ceil(oldest * fps))
    ok = track["reliable"] & (pose["id"] == track["id"]) & pose["same_scene"] & (pose["gap"] >= 0) & (pose["gap"] < most) & (pose["age"] >= 0) & (pose["age"] < most / fps)
    ok = F.coalesce(ok & same_box(pose["box"], track["box"], 0.1) & pose["has_pose"] & pose["torso_reliable"], F.lit(False))
    if not fresh:
        return ok
    past = (pose["gap"] >= interval) | (pose["age"] + 1e-9 >= interval / fps)
    still = F.when((pose["gap"] == 0) & (pose["age"] == 0), True).when(F.lit(oldest == 0) | (pose["age"] + 1e-9 >= oldest), False).when(past, extension == "extended").otherwise(True)
    return ok & still


def _kept(t: Tables) -> tuple[DataFrame, dict, dict, dict, dict, Column]:
    """Poses with what a cache holds of them; keys choose ages and changes."""
    n, b = F.col("vec_id"), F.col("box")
    w = b["x2"] - b["x1"]
    old = _struct(x1=b["x1"] + w * (n % 9) / 90, y1=b["y1"], x2=b["x1"] + w * (n % 9) / 90 + w * (1 + n % 5 / 70), y2=b["y2"])
    d = assessed(t).withColumns({"old": old, "cues": pose_cues(F.col("points"), b, F.lit(1920), F.lit(1080), 0.35)})

    def other(j: Column) -> Column:
        x1 = (n * 57 + j * 811) % 1500
        return _struct(reliable=(n + j) % 9 > 0, id=F.when(j == 0, n).otherwise(-j), box=F.when(j == 0, b).otherwise(_struct(x1=x1.cast("double"), y1=b["y1"], x2=(x1 + 60 + (n * 13 + j * 37) % 150).cast("double"), y2=b["y1"] + 120 + (n * 7) % 90)), confidence=0.4 + F.get("v", (51 + j).cast("int")) / 2)

    d = d.withColumn("others", F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), lambda j: j <= n % 3), other))
    track = {"reliable": n % 8 > 0, "confidence": 0.4 + 0.6 * F.get("v", F.lit(51)), "box": b, "id": n}
    pose = {"box": F.col("old"), "id": F.when(n % 13 > 0, n), "gap": n % 12, "age": n % 12 / 30, "same_scene": n % 14 > 0, "has_pose": F.col("cues.has_pose"), "torso_reliable": F.col("evidence.torso_reliable"), "stable": n % 4 + 1}
    mask = {"stable": n % 6 > 0, "observations": n % 10, "measured_with_track": n % 16 > 0, "age": n % 7 / 50, "change": n % 10 / 100, "gap": n % 3, "same_scene": n % 21 > 0}
    frame = {"adaptive": n % 15 > 0, "safe": n % 10 > 0, "identities_stable": n % 12 != 5}
    return d, track, pose, mask, frame, F.col("others")


KEPT = (
    CUES
    + """, kept AS (SELECT p.*, e.reason AS torso_why, coalesce(c.body, false) AS has, 0.4::DOUBLE + 0.6::DOUBLE * v[52] AS conf, x2 - x1 AS w, y2 - y1 AS h, x1 + (x2 - x1) * (p.vec_id % 9) / 90 AS ox1, x1 + (x2 - x1) * (p.vec_id % 9) / 90 + (x2 - x1) * (1 + p.vec_id % 5 / 70::DOUBLE) AS ox2 FROM pose p JOIN evidence e USING (vec_id) LEFT JOIN (SELECT vec_id, body FROM cues) c USING (vec_id)),
others AS (SELECT k.vec_id, j, (k.vec_id + j) % 9 > 0 AS reliable, (k.vec_id * 57 + j * 811) % 1500 AS a1, (k.vec_id * 57 + j * 811) % 1500 + 60 + (k.vec_id * 13 + j * 37) % 150 AS a2, y1 + 120 + (k.vec_id * 7) % 90 AS b2, 0.4::DOUBLE + v[52 + j] / 2 AS oc, k.x1, k.y1, k.x2, k.y2, k.w, k.h, k.conf FROM kept k, range(0, 3) AS s(j) WHERE j <= k.vec_id % 3),
rival AS (SELECT vec_id, min_by(why, j) AS why FROM (SELECT vec_id, j, CASE WHEN NOT reliable THEN 'tracking_unreliable' WHEN j = 0 THEN NULL WHEN least(x2 + 0.15::DOUBLE * w, a2) > greatest(x1 - 0.15::DOUBLE * w, a1) AND least(y2 + 0.15::DOUBLE * h, b2) > greatest(y1 - 0.15::DOUBLE * h, y1) THEN 'near_competitor' WHEN oc * ((a2 - a1) * (b2 - y1)) * 1.5 >= conf * greatest(1, w * h) THEN 'prominent_competitor' END AS why FROM others) WHERE why IS NOT NULL GROUP BY vec_id),
boxes AS (SELECT *, greatest(1, ox2 - ox1) AS ow, (x2 - x1) / greatest(1, ox2 - ox1) AS s, abs(x1 - ox1) AS d FROM kept),
extension AS (SELECT b.*, CASE WHEN b.vec_id % 15 = 0 THEN 'profile_disabled' WHEN b.vec_id % 10 = 0 THEN 'unsafe_frame' WHEN b.vec_id % 12 = 5 THEN 'identity_changed' WHEN b.vec_id % 8 = 0 THEN 'tracking_unreliable' WHEN conf < 0.5 OR NOT (s BETWEEN 1 - 0.08::DOUBLE AND 1 / (1 - 0.08::DOUBLE) AND d < ow * 0.08::DOUBLE) THEN 'track_motion' WHEN torso_why <> 'reliable_torso' THEN 'torso_unreliable' WHEN b.vec_id % 4 + 1 < 2 THEN 'pose_history_or_motion' WHEN why IS NOT NULL THEN why WHEN b.vec_id % 6 = 0 OR b.vec_id % 10 < 2 THEN 'mask_unstable_or_missing'
WHEN b.vec_id % 16 = 0 OR b.vec_id % 7 / 50::DOUBLE > 0.1::DOUBLE + 1e-9 OR b.vec_id % 21 = 0 OR b.vec_id % 10 / 100::DOUBLE > 0.08::DOUBLE THEN 'mask_stale_or_changed' ELSE 'extended' END AS extension FROM boxes b LEFT JOIN rival USING (vec_id))
"""
)


@query("pos_extension_reason", KEPT + "SELECT vec_id, extension AS reason FROM extension")
def pos_extension_reason(t: Tables) -> DataFrame:
    d, track, pose, mask, frame, others = _kept(t)
    return d.select("vec_id", extension_reason(track, pose, others, mask, frame).alias("reason"))


@query(
    "pos_trust",
    KEPT
    + """SELECT vec_id, ok AND gap < 6 AS worth, ok AND gap < 5 AND CASE WHEN gap = 0 THEN true WHEN gap / 30::DOUBLE + 1e-9 >= 0.15::DOUBLE THEN false WHEN gap >= 3 THEN extension = 'extended' ELSE true END AS trusted
FROM (SELECT *, vec_id % 12 AS gap, vec_id % 8 > 0 AND vec_id % 13 > 0 AND vec_id % 14 > 0 AND s BETWEEN 1 - 0.1::DOUBLE AND 1 / (1 - 0.1::DOUBLE) AND d < ow * 0.1::DOUBLE AND has AND torso_why = 'reliable_torso' AS ok FROM extension)""",
)
def pos_trust(t: Tables) -> DataFrame:
    d, track, pose, mask, frame, others = _kept(t)
    why = extension_reason(track, pose, others, mask, frame)
    worth, trusted = (trustworthy(track, pose, why, 3, 30, 0.15, fresh) for fresh in (False, True))
    return d.select("vec_id", worth.alias("worth"), trusted.alias("trusted"))


# Which pose is whose.


def roi_matches(frames: DataFrame, apart: float = 0.10) -> DataFrame:
    """frames (people: array of idx, box; found: array of idx, no, box, what a look at the region of person idx has found) with `matches`: array of idx, no.

    Of what a region shows, what belongs to its own person by all people's boxes; the best by overlap with that person, and none where
    a second is within `apart`.  All in a frame's row: nothing is joined.
    """

    def match(p: Column) -> Column:
        own = F.filter(F.filter("found", lambda f: f["idx"] == p["idx"]), lambda f: owner(f["box"], F.col("people")) == p["idx"])
        ranked = F.sort_array(F.transform(own, lambda f: _struct(iou=overlap(f["box"], p["box"]), no=f["no"])), asc=False)
        clear = lambda r: (F.size(r) == 1) | (F.get(r, F.lit(0))["iou"] - F.get(r, F.lit(1))["iou"] >= apart)
        return let(ranked, lambda r: F.when((F.size(r) > 0) & clear(r), _struct(idx=p["idx"], no=F.get(r, F.lit(0))["no"])))

    return frames.withColumn("matches", F.filter(F.transform("people", match), lambda m: m.isNotNull()))


FOUND = DETECTIONS + """, found AS (SELECT frame, idx, no, x1 + sh * (x2 - x1) AS fx1, y1 AS fy1, x2 + sh * (x2 - x1) AS fx2, y2 + qty * no AS fy2 FROM (SELECT *, (no * (1 + l_partkey % 4) - l_suppkey % 2) / 8::DOUBLE AS sh FROM det, range(0, 3) AS s(no) WHERE no <= l_partkey % 3)),
shares AS (SELECT f.frame, f.idx, f.no, d.idx AS other, i / greatest(1, (fx2 - fx1) * (fy2 - fy1) + (x2 - x1) * (y2 - y1) - i) AS iou FROM (SELECT *, greatest(0, least(fx2, x2) - greatest(fx1, x1)) * greatest(0, least(fy2, y2) - greatest(fy1, y1)) AS i FROM found f JOIN (SELECT frame AS dframe, idx AS didx, x1, y1, x2, y2 FROM det) d ON f.frame = d.dframe) f JOIN (SELECT frame, idx FROM det) d ON d.frame = f.frame AND d.idx = f.didx),
owned AS (SELECT frame, idx, no, own FROM (SELECT frame, idx, no, other, iou, max(CASE WHEN other = idx THEN iou END) OVER (PARTITION BY frame, idx, no) AS own, row_number() OVER w AS k, lead(iou) OVER w AS second FROM shares WINDOW w AS (PARTITION BY frame, idx, no ORDER BY iou DESC, other DESC)) WHERE k = 1 AND iou >= 0.3::DOUBLE AND (second IS NULL OR iou - second >= 0.1::DOUBLE) AND other = idx)
"""


@query("jn_roi_match", FOUND + "SELECT frame, idx, no FROM (SELECT *, row_number() OVER w AS k, lead(own) OVER w AS second FROM owned WINDOW w AS (PARTITION BY frame, idx ORDER BY own DESC, no DESC)) WHERE k = 1 AND (second IS NULL OR own - second >= 0.1::DOUBLE)")
def jn_roi_match(t: Tables) -> DataFrame:
    d, w = t.detections, F.col("x2") - F.col("x1")

    def seen(no: Column) -> Column:
        shift = (no * (1 + F.col("l_partkey") % 4) - F.col("l_suppkey") % 2) / 8
        return _struct(idx=F.col("idx"), no=no, box=_struct(x1=F.col("x1") + shift * w, y1=F.col("y1"), x2=F.col("x2") + shift * w, y2=F.col("y2") + F.col("qty") * no))

    found = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), lambda no: no <= F.col("l_partkey") % 3), seen)
    person = _struct(idx=F.col("idx"), box=F.struct("x1", "y1", "x2", "y2"))
    g = d.select("frame", person.alias("person"), found.alias("seen")).groupBy("frame").agg(F.collect_list("person").alias("people"), F.flatten(F.collect_list("seen")).alias("found"))
    return roi_matches(g).select("frame", F.inline("matches"))


# What a crop should show.


@query(
    "dec_focus_bounds",
    CUES
    + f""", cand AS (SELECT p.vec_id, p.vec_id % 6 > 0 AS person, p.x1, p.y1, p.x2, p.y2, p.y1 + p.vec_id % 30 AS mask_top, coalesce(c.body, false) AS body, coalesce(c.ankles, false) AS sure, c.ay AS eye, c.h1, c.h2, c.h3, c.h4, c.hw, least(c.x1, c.lx) AS bl, greatest(c.x2, c.rx) AS br, least(c.y1, c.ty, coalesce(c.h2, c.y1)) AS bt, greatest(c.y2, c.by_) AS bb, p.vec_id % 3 = 0 AS sal FROM pose p LEFT JOIN cues c ON c.vec_id = p.vec_id),
base AS (SELECT *, person AND body AND vec_id % 7 > 0 AS by_body, person AND hw IS NOT NULL AS by_head FROM cand),
edge AS (SELECT *, CASE WHEN by_body THEN least(bl, x1) WHEN by_head THEN least(x1, h1 - greatest(1, h3 - h1) * 0.15::DOUBLE) ELSE x1 END AS l, CASE WHEN by_body THEN bt WHEN by_head THEN least(y1, h2 - greatest(1, h4 - h2) * 0.15::DOUBLE) ELSE mask_top END AS t, CASE WHEN by_body THEN greatest(br, x2) WHEN by_head THEN greatest(x2, h3 + greatest(1, h3 - h1) * 0.15::DOUBLE) ELSE x2 END AS r, CASE WHEN by_body THEN CASE WHEN sure THEN bb ELSE greatest(bb, y2) END WHEN by_head THEN y2 + (y2 - y1) * 0.08::DOUBLE ELSE y2 END AS b FROM base),
roomy AS (SELECT vec_id, sal, x1, y1, CASE WHEN by_body OR by_head THEN l ELSE l - greatest(1, r - l) * 0.14::DOUBLE END AS l, CASE WHEN by_body THEN t - CASE WHEN eye IS NOT NULL THEN greatest(greatest(1, b - t) * 0.12::DOUBLE, greatest(0, eye - t) * 1.35::DOUBLE) ELSE greatest(1, b - t) * 0.15::DOUBLE END WHEN by_head THEN t ELSE t - greatest(1, b - t) * 0.14::DOUBLE END AS t, CASE WHEN by_body OR by_head THEN r ELSE r + greatest(1, r - l) * 0.14::DOUBLE END AS r, CASE WHEN by_body THEN b + greatest(1, b - t) * CASE WHEN sure THEN 0.08::DOUBLE ELSE 0.18::DOUBLE END WHEN by_head THEN b ELSE b + greatest(1, b - t) * 0.16::DOUBLE END AS b FROM edge),
kept AS (SELECT vec_id, CASE WHEN sal THEN least(l, x1 - 40 - 21.6::DOUBLE) ELSE l END AS l, CASE WHEN sal THEN least(t, y1 + 30 - 8) ELSE t END AS t, CASE WHEN sal THEN greatest(r, x1 + 80 + 21.6::DOUBLE) ELSE r END AS r, CASE WHEN sal THEN greatest(b, y1 + 60 + 8) ELSE b END AS b FROM roomy)
SELECT vec_id, {Q.format('l')} AS l, {Q.format('t')} AS t, {Q.format('r')} AS r, {Q.format('b')} AS b FROM kept""",
)
def dec_focus_bounds(t: Tables) -> DataFrame:
    n, b = F.col("vec_id"), F.col("box")
    d = poses(t).withColumn("cues", pose_cues(F.col("points"), b, F.lit(1920), F.lit(1080), 0.35))
    q = F.col("cues")
    body = _struct(min_x=F.when(n % 7 > 0, q["body_min_x"]), max_x=q["body_max_x"], top=q["body_top_y"], bottom=q["body_bottom_y"])
    salient = _struct(x1=F.when(n % 3 == 0, b["x1"] - 40), y1=b["y1"] + 30, x2=b["x1"] + 80, y2=b["y1"] + 60)
    c = {"person": n % 6 > 0, "x1": b["x1"], "y1": b["y1"], "x2": b["x2"], "y2": b["y2"], "mask_top": b["y1"] + n % 30, "body": body, "bottom_sure": F.coalesce(q["body_bottom_confident"], F.lit(False)), "eye_y": q["eye_y"], "head": q["head"], "salient": salient}
    return d.select("vec_id", focus_bounds(c).alias("f")).select("vec_id", *[q6(F.col(f"f.{k}")).alias(k) for k in ("l", "t", "r", "b")])


def debug_boxes(frames: DataFrame, width: int, height: int, most: int = 6) -> DataFrame:
    """frames (candidates, best first: array of track, cls, box, head; crop: left, top, right, bottom; subject: track and cls or null) as a row for each
    of the first `most` candidates: place, whether it is the subject, and its boxes in the output's pixels, cut to whole numbers."""
    crop = F.col("crop")
    sx, sy = width / F.greatest(F.lit(1), crop["right"] - crop["left"]), height / F.greatest(F.lit(1), crop["bottom"] - crop["top"])
    x, y = (lambda v: ((v - crop["left"]) * sx).cast("long")), (lambda v: ((v - crop["top"]) * sy).cast("long"))
    shown = lambda b: F.when(b.isNotNull(), _struct(x1=x(b["x1"]), y1=y(b["y1"]), x2=x(b["x2"]), y2=y(b["y2"])))
    own = lambda c: F.coalesce((c["track"] == F.col("subject.track")) & (c["cls"] == F.col("subject.cls")), F.lit(False))
    rows = F.transform(F.slice("candidates", 1, most), lambda c, i: _struct(place=i + 1, is_subject=own(c), box=shown(c["box"]), head=shown(c["head"])))
    return frames.select(*[k for k in frames.columns if k not in ("candidates", "crop", "subject")], F.inline(rows))


@query(
    "snk_debug",
    DETECTIONS
    + """, cand AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, idx) AS place, frame % 1300 AS lft FROM det), subject AS (SELECT frame, track AS st, cls AS sc FROM cand WHERE place = 2)
SELECT c.frame, place, coalesce(track = st AND cls = sc, false) AS is_subject, CAST(trunc((x1 - lft) * (1080 / 608::DOUBLE)) AS BIGINT) AS x1, CAST(trunc((y2 - 100) * (1920 / 980::DOUBLE)) AS BIGINT) AS y2, CASE WHEN l_partkey % 3 = 0 THEN CAST(trunc((x1 + 5 - lft) * (1080 / 608::DOUBLE)) AS BIGINT) END AS head_x1 FROM cand c LEFT JOIN subject s ON s.frame = c.frame WHERE place <= 6""",
)
def snk_debug(t: Tables) -> DataFrame:
    """The second best of a frame is its subject here."""
    left, box = F.col("frame") % 1300, F.struct("x1", "y1", "x2", "y2")
    head = F.when(F.col("l_partkey") % 3 == 0, _struct(x1=F.col("x1") + 5, y1=F.col("y1") + 5, x2=F.col("x1") + 15, y2=F.col("y1") + 15))
    one = F.struct((-F.col("conf")).alias("o"), "idx", "track", "cls", box.alias("box"), head.alias("head"))
    g = t.detections.groupBy("frame").agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    second = F.get("candidates", F.lit(1))
    g = g.withColumns({"crop": _struct(left=left, top=F.lit(100), right=left + 608, bottom=F.lit(1080)), "subject": _struct(track=second["track"], cls=second["cls"])})
    d = debug_boxes(g, 1080, 1920)
    return d.select("frame", F.col("place").cast("long").alias("place"), "is_subject", F.col("box.x1").alias("x1"), F.col("box.y2").alias("y2"), F.col("head.x1").alias("head_x1"))
