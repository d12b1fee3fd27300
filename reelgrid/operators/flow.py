"""Moves between frames: what the points of a track agree on, whether a frame's proposal stands, and where a track may be next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import finite, let, q6
from ..plans.catalog import Tables, query

Q = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"
CORNERS = ["x1", "y1", "x2", "y2"]


def middle(values: Column) -> Column:
    """The median of an array of numbers: the mean of the two middle ones where their number is even; null if it is empty."""
    return let(F.array_sort(values), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def track_consensus(tracks: DataFrame, max_jump: float = 0.15) -> DataFrame:
    """tracks with `consensus` (code, dx, dy, quality): the move that a track's points agree on, or the first reason why there is none.

    tracks: a row per track of a frame with its box, points (array of ox, oy; mx, my: where they moved; bx, by: where they came back to; ok, back: the
    solver's verdicts; null or under 6: too few), failed (null, 'forward' or 'backward': which pass the solver gave up), frame_w, frame_h,
    gray_w, gray_h (of the thumbnails that points are measured in).  dx, dy are in the frame's pixels; quality is the share of
    points that agree.
    """
    sx, sy = F.col("gray_w") / F.col("frame_w"), F.col("gray_h") / F.col("frame_h")
    margin_x, margin_y = 2 / sx, 2 / sy

    def fails(code: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(None).cast("double").alias("dx"), F.lit(None).cast("double").alias("dy"), F.lit(None).cast("double").alias("quality"))

    every = lambda f: F.forall("points", f)
    n = F.size("points")
    kept = F.filter(
        "points",
        lambda p: p["ok"] & p["back"] & (length(p["bx"] - p["ox"], p["by"] - p["oy"]) <= 1.5) & (p["mx"] >= 0) & (p["mx"] < F.col("gray_w")) & (p["my"] >= 0) & (p["my"] < F.col("gray_h")),
    )
    moves = F.transform(kept, lambda p: F.struct((p["mx"] - p["ox"]).alias("x"), (p["my"] - p["oy"]).alias("y")))

    def reliable(d: Column) -> Column:
        both = lambda a: F.struct(middle(F.transform(a, lambda p: p["x"])).alias("x"), middle(F.transform(a, lambda p: p["y"])).alias("y"))
        rough = F.when((F.size(d) < 6) | (F.size(d) / n < 0.6), fails("flow_unreliable"))
        return rough.otherwise(let(both(d), lambda m: agreed(d, m, both)))

    def agreed(d: Column, m: Column, both: Callable[[Column], Column]) -> Column:
        away = lambda p: length(p["x"] - m["x"], p["y"] - m["y"])
        near = F.filter(d, lambda p: away(p) <= 2)
        apart = (middle(F.transform(d, away)) > 2) | (F.size(near) < 6) | (F.size(near) / n < 0.6)
        return F.when(apart, fails("flow_deformation")).otherwise(let(near, lambda inner: let(both(inner), lambda t: moved(t["x"] / sx, t["y"] / sy, F.size(inner) / n))))

    def moved(dx: Column, dy: Column, quality: Column) -> Column:
        jump = length(dx, dy) > max_jump * F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
        out = (F.col("x1") + dx < margin_x) | (F.col("y1") + dy < margin_y) | (F.col("x2") + dx > F.col("frame_w") - margin_x) | (F.col("y2") + dy > F.col("frame_h") - margin_y)
        told = F.struct(F.lit(None).cast("string").alias("code"), dx.alias("dx"), dy.alias("dy"), quality.alias("quality"))
        return F.when(jump, fails("flow_jump")).when(out, fails("flow_boundary")).otherwise(told)

    code = (
        F.when(F.col("points").isNull() | (n < 6), fails("flow_feature_poor"))
        .when(F.col("failed") == "forward", fails("flow_solver_failure"))
        .when(~every(lambda p: finite(p["mx"]) & finite(p["my"])), fails("flow_invalid_result"))
        .when(F.col("failed") == "backward", fails("flow_solver_failure"))
        .when(~every(lambda p: finite(p["bx"]) & finite(p["by"])), fails("flow_invalid_result"))
        .otherwise(let(moves, reliable))
    )
    return tracks.withColumn("consensus", code)


def crowded(boxes: Column) -> Column:
    """Whether two of an array of boxes share over 0.35 of their union."""

    def over(a: Column, b: Column) -> Column:
        wide, high = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        both = F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)
        return both / ((a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - both) > 0.35

    return F.exists(F.transform(boxes, lambda a, i: F.exists(F.slice(boxes, i + 2, F.greatest(F.size(boxes) - i - 1, F.lit(0))), lambda b: over(a, b))), lambda x: x)


def flow_verdicts(tracks: DataFrame, max_jump: float = 0.15) -> DataFrame:
    """A row per frame (video, frame): reason, null where the moves of all its tracks are accepted, and the moves (track, dx, dy, quality).

    tracks as for track_consensus, with row (their order), track (their identity), frame_ok (both thumbnails are there, alike, large enough and
    finite) and dtype_ok; a frame without tracks has one row whose row is null.  A frame is accepted as a whole or not at all.
    """
    t = track_consensus(tracks, max_jump)
    box = F.struct(*CORNERS)
    one = F.struct("row", "track", box.alias("box"), "consensus")
    g = t.groupBy("video", "frame").agg(
        F.array_sort(F.collect_list(F.when(F.col("row").isNotNull(), one))).alias("t"),
        *[F.bool_and(c).alias(c) for c in ("frame_ok", "dtype_ok")],
        *[F.max(c).alias(c) for c in ("frame_w", "frame_h", "gray_w", "gray_h")],
    )
    mx, my = 2 / (F.col("gray_w") / F.col("frame_w")), 2 / (F.col("gray_h") / F.col("frame_h"))
    broken = F.exists("t", lambda x: ~(finite(x["box"]["x1"]) & finite(x["box"]["y1"]) & finite(x["box"]["x2"]) & finite(x["box"]["y2"])) | (x["box"]["x2"] <= x["box"]["x1"]) | (x["box"]["y2"] <= x["box"]["y1"]))
    edge = F.exists("t", lambda x: (x["box"]["x1"] < mx) | (x["box"]["y1"] < my) | (x["box"]["x2"] > F.col("frame_w") - mx) | (x["box"]["y2"] > F.col("frame_h") - my))
    first = F.get(F.filter(F.transform("t", lambda x: x["consensus"]["code"]), lambda c: c.isNotNull()), F.lit(0))
    here = F.transform("t", lambda x: x["box"])
    there = F.transform(
        "t",
        lambda x: F.struct(
            (x["box"]["x1"] + x["consensus"]["dx"]).alias("x1"), (x["box"]["y1"] + x["consensus"]["dy"]).alias("y1"), (x["box"]["x2"] + x["consensus"]["dx"]).alias("x2"), (x["box"]["y2"] + x["consensus"]["dy"]).alias("y2")
        ),
    )
    names = F.transform("t", lambda x: x["track"])
    reason = (
        F.when(~F.coalesce("frame_ok", F.lit(False)), "invalid_flow_frame")
        .when(~F.coalesce("dtype_ok", F.lit(False)), "invalid_flow_dtype")
        .when((F.size("t") == 0) | F.exists(names, lambda x: x.isNull()), "flow_missing_track")
        .when(F.size(F.array_distinct(names)) < F.size("t"), "flow_duplicate_track")
        .when(broken, "flow_invalid_box")
        .when(edge, "flow_boundary")
        .when(crowded(here), "flow_crowding")
        .when(first.isNotNull(), first)
        .when(crowded(there), "flow_crowding")
    )
    moves = F.transform("t", lambda x: F.struct(x["track"].alias("track"), x["consensus"]["dx"].alias("dx"), x["consensus"]["dy"].alias("dy"), x["consensus"]["quality"].alias("quality")))
    return g.withColumn("reason", reason).select("video", "frame", "reason", F.when(F.col("reason").isNull(), moves).otherwise(F.array().cast("array<struct<track:bigint,dx:double,dy:double,quality:double>>")).alias("moves"))


#: Up to three lines of an order as the tracks of a frame, with up to twelve points each; keys choose what goes wrong.
POINTS = """WITH line AS (SELECT o_custkey AS video, l_orderkey AS frame, l_partkey AS pk, l_suppkey AS sk, l_quantity AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS no FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
boxed AS (SELECT *, CASE WHEN frame % 67 = 0 THEN 1 WHEN sk % 61 <> 0 THEN sk * 10 + no END AS track, 40 + CASE WHEN frame % 13 = 0 THEN 0 ELSE 600 END * no + (pk * 37) % 200 AS x1, 20 + (pk * 53) % 400 AS y1 FROM line WHERE no < 3),
trk AS (SELECT *, CAST(x1 + CASE WHEN pk % 71 = 0 THEN 0 ELSE 150 + qty * 4 END AS DOUBLE) AS x2, CAST(y1 + 200 + qty * 9 AS DOUBLE) AS y2, frame % 53 <> 0 AS frame_ok, frame % 59 <> 0 AS dtype_ok, CASE WHEN pk % 43 = 0 THEN 'forward' WHEN pk % 47 = 0 THEN 'backward' END AS failed FROM boxed),
pts AS (SELECT *, ox + dx AS mx, oy + dy AS my, CASE WHEN pk % 41 = 0 AND k = 5 THEN 'nan'::DOUBLE ELSE ox + CASE WHEN (k * 3 + sk) % 10 = 0 THEN 2 ELSE 0.25 END END AS gx, oy AS gy, CASE WHEN pk % 31 = 0 THEN k % 2 = 1 ELSE (k + pk) % 11 <> 0 END AS ok FROM (SELECT *, CAST(20 + 24 * k AS DOUBLE) AS ox, CAST(15 + 12 * ((k * 5 + pk) % 12) AS DOUBLE) AS oy,
CASE WHEN pk % 37 = 0 AND k = 3 THEN 'nan'::DOUBLE ELSE CAST((pk % 9 - 4) * 0.5 + CASE WHEN pk % 29 = 0 THEN 10 ELSE 0 END + CASE WHEN pk % 23 = 0 THEN 8 * (k % 2) WHEN (k * 7 + pk) % (5 + pk % 9) = 0 THEN 6 ELSE 0 END AS DOUBLE) END AS dx, CAST((sk % 7 - 3) * 0.25 AS DOUBLE) AS dy FROM trk, range(0, 12) AS s(k) WHERE k < CASE WHEN pk % 19 = 0 THEN 4 ELSE 12 END)),
good AS (SELECT *, sqrt((gx - ox) * (gx - ox) + (gy - oy) * (gy - oy)) <= 1.5 AND ok AND mx >= 0 AND mx < 320 AND my >= 0 AND my < 180 AND NOT isnan(mx) AND NOT isnan(gx) AS valid FROM pts),
one AS (SELECT frame, no, count(*) AS n, bool_or(isnan(mx)) AS bad_to, bool_or(isnan(gx)) AS bad_back, count_if(valid) AS nv, median(dx) FILTER (valid) AS ux, median(dy) FILTER (valid) AS uy FROM good GROUP BY frame, no),
res AS (SELECT g.*, o.n, sqrt((dx - ux) * (dx - ux) + (dy - uy) * (dy - uy)) AS away FROM good g JOIN one o USING (frame, no) WHERE valid),
two AS (SELECT frame, no, median(away) AS mid, count_if(away <= 2) AS ni, median(dx) FILTER (away <= 2) / (320 / 1920::DOUBLE) AS tx, median(dy) FILTER (away <= 2) / (180 / 1080::DOUBLE) AS ty FROM res GROUP BY frame, no),
consensus AS (SELECT t.*, tx, ty, ni / n AS quality, CASE WHEN n IS NULL OR n < 6 THEN 'flow_feature_poor' WHEN failed = 'forward' THEN 'flow_solver_failure' WHEN bad_to THEN 'flow_invalid_result' WHEN failed = 'backward' THEN 'flow_solver_failure' WHEN bad_back THEN 'flow_invalid_result' WHEN nv < 6 OR nv / n < 0.6::DOUBLE THEN 'flow_unreliable'
WHEN mid > 2 OR ni < 6 OR ni / n < 0.6::DOUBLE THEN 'flow_deformation' WHEN sqrt(tx * tx + ty * ty) > 0.15::DOUBLE * least(x2 - x1, y2 - y1) THEN 'flow_jump' WHEN x1 + tx < 12 OR y1 + ty < 12 OR x2 + tx > 1908 OR y2 + ty > 1068 THEN 'flow_boundary' END AS code FROM trk t LEFT JOIN one USING (frame, no) LEFT JOIN two USING (frame, no))
"""


def flow_tracks(t: Tables) -> DataFrame:
    """The same as DataFrame."""
    from pyspark.sql import Window

    o = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("video"))
    d = t.read("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    no = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).cast("long")
    d = d.select("video", F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").alias("qty"), no.alias("row")).filter("row < 3")
    pk, sk, frame, row = F.col("pk"), F.col("sk"), F.col("frame"), F.col("row")
    d = d.withColumns({"x1": (40 + F.when(frame % 13 == 0, 0).otherwise(600) * row + (pk * 37) % 200).cast("double"), "y1": (20 + (pk * 53) % 400).cast("double")})
    d = d.withColumns({"x2": F.col("x1") + F.when(pk % 71 == 0, 0).otherwise(150 + F.col("qty") * 4), "y2": F.col("y1") + 200 + F.col("qty") * 9})

    def point(k: Column) -> Column:
        ox, oy = (20 + 24 * k).cast("double"), (15 + 12 * ((k * 5 + pk) % 12)).cast("double")
        off = F.when(pk % 23 == 0, 8 * (k % 2)).when((k * 7 + pk) % (5 + pk % 9) == 0, 6).otherwise(0)
        dx = F.when((pk % 37 == 0) & (k == 3), float("nan")).otherwise((pk % 9 - 4) * 0.5 + F.when(pk % 29 == 0, 10).otherwise(0) + off)
        bx = F.when((pk % 41 == 0) & (k == 5), float("nan")).otherwise(ox + F.when((k * 3 + sk) % 10 == 0, 2.0).otherwise(0.25))
        ok = F.when(pk % 31 == 0, k % 2 == 1).otherwise((k + pk) % 11 != 0)
        return F.struct(ox.alias("ox"), oy.alias("oy"), (ox + dx).alias("mx"), (oy + (sk % 7 - 3) * 0.25).alias("my"), bx.alias("bx"), oy.alias("by"), ok.alias("ok"), F.lit(True).alias("back"))

    points = F.transform(F.sequence(F.lit(0), F.when(pk % 19 == 0, 3).otherwise(11)), point)
    return d.select(
        "video", "frame", "row", F.when(frame % 67 == 0, F.lit(1).cast("long")).when(sk % 61 != 0, sk * 10 + row).alias("track"), *CORNERS, points.alias("points"), F.when(pk % 43 == 0, "forward").when(pk % 47 == 0, "backward").alias("failed"),
        (frame % 53 != 0).alias("frame_ok"), (frame % 59 != 0).alias("dtype_ok"), F.lit(1920).alias("frame_w"), F.lit(1080).alias("frame_h"), F.lit(320).alias("gray_w"), F.lit(180).alias("gray_h"),
    )


@query("agg_flow_consensus", POINTS + f"SELECT frame, no AS row, code, CASE WHEN code IS NULL THEN {Q.format('tx')} END AS dx_q, CASE WHEN code IS NULL THEN {Q.format('ty')} END AS dy_q, CASE WHEN code IS NULL THEN {Q.format('quality')} END AS quality_q FROM consensus")
def agg_flow_consensus(t: Tables) -> DataFrame:
    c = lambda k: F.col(f"consensus.{k}")
    return track_consensus(flow_tracks(t)).select("frame", "row", c("code").alias("code"), *[q6(c(k)).alias(f"{k}_q") for k in ("dx", "dy", "quality")])


def _over(a: str, b: str, shift: bool) -> str:
    x = lambda p, c: f"({p}.{c} + coalesce({p}.t{c[0]}, 0))" if shift else f"{p}.{c}"
    both = f"greatest(0, least({x(a, 'x2')}, {x(b, 'x2')}) - greatest({x(a, 'x1')}, {x(b, 'x1')})) * greatest(0, least({x(a, 'y2')}, {x(b, 'y2')}) - greatest({x(a, 'y1')}, {x(b, 'y1')}))"
    return f"{both} / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {both}) > 0.35::DOUBLE"


@query(
    "trk_flow",
    POINTS
    + f""", near AS (SELECT a.frame, bool_or({_over('a', 'b', False)}) AS now, bool_or({_over('a', 'b', True)}) AS later FROM consensus a JOIN consensus b ON a.frame = b.frame AND a.no < b.no GROUP BY a.frame)
SELECT video, frame, reason, CASE WHEN reason IS NULL THEN n ELSE 0 END AS moves, CASE WHEN reason IS NULL THEN CAST(floor(dx * 1e3 + 0.5) AS BIGINT) END AS sum_dx FROM (SELECT video, frame, n, dx, CASE WHEN NOT frame_ok THEN 'invalid_flow_frame' WHEN NOT dtype_ok THEN 'invalid_flow_dtype' WHEN named < n THEN 'flow_missing_track' WHEN distinct_names < n THEN 'flow_duplicate_track' WHEN bad THEN 'flow_invalid_box' WHEN edge THEN 'flow_boundary' WHEN coalesce(now, false) THEN 'flow_crowding' WHEN code IS NOT NULL THEN code WHEN coalesce(later, false) THEN 'flow_crowding' END AS reason
FROM (SELECT video, frame, count(*) AS n, count(track) AS named, count(DISTINCT track) AS distinct_names, bool_and(frame_ok) AS frame_ok, bool_and(dtype_ok) AS dtype_ok, bool_or(x2 <= x1 OR y2 <= y1) AS bad, bool_or(x1 < 12 OR y1 < 12 OR x2 > 1908 OR y2 > 1068) AS edge, min_by(code, no) FILTER (code IS NOT NULL) AS code, sum(tx) AS dx FROM consensus GROUP BY video, frame) LEFT JOIN near USING (frame))""",
)
def trk_flow(t: Tables) -> DataFrame:
    v = flow_verdicts(flow_tracks(t))
    dx = F.aggregate("moves", F.lit(0.0), lambda a, m: a + m["dx"])
    return v.select("video", "frame", "reason", F.size("moves").cast("long").alias("moves"), F.when(F.col("reason").isNull(), F.floor(dx * 1e3 + 0.5).cast("long")).alias("sum_dx"))


# Where a track may be by the next detection.


def envelope(mean: Column, covariance: Column, box: tuple[Column, Column, Column, Column], horizon: Column, tracked: Column) -> Column:
    """The box (x1, y1, x2, y2) that a track surely stays in for `horizon` frames, by its filter's state (middle x and y, aspect, height and their speeds).

    It spans the middles now and then, with the larger of the box and the predicted size and three standard deviations of both; heights of tracks that
    are not `tracked` stand still.  Null where mean is not of 8 or covariance not of 8 x 8 finite numbers, a variance is negative, or the box or the
    predicted size is empty.
    """
    x1, y1, x2, y2 = box
    fine = lambda a: F.forall(a, lambda v: finite(v))
    shape = (F.size(mean) == 8) & (F.size(covariance) == 8) & F.forall(covariance, lambda r: r.isNotNull() & (F.size(r) == 8))
    sound = F.coalesce(shape & fine(mean) & F.forall(covariance, fine) & finite(x1) & finite(y1) & finite(x2) & finite(y2) & (x2 > x1) & (y2 > y1), F.lit(False))
    variance = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(F.get(covariance, i), i))
    m = lambda i: F.get(mean, F.lit(i))
    speed = [m(4), m(5), m(6), F.when(tracked, m(7)).otherwise(0.0)]
    ends = F.array(*[m(i) + horizon * speed[i] for i in range(4)])

    def spread(v: Column, end: Column) -> Column:
        sigma = lambda i: F.sqrt(F.get(v, F.lit(i)))
        reach = F.array(*[3 * (sigma(i) + horizon * sigma(i + 4)) for i in range(4)])
        return let(reach, lambda s: spanned(s, end))

    def spanned(s: Column, end: Column) -> Column:
        e, r = (lambda i: F.get(end, F.lit(i))), (lambda i: F.get(s, F.lit(i)))
        wider = F.greatest(m(3), e(3)) * r(2) + F.greatest(m(2), e(2)) * r(3) + r(2) * r(3)
        half_w, half_h = 0.5 * F.greatest(x2 - x1, e(2) * e(3)) + r(0) + 0.5 * wider, 0.5 * F.greatest(y2 - y1, e(3)) + r(1) + 0.5 * r(3)
        return let(
            F.struct(half_w.alias("w"), half_h.alias("h")),
            lambda k: F.struct((F.least(m(0), e(0)) - k["w"]).alias("x1"), (F.least(m(1), e(1)) - k["h"]).alias("y1"), (F.greatest(m(0), e(0)) + k["w"]).alias("x2"), (F.greatest(m(1), e(1)) + k["h"]).alias("y2")),
        )

    told = let(F.struct(variance.alias("v"), ends.alias("e")), lambda p: F.when(F.forall(p["v"], lambda x: x >= 0) & (F.get(p["e"], F.lit(2)) > 0) & (F.get(p["e"], F.lit(3)) > 0), spread(p["v"], p["e"])))
    return F.when(sound, told)


#: A filter's state out of an embedding: 64 entries as a matrix, speeds from the first four; keys choose what is no state.
STATES = """WITH st AS (SELECT vec_id, embedding AS e, vec_id % 3 > 0 AS tracked, 1 + vec_id % 6 AS h, 300 + vec_id % 1000 AS cx, 300 + (vec_id * 7) % 500 AS cy, 0.5::DOUBLE + (vec_id % 5) / 8 AS a, 100 + vec_id % 200 AS hh, CAST(embedding[1] AS DOUBLE) * 10 AS vx, CAST(embedding[2] AS DOUBLE) * 10 AS vy, CASE WHEN vec_id % 17 = 0 THEN -1.0::DOUBLE ELSE CAST(embedding[3] AS DOUBLE) / 8 END AS va, CAST(embedding[4] AS DOUBLE) * 32 AS vh FROM embeddings),
va AS (SELECT *, list_transform(range(0, 8), lambda i: CAST(e[9 * i + 1] AS DOUBLE) + 0.25::DOUBLE) AS d, cx + h * vx AS ex, cy + h * vy AS ey, a + h * va AS ea, hh + h * CASE WHEN tracked THEN vh ELSE 0 END AS eh FROM st),
sp AS (SELECT *, 3 * (sqrt(d[1]) + h * sqrt(d[5])) AS s1, 3 * (sqrt(d[2]) + h * sqrt(d[6])) AS s2, 3 * (sqrt(d[3]) + h * sqrt(d[7])) AS s3, 3 * (sqrt(d[4]) + h * sqrt(d[8])) AS s4 FROM va WHERE list_min(d) >= 0 AND vec_id % 23 <> 0 AND vec_id % 29 <> 0 AND ea > 0 AND eh > 0),
env AS (SELECT *, 0.5::DOUBLE * greatest(40 + vec_id % 90, ea * eh) + s1 + 0.5::DOUBLE * (greatest(hh, eh) * s3 + greatest(a, ea) * s4 + s3 * s4) AS hw, 0.5::DOUBLE * greatest(90 + vec_id % 160, eh) + s2 + 0.5::DOUBLE * s4 AS hv FROM sp)
"""


@query("prj_envelope", STATES + f"SELECT vec_id, {Q.format('least(cx, ex) - hw')} AS x1, {Q.format('least(cy, ey) - hv')} AS y1, {Q.format('greatest(cx, ex) + hw')} AS x2, {Q.format('greatest(cy, ey) + hv')} AS y2 FROM embeddings LEFT JOIN env USING (vec_id)")
def prj_envelope(t: Tables) -> DataFrame:
    n, e = F.col("vec_id"), lambda i: F.get("embedding", F.lit(i)).cast("double")
    state = [300 + n % 1000, 300 + (n * 7) % 500, 0.5 + (n % 5) / 8, 100 + n % 200, e(0) * 10, e(1) * 10, F.when(n % 17 == 0, -1.0).otherwise(e(2) / 8), e(3) * 32]
    mean = F.array(*[s.cast("double") for s in state])
    mean = F.when(n % 23 == 0, F.slice(mean, 1, 7)).otherwise(mean)
    cell = lambda r, c: F.get("embedding", 8 * r + c).cast("double") + F.when(r == c, 0.25).otherwise(F.when((n % 29 == 0) & (r == 3), float("nan")).otherwise(0.0))
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: cell(r, c)))
    d = t.read("embeddings").select("vec_id", mean.alias("mean"), matrix.alias("covariance"), (40 + n % 90).cast("double").alias("w"), (90 + n % 160).cast("double").alias("h"))
    box = F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")
    d = d.select("vec_id", envelope(F.col("mean"), F.col("covariance"), box, 1 + n % 6, n % 3 > 0).alias("b"))
    return d.select("vec_id", *[q6(F.col(f"b.{c}")).alias(c) for c in CORNERS])
