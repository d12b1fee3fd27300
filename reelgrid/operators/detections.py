"""Filters, projections, joins and ranking over what is seen in a frame.

Every join of detections with each other is on the frame first, so its output is
bounded by what one frame holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, base_crop, clamp, crop_size, iou, q6, spring
from ..plans.catalog import DETECTIONS, FRAMES, Tables, query
from .overlaps import owner

W, H = 1920.0, 1080.0

# The detector's classes by their ids, and the bias of each in the score.
CLASSES = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck", 15: "cat", 16: "dog"}
BIAS = {"person": 0.22, "dog": 0.12, "cat": 0.10, "car": 0.06, "bicycle": 0.02, "motorcycle": 0.02, "bus": 0.01, "truck": 0.01}

AREA_SQL = "(greatest(0, x2 - x1) * greatest(0, y2 - y1))"
BIAS_SQL = "CASE cls " + " ".join(f"WHEN {k} THEN {BIAS[c]}" for k, c in CLASSES.items()) + " ELSE 0 END"
NAME_SQL = "CASE cls " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in CLASSES.items())


@query("flt_parse_tracks", DETECTIONS + "SELECT frame, idx, cls FROM det WHERE cls IN (0, 1, 2, 3) AND x2 > x1 AND y2 > y1")
def flt_parse_tracks(t: Tables) -> DataFrame:
    ok = F.col("cls").isin(0, 1, 2, 3) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & ~F.isnan("conf")
    return t.detections.filter(ok).select("frame", "idx", "cls")


@query("flt_class_dim", DETECTIONS + f"SELECT {NAME_SQL} END AS name, count(*) AS n FROM det WHERE cls IN ({', '.join(map(str, CLASSES))}) GROUP BY name")
def flt_class_dim(t: Tables) -> DataFrame:
    """Detections of the classes that have a name; other ids are left out."""
    dim = F.broadcast(t.spark.createDataFrame(list(CLASSES.items()), "cls long, name string"))
    return t.detections.join(dim, "cls").groupBy("name").agg(F.count("*").alias("n"))


@query("prj_class_name", DETECTIONS + f"SELECT {NAME_SQL} ELSE CAST(cls AS VARCHAR) END AS name, count(*) AS n FROM det GROUP BY name")
def prj_class_name(t: Tables) -> DataFrame:
    dim = F.broadcast(t.spark.createDataFrame(list(CLASSES.items()), "cls long, name string"))
    return t.detections.join(dim, "cls", "left").groupBy(F.coalesce("name", F.col("cls").cast("string")).alias("name")).agg(F.count("*").alias("n"))


def reliable_at(ts: Column, measured: Column, confidence: Column, oldest: float = 0.1) -> Column:
    """A predicted box counts while its measurement is recent and the prediction is trusted."""
    age = ts - measured
    return measured.isNotNull() & (age >= 0) & (age <= oldest + 1e-9) & (confidence >= 0.7) & (confidence <= 1)


@query("flt_reliable", FRAMES + ", aged AS (SELECT video, frame, ts_s, last_value(CASE WHEN detected THEN ts_s END IGNORE NULLS) OVER (PARTITION BY video, scene ORDER BY frame) AS m, 0.6 + (frame % 5) / 10.0 AS pc FROM frames) SELECT video, frame, coalesce(ts_s - m >= 0 AND ts_s - m <= 0.1 + 1e-9 AND pc >= 0.7 AND pc <= 1, false) AS ok FROM aged")
def flt_reliable(t: Tables) -> DataFrame:
    last = F.last(F.when(F.col("detected"), F.col("ts_s")), ignorenulls=True).over(Window.partitionBy("video", "scene").orderBy("frame"))
    confidence = F.lit(0.6) + (F.col("frame") % 5) / 10.0
    aged = t.frames.select("video", "frame", "ts_s", last.alias("m"), confidence.alias("pc"))
    return aged.select("video", "frame", F.coalesce(reliable_at(F.col("ts_s"), F.col("m"), F.col("pc")), F.lit(False)).alias("ok"))


@query("prj_base_crop", DETECTIONS + "SELECT idx, frame, CAST(least(w, CASE WHEN w / h >= 9 / 16.0 THEN round_even(h * (9 / 16.0), 0) ELSE w END) AS BIGINT) AS bw, CAST(least(h, CASE WHEN w / h >= 9 / 16.0 THEN h ELSE round_even(w / (9 / 16.0), 0) END) AS BIGINT) AS bh FROM (SELECT idx, frame, x2 - x1 AS w, y2 - y1 AS h FROM det)")
def prj_base_crop(t: Tables) -> DataFrame:
    d = t.detections.select("idx", "frame", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    bw, bh = base_crop(F.col("w"), F.col("h"), 9, 16)
    return d.select("idx", "frame", bw.cast("long").alias("bw"), bh.cast("long").alias("bh"))


@query("prj_crop_size", DETECTIONS + "SELECT idx, frame, CAST(greatest(64, least(round_even(608 / greatest(0.1, z), 0), 1920)) AS BIGINT) AS cw, CAST(greatest(64, least(round_even(1080 / greatest(0.1, z), 0), 1080)) AS BIGINT) AS ch FROM (SELECT *, 0.05 + qty / 10.0 AS z FROM det)")
def prj_crop_size(t: Tables) -> DataFrame:
    z = F.lit(0.05) + F.col("qty") / 10.0
    cw, ch = crop_size(F.lit(608.0), F.lit(1080.0), z, F.lit(1920).cast("long"), F.lit(1080).cast("long"))
    return t.detections.select("idx", "frame", cw.alias("cw"), ch.alias("ch"))


@query("prj_region", DETECTIONS + "SELECT frame, idx, CAST(CASE frame % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN (w - w // 2) // 2 ELSE w - w // 2 END AS BIGINT) AS left_x, CAST(CASE WHEN frame % 4 = 0 THEN w ELSE w // 2 END AS BIGINT) AS width FROM (SELECT frame, idx, CAST(x2 AS BIGINT) AS w FROM det)")
def prj_region(t: Tables) -> DataFrame:
    """Half of the frame that is looked at: none, left, middle or right; odd widths round down."""
    w, mode = F.col("w"), F.col("frame") % 4
    half = F.floor(w / 2)
    left = F.when(mode <= 1, 0).when(mode == 2, F.floor((w - half) / 2)).otherwise(w - half)
    return t.detections.select("frame", "idx", F.col("x2").cast("long").alias("w")).select("frame", "idx", left.cast("long").alias("left_x"), F.when(mode == 0, w).otherwise(half).cast("long").alias("width"))


@query("prj_to_source", DETECTIONS + "SELECT frame, idx, x1 + 480 AS sx1, x2 + 480 AS sx2, x2 - x1 AS span FROM det")
def prj_to_source(t: Tables) -> DataFrame:
    return t.detections.select("frame", "idx", (F.col("x1") + 480).alias("sx1"), (F.col("x2") + 480).alias("sx2"), (F.col("x2") - F.col("x1")).alias("span"))


@query("prj_thumb_dims", DETECTIONS + "SELECT frame, idx, CAST(greatest(1, round_even(w * s, 0)) AS BIGINT) AS tw, CAST(greatest(1, round_even(h * s, 0)) AS BIGINT) AS th FROM (SELECT *, least(1, 128 / greatest(w, h)) AS s FROM (SELECT frame, idx, x2 - x1 AS w, y2 - y1 AS h FROM det))")
def prj_thumb_dims(t: Tables) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    s = F.least(F.lit(1.0), F.lit(128.0) / F.greatest(w, h))
    return t.detections.select("frame", "idx", *[F.greatest(F.lit(1), F.bround(v * s).cast("long")).cast("long").alias(n) for v, n in ((w, "tw"), (h, "th"))])


@query("prj_roi_pad", DETECTIONS + "SELECT frame, idx, CAST(greatest(0, floor(x1 - 0.12 * (x2 - x1))) AS BIGINT) AS l, CAST(greatest(0, floor(y1 - 0.12 * (y2 - y1))) AS BIGINT) AS t, CAST(least(1920, ceil(x2 + 0.12 * (x2 - x1))) AS BIGINT) AS r, CAST(least(1080, ceil(y2 + 0.12 * (y2 - y1))) AS BIGINT) AS b FROM det")
def prj_roi_pad(t: Tables) -> DataFrame:
    px, py = 0.12 * (F.col("x2") - F.col("x1")), 0.12 * (F.col("y2") - F.col("y1"))
    d = t.detections.select(
        "frame", "idx", F.greatest(F.lit(0), F.floor(F.col("x1") - px)).cast("long").alias("l"), F.greatest(F.lit(0), F.floor(F.col("y1") - py)).cast("long").alias("t"),
        F.least(F.lit(1920), F.ceil(F.col("x2") + px)).cast("long").alias("r"), F.least(F.lit(1080), F.ceil(F.col("y2") + py)).cast("long").alias("b"),
    )
    return d.filter("r > l AND b > t")


def score(conf: Column, mask_area: Column, centre: Column, cls: Column, cues: dict[str, Column] | None = None) -> Column:
    """The linear score of a candidate; centre: 1 in the middle of the frame, 0 in a corner.

    cues (what is missing counts nothing): head, pose, tracked, locked, speaking: booleans; saliency: a confidence.
    """
    share = clamp(mask_area / (W * H), 0.0, 1.0)
    bias = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, c in CLASSES.items() for x in (k, BIAS[c])]), cls.cast("int")), F.lit(0.0))
    total = bias + 1.35 * clamp(conf, 0.0, 1.0) + 0.95 * F.sqrt(share) + 0.55 * centre
    flag = lambda name, weight: F.when((cues or {}).get(name, F.lit(False)), weight).otherwise(0.0)
    saliency = F.coalesce((cues or {}).get("saliency", F.lit(0.0)), F.lit(0.0))
    total = total + flag("head", 0.24) + flag("pose", 0.34) + F.when(saliency > 0, 0.72).otherwise(0.0) + 0.78 * clamp(saliency, 0.0, 1.0)
    return total + flag("tracked", 1.05) + flag("locked", 1.30) + flag("speaking", 0.22) + 0.26 * F.log(1 + 250 * share)


def scored(d: DataFrame) -> DataFrame:
    """Detections with their score; keys choose what cues they have."""
    away = F.sqrt(F.pow((F.col("x1") + F.col("x2")) / 2 - W / 2, 2) + F.pow((F.col("y1") + F.col("y2")) / 2 - H / 2, 2))
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    cues = {"head": pk % 3 == 0, "pose": pk % 4 == 0, "saliency": (sk % 9) / 8, "tracked": F.col("idx") == 1, "locked": pk % 11 == 0, "speaking": sk % 6 == 0}
    return d.withColumn("score", score(F.col("conf"), area(""), 1 - clamp(away / ((W * W + H * H) ** 0.5), 0.0, 1.0), F.col("cls"), cues))


SCORED = DETECTIONS + f""", shares AS (SELECT *, greatest(0, least(1, {AREA_SQL} / 2073600.0)) AS na, 1 - greatest(0, least(1, sqrt(pow((x1 + x2) / 2 - 960, 2) + pow((y1 + y2) / 2 - 540, 2)) / sqrt(4852800.0))) AS ca FROM det),
scored AS (SELECT *, {BIAS_SQL} + 1.35 * greatest(0, least(1, conf)) + 0.95 * sqrt(na) + 0.55 * ca + CASE WHEN l_partkey % 3 = 0 THEN 0.24 ELSE 0 END + CASE WHEN l_partkey % 4 = 0 THEN 0.34 ELSE 0 END + CASE WHEN l_suppkey % 9 > 0 THEN 0.72 ELSE 0 END + 0.78 * least(1, (l_suppkey % 9) / 8) + CASE WHEN idx = 1 THEN 1.05 ELSE 0 END + CASE WHEN l_partkey % 11 = 0 THEN 1.3 ELSE 0 END + CASE WHEN l_suppkey % 6 = 0 THEN 0.22 ELSE 0 END + 0.26 * ln(1 + 250 * na) AS score FROM shares)
"""


@query("rnk_score", SCORED + "SELECT frame, idx, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score_q FROM scored")
def rnk_score(t: Tables) -> DataFrame:
    return scored(t.detections).select("frame", "idx", q6(F.col("score")).alias("score_q"))


RANKED = SCORED + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY floor(score * 1e9 + 0.5) DESC, idx) AS rk FROM scored)\n"


def ranked(d: DataFrame) -> DataFrame:
    """Rank within the frame; equal scores keep the order of rows."""
    return scored(d).withColumn("score_r", F.floor(F.col("score") * 1e9 + 0.5)).withColumn("rk", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("score_r"), "idx")))


@query("rnk_stable_sort", RANKED + "SELECT frame, idx, rk FROM ranked")
def rnk_stable_sort(t: Tables) -> DataFrame:
    return ranked(t.detections).select("frame", "idx", "rk")


@query("rnk_candidates", RANKED + "SELECT frame, idx, rk, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score_q FROM ranked WHERE rk <= 3")
def rnk_candidates(t: Tables) -> DataFrame:
    return ranked(t.detections).filter("rk <= 3").select("frame", "idx", "rk", q6(F.col("score")).alias("score_q"))


@query("rnk_confidence", SCORED + "SELECT frame, idx, CAST(floor((0.5 * (1 - exp(-greatest(0, score) / 4)) + 0.5 * e / sum(e) OVER (PARTITION BY frame)) * 1e6 + 0.5) AS BIGINT) AS conf_q FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY frame)) AS e FROM scored)")
def rnk_confidence(t: Tables) -> DataFrame:
    per = Window.partitionBy("frame")
    s = scored(t.detections).withColumn("e", F.exp(F.col("score") - F.max("score").over(per)))
    return s.select("frame", "idx", q6(0.5 * (1 - F.exp(-F.greatest(F.lit(0.0), F.col("score")) / 4)) + 0.5 * F.col("e") / F.sum("e").over(per)).alias("conf_q"))


@query("rnk_topk_cues", DETECTIONS + f"SELECT frame, idx FROM (SELECT frame, idx, row_number() OVER (PARTITION BY frame ORDER BY floor(conf * {AREA_SQL} * 1e3 + 0.5) DESC, idx DESC) AS k FROM det) WHERE k <= 2")
def rnk_topk_cues(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("weight"), F.desc("idx")))
    d = t.detections.withColumn("weight", F.floor(F.col("conf") * area("") * 1e3 + 0.5))
    return d.withColumn("k", k).filter("k <= 2").select("frame", "idx")


@query("rnk_top2_persons", RANKED + "SELECT frame, idx FROM (SELECT frame, idx, row_number() OVER (PARTITION BY frame ORDER BY rk) AS k FROM ranked WHERE cls = 0) WHERE k <= 2")
def rnk_top2_persons(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("frame").orderBy("rk"))
    return ranked(t.detections).filter("cls = 0").withColumn("k", k).filter("k <= 2").select("frame", "idx")


@query("rnk_debug6", RANKED + "SELECT frame, idx FROM ranked WHERE rk <= 6")
def rnk_debug6(t: Tables) -> DataFrame:
    return ranked(t.detections).filter("rk <= 6").select("frame", "idx")


@query("rnk_best1", RANKED + "SELECT frame, idx FROM (SELECT frame, idx, rk, score - lead(score) OVER (PARTITION BY frame ORDER BY rk) AS margin FROM ranked) WHERE rk = 1 AND (margin IS NULL OR margin >= 0.1)")
def rnk_best1(t: Tables) -> DataFrame:
    margin = F.col("score") - F.lead("score").over(Window.partitionBy("frame").orderBy("rk"))
    return ranked(t.detections).withColumn("margin", margin).filter("rk = 1 AND (margin IS NULL OR margin >= 0.1)").select("frame", "idx")


@query("rnk_prominence", DETECTIONS + f"SELECT a.frame, count(*) AS blocked FROM (SELECT frame, idx, conf * {AREA_SQL} AS v FROM det) a JOIN (SELECT frame, conf * {AREA_SQL} AS v FROM det WHERE idx = 0) p ON a.frame = p.frame WHERE a.idx <> 0 AND floor(a.v * 1.5 * 1e3 + 0.5) >= floor(p.v * 1e3 + 0.5) GROUP BY a.frame")
def rnk_prominence(t: Tables) -> DataFrame:
    d = t.detections.select("frame", "idx", (F.col("conf") * area("")).alias("v"))
    first = F.max(F.when(F.col("idx") == 0, F.col("v"))).over(Window.partitionBy("frame"))
    near = d.withColumn("p", first).filter((F.col("idx") != 0) & (F.floor(F.col("v") * 1500 + 0.5) >= F.floor(F.col("p") * 1e3 + 0.5)))
    return near.groupBy("frame").agg(F.count("*").alias("blocked"))


PAIRS = DETECTIONS + """, pairs AS (SELECT a.frame, a.idx AS i, b.idx AS j, a.track AS ti, b.track AS tj, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS both_areas FROM det a JOIN det b ON a.frame = b.frame AND a.idx < b.idx),
ious AS (SELECT *, inter / greatest(1, both_areas - inter) AS iou FROM pairs)
"""


def pairs(d: DataFrame) -> DataFrame:
    """Pairs of boxes of one frame with their overlap; equality on the frame keeps this within frames."""
    cols = ("idx", "track", "x1", "y1", "x2", "y2")
    a, b = (d.select("frame", *[F.col(c).alias(f"{p}{c}") for c in cols]) for p in ("a_", "b_"))
    return a.join(b, "frame").filter("a_idx < b_idx").withColumn("iou", iou("a_", "b_"))


@query("jn_crowded", PAIRS + "SELECT frame, bool_or(iou > 0.35) AS crowded FROM ious GROUP BY frame")
def jn_crowded(t: Tables) -> DataFrame:
    return pairs(t.detections).groupBy("frame").agg(F.bool_or(F.col("iou") > 0.35).alias("crowded"))


@query("jn_overlap_primary", PAIRS + "SELECT frame, bool_or(iou > 0.15) AS over FROM ious WHERE i = 0 GROUP BY frame")
def jn_overlap_primary(t: Tables) -> DataFrame:
    return pairs(t.detections).filter("a_idx = 0").groupBy("frame").agg(F.bool_or(F.col("iou") > 0.15).alias("over"))


@query("jn_overlap_people", PAIRS + "SELECT frame, i, j, CAST(floor(iou * 1e6 + 0.5) AS BIGINT) AS iou_q FROM ious WHERE iou > 0.35")
def jn_overlap_people(t: Tables) -> DataFrame:
    return pairs(t.detections).filter("iou > 0.35").select("frame", F.col("a_idx").alias("i"), F.col("b_idx").alias("j"), q6(F.col("iou")).alias("iou_q"))


@query("jn_iou_owner", PAIRS + ", both_ways AS (SELECT frame, i AS me, j AS other, iou FROM ious UNION ALL SELECT frame, j, i, iou FROM ious), best AS (SELECT *, row_number() OVER (PARTITION BY frame, me ORDER BY iou DESC, other DESC) AS k, lead(iou) OVER (PARTITION BY frame, me ORDER BY iou DESC, other DESC) AS second FROM both_ways) SELECT frame, me, other AS owner FROM best WHERE k = 1 AND iou >= 0.3 AND (second IS NULL OR iou - second >= 0.1)")
def jn_iou_owner(t: Tables) -> DataFrame:
    """Which other box of the frame each box belongs to: the best overlap, unless a second is nearly as good."""
    box = F.struct("x1", "y1", "x2", "y2").alias("box")
    g = t.detections.groupBy("frame").agg(F.collect_list(F.struct("idx", box)).alias("boxes"))
    owned = F.transform("boxes", lambda me: F.struct(me["idx"].alias("me"), owner(me["box"], F.filter("boxes", lambda o: o["idx"] != me["idx"])).alias("owner")))
    return g.select("frame", F.inline(owned)).filter("owner IS NOT NULL")


@query("jn_expanded_competitor", DETECTIONS + f"SELECT DISTINCT p.frame FROM (SELECT *, conf * {AREA_SQL} AS v FROM det) p JOIN (SELECT *, conf * {AREA_SQL} AS v FROM det) o ON p.frame = o.frame AND o.idx <> p.idx WHERE p.idx = 0 AND ((o.x1 < p.x2 + 0.15 * (p.x2 - p.x1) AND o.x2 > p.x1 - 0.15 * (p.x2 - p.x1) AND o.y1 < p.y2 + 0.15 * (p.y2 - p.y1) AND o.y2 > p.y1 - 0.15 * (p.y2 - p.y1)) OR floor(o.v * 1500 + 0.5) >= floor(p.v * 1e3 + 0.5))")
def jn_expanded_competitor(t: Tables) -> DataFrame:
    """Frames where another box overlaps the first one grown by 15 %, or is two thirds as prominent."""
    d = t.detections.select("frame", "idx", "x1", "y1", "x2", "y2", (F.col("conf") * area("")).alias("v"))
    p = d.filter("idx = 0").select("frame", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2", "v")])
    gx, gy = 0.15 * (F.col("p_x2") - F.col("p_x1")), 0.15 * (F.col("p_y2") - F.col("p_y1"))
    touch = (F.col("x1") < F.col("p_x2") + gx) & (F.col("x2") > F.col("p_x1") - gx) & (F.col("y1") < F.col("p_y2") + gy) & (F.col("y2") > F.col("p_y1") - gy)
    weighs = F.floor(F.col("v") * 1500 + 0.5) >= F.floor(F.col("p_v") * 1e3 + 0.5)
    return d.filter("idx <> 0").join(p, "frame").filter(touch | weighs).select("frame").distinct()


@query("jn_pose_track", DETECTIONS + "SELECT d.frame, d.idx, p.cue FROM det d LEFT JOIN (SELECT frame, idx, qty AS cue FROM det WHERE qty >= 25) p ON d.frame = p.frame AND d.idx = p.idx")
def jn_pose_track(t: Tables) -> DataFrame:
    pose = t.detections.filter("qty >= 25").select("frame", "idx", F.col("qty").alias("cue"))
    return t.detections.select("frame", "idx").join(pose, ["frame", "idx"], "left")


@query("flt_reliable_pose_semi", DETECTIONS + "SELECT frame, idx FROM det p WHERE qty >= 25 AND EXISTS (SELECT 1 FROM det d WHERE d.frame = p.frame AND d.idx = p.idx AND d.conf >= 0.7)")
def flt_reliable_pose_semi(t: Tables) -> DataFrame:
    tracks = t.detections.filter("conf >= 0.7").select("frame", "idx")
    return t.detections.filter("qty >= 25").select("frame", "idx").join(tracks, ["frame", "idx"], "left_semi")


ORDERED = DETECTIONS + ", fo AS (SELECT DISTINCT video, frame, o_orderdate FROM det), fn AS (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY o_orderdate, frame) AS no FROM fo), seen AS (SELECT DISTINCT d.video, n.no, d.track FROM det d JOIN fn n ON d.video = n.video AND d.frame = n.frame)\n"


def seen(d: DataFrame) -> DataFrame:
    """Tracks by the number of their frame within the video."""
    rank = F.dense_rank().over(Window.partitionBy("video").orderBy("o_orderdate", "frame"))
    return d.select("video", "frame", "o_orderdate", "track").withColumn("no", rank.cast("long")).select("video", "no", "track").distinct()


@query("jn_new_ids", ORDERED + "SELECT a.video, a.no, a.track FROM seen a WHERE a.no > 1 AND NOT EXISTS (SELECT 1 FROM seen b WHERE b.video = a.video AND b.no = a.no - 1 AND b.track = a.track)")
def jn_new_ids(t: Tables) -> DataFrame:
    now = seen(t.detections)
    before = now.select("video", (F.col("no") + 1).alias("no"), "track")
    return now.filter("no > 1").join(before, ["video", "no", "track"], "left_anti")


@query("jn_prev_track", ORDERED + "SELECT video, no, track, no - lag(no) OVER (PARTITION BY video, track ORDER BY no) AS gap FROM seen")
def jn_prev_track(t: Tables) -> DataFrame:
    return seen(t.detections).withColumn("gap", F.col("no") - F.lag("no").over(Window.partitionBy("video", "track").orderBy("no")))


@query("jn_prev_frame_set", ORDERED + "SELECT a.video, a.no FROM (SELECT video, no, list_sort(list(track)) AS s FROM seen GROUP BY video, no) a JOIN (SELECT video, no, list_sort(list(track)) AS s FROM seen GROUP BY video, no) b ON a.video = b.video AND a.no = b.no + 1 WHERE a.s = b.s")
def jn_prev_frame_set(t: Tables) -> DataFrame:
    sets = seen(t.detections).groupBy("video", "no").agg(F.sort_array(F.collect_list("track")).alias("s"))
    before = F.lag("s").over(Window.partitionBy("video").orderBy("no"))
    return sets.withColumn("before", before).filter("s = before").select("video", "no")


SPEAKER = "SELECT count(*) AS n, count_if(EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 100 = l.l_suppkey AND o.o_custkey % 5 = l.l_partkey % 5 AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL 30 DAY)) AS hits FROM lineitem l"


@query("jn_speaker", SPEAKER)
def jn_speaker(t: Tables) -> DataFrame:
    """How many probes fall in a half-open interval of their track and scene; spans of 30 days are the buckets of the range join, so an interval lies in two."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    o = t.read("orders").select((F.col("o_orderkey") % 100).alias("k"), (F.col("o_custkey") % 5).alias("s"), F.col("o_orderdate").alias("t0"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("step"))
    o = o.select("k", "s", (F.floor(day(F.col("t0")) / 30) + F.col("step")).alias("bucket"), "t0")
    probe = t.read("lineitem").select(F.monotonically_increasing_id().alias("id"), F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 5).alias("s"), F.floor(day(F.col("l_shipdate")) / 30).alias("bucket"), F.col("l_shipdate").alias("at"))
    inside = (F.col("p.k") == F.col("o.k")) & (F.col("p.s") == F.col("o.s")) & (F.col("p.bucket") == F.col("o.bucket")) & (F.col("at") >= F.col("t0")) & (F.col("at") < F.col("t0") + F.expr("INTERVAL 30 DAYS"))
    hits = probe.alias("p").join(o.alias("o"), inside, "left_semi").agg(F.count("*").alias("hits"))
    return probe.agg(F.count("*").alias("n")).join(hits)


@query("dec_spring", FRAMES + ", st AS (SELECT video, frame, value - 50.0 AS off, 10 + 2 / 0.35 * (value - 50.0) AS k, exp(-2 / 0.35 / 30) AS d, value, 50.0 AS tgt FROM frames), s2 AS (SELECT *, value + greatest(-400 / 30.0, least(tgt + (off + k / 30) * d - value, 400 / 30.0)) AS val FROM st) SELECT video, frame, CAST(floor(CASE WHEN (tgt - value) * (tgt - val) <= 0 THEN tgt ELSE val END * 1e6 + 0.5) AS BIGINT) AS at_q FROM s2")
def dec_spring(t: Tables) -> DataFrame:
    at, _ = spring(F.col("value"), F.lit(50.0), F.lit(10.0), 1 / 30, 0.35, 400.0)
    return t.frames.select("video", "frame", q6(at).alias("at_q"))
