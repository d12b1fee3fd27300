"""Grids, flow and poses on small tables made by hand."""

import math

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import flow, grids, poses


def parts(spark, *masks):
    rows = [(k, [bool(c == "#") for c in "".join(m)] if m is not None else None, len(m[0]) if m else 1) for k, m in enumerate(masks)]
    df = grids.part_labels(spark.createDataFrame(rows, "k int, mask array<boolean>, width int"), "mask", "width")
    return {r["k"]: (r["labels"], r["areas"]) for r in df.withColumn("areas", grids.part_areas(F.col("labels"))).collect()}


def test_parts_touch_by_corners(spark):
    got = parts(spark, ["#..#", ".##.", "#..#"], ["#.#", "...", "#.#"], ["...", "..."], ["###", "###"], None, [""], ["##..", "....", "..##"])
    assert got[0] == ([1, 0, 0, 1, 0, 1, 1, 0, 1, 0, 0, 1], [6])
    assert got[1] == ([1, 0, 2, 0, 0, 0, 3, 0, 4], [1, 1, 1, 1])
    assert got[2] == ([0] * 6, []) and got[3] == ([1] * 6, [6]) and got[4] == (None, None) and got[5] == ([], [])
    assert got[6] == ([1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 2, 2], [2, 2])  # a row's end does not touch the next row's start


def test_parts_of_a_long_snake(spark):
    """A part that winds through the whole grid is one, however long the way is."""
    side = 41
    lines = ["#" * side if r % 2 == 0 else ("#" if r % 4 == 3 else "." * (side - 1) + "#").ljust(side, ".") for r in range(side)]
    assert parts(spark, lines)[0][1] == ["".join(lines).count("#")]


def scored(spark, grid, boxes, reason="reliable_pose", subjects=()):
    row = [(grid, 10, [tuple(map(float, b[:4])) + (b[4],) for b in boxes], 100, 100, reason, list(subjects))]
    d = grids.focus_scores(spark.createDataFrame(row, "grid array<double>, width int, boxes array<struct<x1:double,y1:double,x2:double,y2:double,row:long>>, frame_w int, frame_h int, reason string, subjects array<long>"))
    r = d.withColumn("enough", grids.cheap_evidence(d)).first()
    return r["scores"], r["enough"]


def test_cheap_evidence(spark):
    """One compact bright spot decides for the box that holds it; a flat map, two spots or two equal boxes decide nothing."""
    spot = [1.0 if r in (2, 3) and c in (2, 3) else 0.0 for r in range(10) for c in range(10)]
    own, far = (20, 20, 40, 40, 0), (60, 60, 90, 90, 1)
    assert scored(spark, spot, [own, far])[0] == [(1.0, 0), (0.0, 1)]
    assert scored(spark, spot, [own, far], subjects=[0])[1] and not scored(spark, spot, [own, far], subjects=[1])[1]
    assert scored(spark, spot, [own, far], "ambiguous_subjects")[1] and not scored(spark, spot, [own, (10, 10, 50, 50, 1)], "ambiguous_subjects")[1]
    assert not scored(spark, spot, [own], "overlapping_people")[1] and scored(spark, spot, [])[1] and not scored(spark, spot, [far])[1]
    two = [1.0 if (r, c) in {(1, 1), (1, 2), (8, 8), (8, 7)} else 0.0 for r in range(10) for c in range(10)]
    assert not scored(spark, two, [])[1] and not scored(spark, [0.5] * 100, [])[1] and scored(spark, [0.5] * 100, [own]) == (None, False)
    assert not scored(spark, [0.05 * v for v in spot], [])[1]


def region(spark, grid, width, bounds, placed=None):
    d = spark.createDataFrame([(grid, width, 80, 40)], "grid array<double>, width int, frame_w int, frame_h int")
    found = grids.saliency_region(d, tuple(map(F.lit, bounds)), tuple(map(F.lit, placed)) if placed else None).first()["region"]
    return tuple(found) if found else None


def test_saliency_region(spark):
    grid = [0.0] * 32
    grid[10], grid[11], grid[18] = 1.0, 1.0, 0.5  # rows of 8: (1, 2), (1, 3), and a fainter (2, 2)
    assert region(spark, grid, 8, (0, 0, 80, 40)) == pytest.approx((25.0, 10.0, 20.0, 10.0, 40.0, 20.0, 2 / 32))
    assert region(spark, grid, 8, (50, 0, 80, 40)) is None and region(spark, [0.0] * 32, 8, (0, 0, 80, 40)) is None and region(spark, None, 8, (0, 0, 80, 40)) is None
    assert region(spark, grid, 8, (0, 0, 80, 40), (40, 20, 80, 40))[2:6] == pytest.approx((50.0, 25.0, 60.0, 30.0))  # the map covers a quarter
    assert region(spark, grid, 8, (0, 0, 40, 20), (40, 20, 80, 40)) is None


@pytest.mark.parametrize("w, h", [(8, 6), (16, 12), (11, 7), (3, 2), (40, 5)])
def test_area_tiles(spark, w, h):
    """Each tile is the mean over its area, whatever the grid's size."""
    grid = [(7 * k * k + 3 * k) % 256 for k in range(w * h)]
    got = spark.createDataFrame([([float(v) for v in grid],)], "g array<double>").select(grids.area_tiles(F.col("g"), F.lit(w), F.lit(h), 8, 6)).first()[0]
    for j in range(6):
        for i in range(8):
            want = sum(grid[r * w + c] * max(0, min(c + 1, w * (i + 1) / 8) - max(c, w * i / 8)) * max(0, min(r + 1, h * (j + 1) / 6) - max(r, h * j / 6)) for r in range(h) for c in range(w)) * 48 / (w * h)
            assert got[j * 8 + i] == pytest.approx(want)


def test_cuts_equal_dense_histograms(spark):
    """Sparse histograms that meet by bin give the distance of dense ones; far histograms cut, but not within the least frames."""
    frames = [[(10, 20, 30)] * 6 + [(200, 20, 30)] * 2, [(10, 20, 30)] * 5 + [(200, 20, 30)] * 3, [(250, 250, 250)] * 8, [(0, 0, 0)] * 8, [(0, 0, 0)] * 8, [(120, 120, 120)] * 8]
    stats = grids.cut_stats(spark.createDataFrame([(1, k + 1, f) for k, f in enumerate(frames)], "video long, frame long, pixels array<struct<b:int,g:int,r:int>>"))
    rows = {r["frame"]: r for r in grids.cuts(stats, least_frames=2).collect()}
    coefficient = math.sqrt(6 * 5) / 8 + math.sqrt(2 * 3) / 8
    assert rows[1]["distance"] is None and rows[2]["distance"] == pytest.approx(math.sqrt(1 - coefficient)) and rows[3]["distance"] == 1.0 and rows[5]["distance"] == 0.0
    assert [rows[k]["cut"] for k in range(1, 7)] == [True, False, True, False, False, True]


def flow_reason(spark, change=None, tracks=1, moves=(2.0, 0.0), n=10, **frame):
    """The verdict on a frame whose points all move alike, but for what `change` does to a track."""
    rows = []
    for k in range(tracks):
        x = 200.0 + 600 * k
        points = [(10.0 + 5 * i, 20.0, 10.0 + 5 * i + moves[0], 20.0 + moves[1], 10.0 + 5 * i, 20.0, True, True) for i in range(n)]
        row = {"video": 1, "frame": 1, "row": k, "track": k + 1, "x1": x, "y1": 200.0, "x2": x + 300, "y2": 700.0, "points": points, "failed": None, "frame_ok": True, "dtype_ok": True, "frame_w": 1920, "frame_h": 1080, "gray_w": 320, "gray_h": 180} | frame
        rows.append(change(k, row) if change else row)
    point = "struct<ox:double,oy:double,mx:double,my:double,bx:double,by:double,ok:boolean,back:boolean>"
    schema = f"video long, frame long, row long, track long, x1 double, y1 double, x2 double, y2 double, points array<{point}>, failed string, frame_ok boolean, dtype_ok boolean, frame_w int, frame_h int, gray_w int, gray_h int"
    r = flow.flow_verdicts(spark.createDataFrame([tuple(row.values()) for row in rows], schema)).first()
    return r["reason"], [tuple(m) for m in r["moves"]]


def test_flow_accepts(spark):
    assert flow_reason(spark, tracks=2) == (None, [(1, 12.0, 0.0, 1.0), (2, 12.0, 0.0, 1.0)])

    def outlier(k, row):
        row["points"][0] = (10.0, 20.0, 25.0, 20.0, 10.0, 20.0, True, True)
        return row

    assert flow_reason(spark, outlier) == (None, [(1, 12.0, 0.0, 0.9)])


def test_flow_rejects(spark):
    def put(**values):
        return lambda k, row: row | values if k == 0 else row

    def spread(k, row):
        row["points"] = [(p[0], p[1], p[0] + 8 * (i % 3), *p[3:]) for i, p in enumerate(row["points"])]
        return row

    nan = float("nan")
    assert flow_reason(spark, frame_ok=False)[0] == "invalid_flow_frame" and flow_reason(spark, dtype_ok=False)[0] == "invalid_flow_dtype"
    assert flow_reason(spark, put(row=None, track=None))[0] == "flow_missing_track" and flow_reason(spark, put(track=None), 2)[0] == "flow_missing_track"
    assert flow_reason(spark, put(track=2), 2)[0] == "flow_duplicate_track" and flow_reason(spark, put(x2=100.0))[0] == "flow_invalid_box" and flow_reason(spark, put(x1=5.0))[0] == "flow_boundary"
    assert flow_reason(spark, put(x1=790.0, x2=1090.0), 2)[0] == "flow_crowding" and flow_reason(spark, put(points=None))[0] == "flow_feature_poor" and flow_reason(spark, n=5)[0] == "flow_feature_poor"
    assert flow_reason(spark, put(failed="forward"))[0] == "flow_solver_failure" and flow_reason(spark, put(failed="backward"))[0] == "flow_solver_failure"
    assert flow_reason(spark, moves=(nan, 0.0))[0] == "flow_invalid_result" and flow_reason(spark, spread)[0] == "flow_deformation"
    assert flow_reason(spark, lambda k, row: row | {"points": [(*p[:6], i < 5, True) for i, p in enumerate(row["points"])]})[0] == "flow_unreliable"
    assert flow_reason(spark, moves=(10.0, 0.0))[0] == "flow_jump" and flow_reason(spark, put(x1=1600.0, x2=1900.0))[0] == "flow_boundary"
    assert flow_reason(spark, put(x1=14.0, x2=314.0), moves=(-2.0, 0.0)) == ("flow_boundary", [])  # where it goes, not where it is


def test_envelope(spark):
    """A still track without variance stays in its box; speed moves one end, uncertainty widens both; what is no state has none."""

    def box(mean, diagonal, horizon=2, tracked=True, size=8):
        matrix = [[float(diagonal[r]) if r == c else 0.0 for c in range(size)] for r in range(8)]
        d = spark.createDataFrame([([float(v) for v in mean], matrix)], "mean array<double>, covariance array<array<double>>")
        b = d.select(flow.envelope(F.col("mean"), F.col("covariance"), tuple(map(F.lit, (75.0, 0.0, 125.0, 100.0))), F.lit(horizon), F.lit(tracked)).alias("b")).first()["b"]
        return tuple(b) if b else None

    still = [100, 50, 0.5, 100, 0, 0, 0, 0]
    assert box(still, [0] * 8) == (75.0, 0.0, 125.0, 100.0) and box([100, 50, 0.5, 100, 10, 0, 0, 0], [0] * 8) == (75.0, 0.0, 145.0, 100.0)
    assert box(still, [4, 0, 0, 0, 1, 0, 0, 0]) == (75.0 - 12, 0.0, 125.0 + 12, 100.0)  # 3 (2 + 2 x 1)
    assert box([100, 50, 0.5, 100, 0, 0, 0, 20], [0] * 8)[3] == 120.0 and box([100, 50, 0.5, 100, 0, 0, 0, 20], [0] * 8, tracked=False)[3] == 100.0
    assert box(still, [-1] + [0] * 7) is None and box(still[:7], [0] * 8) is None and box(still, [0] * 8, size=7) is None
    assert box([100, 50, 0.5, 100, 0, 0, -1, 0], [0] * 8) is None and box([float("nan"), *still[1:]], [0] * 8) is None


BOX = (100.0, 100.0, 200.0, 400.0)
BOX_TYPE, POINTS = "struct<x1:double,y1:double,x2:double,y2:double>", "array<struct<x:double,y:double,c:double>>"


def standing(**change):
    """A figure in BOX; change: point number to (x, y, c) in box units, or a confidence alone."""
    out = []
    for k, (x, y) in enumerate(poses.FIGURE):
        new = change.get(f"p{k}", 0.9)
        x, y, c = (x / 100, y / 100, new) if not isinstance(new, tuple) else new
        out.append((BOX[0] + 100 * x, BOX[1] + 300 * y, c))
    return out


def evidence(spark, points, box=BOX):
    return spark.createDataFrame([(points, box)], f"points {POINTS}, box {BOX_TYPE}").select(poses.assess(F.col("points"), F.col("box")).alias("e")).first()["e"]


def test_pose_evidence(spark):
    """A hidden face does not matter, a hidden hip does not either; two hidden ends, collapsed torsos and odd shapes do."""
    good = evidence(spark, standing())
    assert (good["reason"], good["face_reliable"], good["limb_reliable"], sum(good["valid"]), sum(good["torso"])) == ("reliable_torso", True, True, 17, 4)
    back = evidence(spark, standing(p0=0.1, p1=0.1, p2=0.1, p3=0.1, p4=0.1))
    assert back["torso_reliable"] and not back["face_reliable"]
    assert evidence(spark, standing(p11=0.1))["torso_reliable"] and evidence(spark, standing(p11=0.1, p5=0.45))["reason"] == "insufficient_torso"
    assert evidence(spark, standing(p11=(0.38, 0.27, 0.9), p12=(0.62, 0.27, 0.9)))["reason"] == "collapsed_or_implausible_torso"
    assert evidence(spark, standing(p5=(0.5, 0.25, 0.9), p6=(0.51, 0.25, 0.9)))["reason"] == "collapsed_or_implausible_torso"
    assert {evidence(spark, p, b)["reason"] for p, b in ((None, BOX), (standing()[:16], BOX), (standing(), (5.0, 5.0, 5.0, 9.0)), (standing(), None), (standing(), (float("nan"), 0.0, 1.0, 1.0)))} == {"invalid_pose"}


def motion(spark, first, second):
    d = spark.createDataFrame([(1, 1, first, BOX), (1, 2, second, BOX)], f"video long, frame long, points {POINTS}, box {BOX_TYPE}")
    d = d.withColumn("evidence", poses.assess(F.col("points"), F.col("box")))
    return poses.with_motion(d, ["video"]).filter("frame = 2").first()["motion"]


def test_pose_motion(spark):
    still = motion(spark, standing(), standing(p9=0.1))  # a wrist that is lost has not moved
    assert (still["torso"], still["limb"], still["torso_points"], still["limb_points"]) == (0, 0, 4, 7)
    arm = motion(spark, standing(), standing(p9=(0.22, 0.20, 0.9)))
    assert arm["torso"] == 0 and arm["limb"] == pytest.approx(0.35)
    assert motion(spark, standing(p5=0.1), standing(p6=0.1))["torso"] == math.inf  # two shared points are too few
    assert motion(spark, None, standing())["torso"] == math.inf


def test_pose_cues(spark):
    def cues(points):
        d = spark.createDataFrame([(points, BOX)], f"points {POINTS}, box {BOX_TYPE}")
        return d.select(poses.pose_cues(F.col("points"), F.col("box"), F.lit(1920), F.lit(1080), 0.35).alias("c")).first()["c"]

    whole = cues(standing())
    assert (whole["eye_y"], whole["body_cx"], whole["shoulder_y"], whole["shoulder_span"]) == pytest.approx((124, 150, 175, 36)) and whole["body_bottom_confident"] and whole["has_pose"]
    wide = 24.0  # three times the distance of the eyes is the largest estimate but one: the ears give 1.5 x 16
    assert tuple(whole["head"]) == pytest.approx((150 - wide / 2, 124 - wide * 1.25 * 0.45, 150 + wide / 2, 124 + wide * 1.25 * 0.55))
    assert not cues(standing(p15=0.1))["body_bottom_confident"] and cues(standing(**{f"p{k}": 0.1 for k in range(16)})) is None
    faceless = cues(standing(**{f"p{k}": 0.1 for k in range(5)}))
    assert faceless["head"] is None and faceless["eye_y"] is None and faceless["has_pose"] and faceless["body_top_y"] == 100.0
    assert cues(standing(**{f"p{k}": 0.1 for k in range(2, 17)}))["has_pose"] is False  # two face points make a head alone
    assert cues(None) is None and cues(standing()[:5]) is None


def test_roi_matches(spark):
    """A region's box counts for the person it overlaps clearly most, and only alone."""
    people = [(0, (0.0, 0.0, 100.0, 200.0)), (1, (300.0, 0.0, 400.0, 200.0))]
    found = [(0, 0, (5.0, 0.0, 105.0, 200.0)), (0, 1, (300.0, 0.0, 400.0, 200.0)), (1, 0, (300.0, 0.0, 400.0, 200.0)), (1, 1, (301.0, 0.0, 401.0, 200.0))]
    schema = f"people array<struct<idx:long,box:{BOX_TYPE}>>, found array<struct<idx:long,no:long,box:{BOX_TYPE}>>"
    matches = lambda f: [tuple(m) for m in poses.roi_matches(spark.createDataFrame([(people, f)], schema)).first()["matches"]]
    assert matches(found) == [(0, 0)]  # person 1 has two that are alike, and what region 0 shows of person 1 is not its own
    assert matches(found[:3]) == [(0, 0), (1, 0)] and matches([]) == []
