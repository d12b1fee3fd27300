"""Settings, and shapes of boxes, crops and masks: projections that need one row, and joins within a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area, clamp, iou, q6
from ..plans.catalog import DETECTIONS, FRAMES, Tables, query

Q = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"

# What each tracking profile sets, and what old options are called now.
PROFILES = [("conservative", 3, 0.1, 0.2, 0.2), ("balanced", 6, 0.1, 0.2, 0.35), ("fast", 6, 0.1, 0.25, 0.4)]
LEGACY = {
    "--motion-response": "--pan-time",
    "--motion-damping": "--pan-time",
    "--zoom-response": "--zoom-time",
    "--zoom-damping": "--zoom-time",
    "--target-alpha": "--target-time",
    "--zoom-alpha": "--zoom-speed",
    "--max-step-x": "--pan-speed-x",
    "--max-step-y": "--pan-speed-y",
    "--max-missed-frames": "--lost-hold-seconds",
    "--min-subject-hold-frames": "--subject-hold-seconds",
    "--saliency-trust-repo": None,  # no longer needed
}


def profiles(asked: DataFrame) -> DataFrame:
    """asked (run, profile, gap, pose_age) with what the profile sets where the user says nothing."""
    dim = asked.sparkSession.createDataFrame(PROFILES, "profile string, p_gap long, p_age double, p_cue double, p_pose double")
    return asked.join(F.broadcast(dim), "profile").select("run", "profile", F.coalesce("gap", "p_gap").alias("gap"), F.coalesce("pose_age", "p_pose").alias("pose_age"), F.col("p_cue").alias("cue_interval"))


@query("prj_profile", f"SELECT run, profile, gap, {Q.format('age')} AS pose_age FROM (SELECT run, CASE run % 3 WHEN 0 THEN 'conservative' WHEN 1 THEN 'balanced' ELSE 'fast' END AS profile, CAST(CASE WHEN run % 7 = 0 THEN 5 WHEN run % 3 = 0 THEN 3 ELSE 6 END AS BIGINT) AS gap, CASE run % 3 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.35::DOUBLE ELSE 0.4::DOUBLE END AS age FROM (SELECT o_orderkey AS run FROM orders))")
def prj_profile(t: Tables) -> DataFrame:
    run = F.col("run")
    name = F.element_at(F.array(*[F.lit(p[0]) for p in PROFILES]), (run % 3 + 1).cast("int"))
    asked = t.read("orders").select(F.col("o_orderkey").alias("run")).select("run", name.alias("profile"), F.when(run % 7 == 0, F.lit(5).cast("long")).alias("gap"), F.lit(None).cast("double").alias("pose_age"))
    return profiles(asked).select("run", "profile", "gap", q6(F.col("pose_age")).alias("pose_age"))


def modern(flags: Column) -> Column:
    """Old options as what replaces them, each once, in order; those that nothing replaces are left out, others stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in LEGACY.items() if pair[1] for x in pair])
    gone = [old for old, new in LEGACY.items() if new is None]
    return F.array_distinct(F.transform(F.filter(flags, lambda f: ~f.isin(gone)), lambda f: F.coalesce(F.try_element_at(names, f), f)))


@query("prj_legacy_flags", "SELECT run, CASE run % 4 WHEN 0 THEN '--pan-time,--zoom-speed' WHEN 1 THEN '--pan-speed-x,--pan-time' WHEN 2 THEN '--lost-hold-seconds,--input' ELSE '--output' END AS flags FROM (SELECT o_orderkey AS run FROM orders)")
def prj_legacy_flags(t: Tables) -> DataFrame:
    r, many = F.col("run") % 4, lambda *names: F.array(*map(F.lit, names))
    given = F.when(r == 0, many("--motion-response", "--motion-damping", "--zoom-alpha")).when(r == 1, many("--max-step-x", "--motion-damping")).when(r == 2, many("--saliency-trust-repo", "--max-missed-frames", "--input")).otherwise(many("--output"))
    return t.read("orders").select(F.col("o_orderkey").alias("run")).select("run", F.concat_ws(",", modern(given)).alias("flags"))


def device(asked: Column, gpus: Column, mps: Column) -> Column:
    """A device as it is named, and why it is refused: struct of device and fault, one of which is null.

    cpu; the first GPU for auto where there is one, else cpu; mps where there is such; cuda, cuda:N or N as cuda:N.  What is named but not there is
    refused, and never becomes the CPU.
    """
    name = F.lower(F.trim(asked))
    index = F.when(name == "cuda", "0").otherwise(F.regexp_replace(name, "^cuda:", ""))
    known = index.rlike(r"^[0-9]+\z")
    number = F.when(known, index.try_cast("long"))
    there = number < gpus
    found = F.when(name == "cpu", "cpu").when(name == "auto", F.when(gpus > 0, "cuda:0").otherwise("cpu")).when(name == "mps", F.when(mps, "mps")).when(there, F.concat(F.lit("cuda:"), number.cast("string")))
    fault = F.when(found.isNotNull(), None).when((name == "mps") | F.coalesce(known, F.lit(False)), "unavailable").otherwise("unknown")
    return F.struct(found.alias("device"), fault.alias("fault"))


@query("prj_device", """SELECT run, device, CASE WHEN device IS NULL THEN CASE run % 7 WHEN 5 THEN 'unknown' ELSE 'unavailable' END END AS fault FROM (SELECT run, CASE run % 7 WHEN 0 THEN 'cpu' WHEN 1 THEN CASE WHEN run % 4 > 0 THEN 'cuda:0' ELSE 'cpu' END WHEN 2 THEN CASE WHEN run % 4 > 0 THEN 'cuda:0' END WHEN 3 THEN CASE WHEN run % 4 > 2 THEN 'cuda:2' END WHEN 4 THEN CASE WHEN run % 4 > 1 THEN 'cuda:1' END WHEN 6 THEN CASE WHEN run % 3 = 0 THEN 'mps' END END AS device FROM (SELECT o_orderkey AS run FROM orders))""")
def prj_device(t: Tables) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, (" CPU", "auto", "cuda", "cuda:2", "1", "gpu", "MPS"))), (F.col("run") % 7 + 1).cast("int"))
    return t.read("orders").select(F.col("o_orderkey").alias("run")).select("run", device(asked, F.col("run") % 4, F.col("run") % 3 == 0).alias("d")).select("run", "d.device", "d.fault")


def crop_rect(cx: Column, cy: Column, cw: Column, ch: Column, w: int, h: int) -> dict[str, Column]:
    """Left, top, right and bottom of a crop about a middle, moved inside the frame."""
    left = clamp(F.bround(cx - cw / 2).cast("long"), F.lit(0).cast("long"), (F.lit(w) - cw).cast("long"))
    top = clamp(F.bround(cy - ch / 2).cast("long"), F.lit(0).cast("long"), (F.lit(h) - ch).cast("long"))
    return {"lft": left, "top": top, "rgt": left + cw, "btm": top + ch}


@query("prj_crop_rect", DETECTIONS + "SELECT frame, idx, lft, top, lft + 608 AS rgt, top + 800 AS btm FROM (SELECT frame, idx, greatest(0, least(1312, CAST(round_even((x1 + x2) / 2 - 304, 0) AS BIGINT))) AS lft, greatest(0, least(280, CAST(round_even((y1 + y2) / 2 - 400, 0) AS BIGINT))) AS top FROM det)")
def prj_crop_rect(t: Tables) -> DataFrame:
    rect = crop_rect((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.lit(608).cast("long"), F.lit(800).cast("long"), 1920, 1080)
    return t.detections.select("frame", "idx", *[c.alias(n) for n, c in rect.items()])


def letterbox(w: Column, h: Column, side: int, stride: int | None = None) -> dict[str, Column]:
    """Gain, size and padding by which w x h fits a square; with a stride the least padding to a multiple of it."""
    gain = F.least(side / h, side / w)
    rw, rh = F.bround(w * gain).cast("long"), F.bround(h * gain).cast("long")
    dw, dh = (side - x if stride is None else (side - x) % stride for x in (rw, rh))
    pads = {n: F.bround(d / 2 + e).cast("long") for n, d, e in (("pad_l", dw, -0.1), ("pad_r", dw, 0.1), ("pad_t", dh, -0.1), ("pad_b", dh, 0.1))}
    return {"rw": rw, "rh": rh, **pads}


@query("prj_letterbox", DETECTIONS + "SELECT frame, idx, rw, rh, CAST(round_even((640 - rw) % 32 / 2.0 - 0.1, 0) AS BIGINT) AS pad_l, CAST(round_even((640 - rw) % 32 / 2.0 + 0.1, 0) AS BIGINT) AS pad_r, CAST(round_even((640 - rh) % 32 / 2.0 - 0.1, 0) AS BIGINT) AS pad_t, CAST(round_even((640 - rh) % 32 / 2.0 + 0.1, 0) AS BIGINT) AS pad_b FROM (SELECT frame, idx, CAST(round_even(w * g, 0) AS BIGINT) AS rw, CAST(round_even(h * g, 0) AS BIGINT) AS rh FROM (SELECT *, least(640 / h, 640 / w) AS g FROM (SELECT frame, idx, x2 - x1 AS w, y2 - y1 AS h FROM det)))")
def prj_letterbox(t: Tables) -> DataFrame:
    return t.detections.select("frame", "idx", *[c.alias(n) for n, c in letterbox(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 640, 32).items()])


def mask_geometry(size: Column, cx: Column, cy: Column, top: Column) -> Column:
    """A mask relative to its box (x1 to y2): share, middle and top; null where it cannot be a mask of that box."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share, x, y, t = size / (w * h), (cx - F.col("x1")) / w, (cy - F.col("y1")) / h, (top - F.col("y1")) / h
    ok = (w > 0) & (h > 0) & share.between(0.02, 1.25) & x.between(-0.12, 1.12) & y.between(-0.12, 1.12) & t.between(-0.12, 1.12) & (top <= cy)
    return F.when(ok, F.struct(share.alias("share"), x.alias("x"), y.alias("y"), t.alias("top")))


@query("prj_mask_geometry", DETECTIONS + f"SELECT frame, idx, {Q.format('CASE WHEN ok THEN share END')} AS share, {Q.format('CASE WHEN ok THEN y END')} AS y FROM (SELECT *, share BETWEEN 0.02 AND 1.25 AND y BETWEEN -0.12 AND 1.12 AND tp BETWEEN -0.12 AND 1.12 AND tp <= y AS ok FROM (SELECT frame, idx, conf * 1.5::DOUBLE AS share, 0.5::DOUBLE + qty / 60 AS y, qty / 40 AS tp FROM det))")
def prj_mask_geometry(t: Tables) -> DataFrame:
    h = F.col("y2") - F.col("y1")
    d = t.detections.select("frame", "idx", mask_geometry(F.col("conf") * 1.5 * area(""), (F.col("x1") + F.col("x2")) / 2, F.col("y1") + h * (0.5 + F.col("qty") / 60), F.col("y1") + h * (F.col("qty") / 40)).alias("g"))
    return d.select("frame", "idx", q6(F.col("g.share")).alias("share"), q6(F.col("g.y")).alias("y"))


def stable_box(o: str, n: str, tolerance: float = 0.2) -> Column:
    """Whether box n has about the size and place of box o (column prefixes)."""
    c = lambda p, k: F.col(f"{p}{k}")
    ow, oh = (F.greatest(F.lit(1.0), c(o, f"{a}2") - c(o, f"{a}1")) for a in "xy")
    sx, sy = (c(n, "x2") - c(n, "x1")) / ow, (c(n, "y2") - c(n, "y1")) / oh
    low, high = 1 - tolerance, 1 / (1 - tolerance)
    return sx.between(low, high) & sy.between(low, high) & (F.abs(c(n, "x1") - c(o, "x1")) < ow * tolerance) & (F.abs(c(n, "y1") - c(o, "y1")) < oh * tolerance)


MOVED = DETECTIONS + ", moved AS (SELECT *, x1 + qty AS nx1, y1 + qty AS ny1, x1 + qty + (x2 - x1) * (0.75::DOUBLE + conf / 2) AS nx2, y1 + qty + (y2 - y1) * (0.75::DOUBLE + conf / 2) AS ny2 FROM det)\n"


def _moved(t: Tables) -> DataFrame:
    s = 0.75 + F.col("conf") / 2
    return t.detections.select("frame", "idx", "conf", "x1", "y1", "x2", "y2", *[(F.col(f"{a}1") + F.col("qty")).alias(f"n{a}1") for a in "xy"], *[(F.col(f"{a}1") + F.col("qty") + (F.col(f"{a}2") - F.col(f"{a}1")) * s).alias(f"n{a}2") for a in "xy"])


@query("pos_stable_box", MOVED + "SELECT frame, idx, (nx2 - nx1) / (x2 - x1) BETWEEN 0.8 AND 1.25 AND (ny2 - ny1) / (y2 - y1) BETWEEN 0.8 AND 1.25 AND nx1 - x1 < (x2 - x1) * 0.2::DOUBLE AND ny1 - y1 < (y2 - y1) * 0.2::DOUBLE AS ok FROM moved")
def pos_stable_box(t: Tables) -> DataFrame:
    return _moved(t).select("frame", "idx", stable_box("", "n").alias("ok"))


def remap(value: Column, axis: str, o: str, n: str) -> Column:
    """A coordinate in box o at the same place in box n."""
    c = lambda p, k: F.col(f"{p}{axis}{k}")
    return c(n, 1) + (value - c(o, 1)) * ((c(n, 2) - c(n, 1)) / (c(o, 2) - c(o, 1)))


@query("pos_remap", MOVED + f"SELECT frame, idx, {Q.format('nx1 + ((x1 + x2) / 2 - x1) * ((nx2 - nx1) / (x2 - x1))')} AS eye_x, {Q.format('ny1 + (y1 + 5 - y1) * ((ny2 - ny1) / (y2 - y1))')} AS eye_y FROM moved")
def pos_remap(t: Tables) -> DataFrame:
    return _moved(t).select("frame", "idx", q6(remap((F.col("x1") + F.col("x2")) / 2, "x", "", "n")).alias("eye_x"), q6(remap(F.col("y1") + 5, "y", "", "n")).alias("eye_y"))


def relevant(tracks: DataFrame, wanted: Column) -> DataFrame:
    """Tracks of a frame that are a subject (wanted), touch one grown by a fifth, or have 0.45 of its area; all where a frame has no subject."""
    cols = ["x1", "y1", "x2", "y2"]
    s = tracks.withColumn("subject", wanted)
    grown = s.filter("subject").select("frame", F.col("idx").alias("s_idx"), area("").alias("s_area"), *[(F.col(c) + (1 if c[1] == "2" else -1) * 0.2 * (F.col(f"{c[0]}2") - F.col(f"{c[0]}1"))).alias(f"g_{c}") for c in cols])
    near = s.join(grown, "frame", "left").filter(F.col("s_idx").isNull() | F.col("subject") | (iou("", "g_") > 0) | (area("") >= 0.45 * F.col("s_area")))
    return near.select("frame", "idx").distinct()


@query("jn_relevant", DETECTIONS + "SELECT DISTINCT d.frame, d.idx FROM det d LEFT JOIN (SELECT *, 0.2::DOUBLE * (x2 - x1) AS mx, 0.2::DOUBLE * (y2 - y1) AS my FROM det WHERE cls = 0) s ON d.frame = s.frame WHERE s.idx IS NULL OR d.cls = 0 OR (least(d.x2, s.x2 + s.mx) > greatest(d.x1, s.x1 - s.mx) AND least(d.y2, s.y2 + s.my) > greatest(d.y1, s.y1 - s.my)) OR (d.x2 - d.x1) * (d.y2 - d.y1) >= 0.45::DOUBLE * ((s.x2 - s.x1) * (s.y2 - s.y1))")
def jn_relevant(t: Tables) -> DataFrame:
    return relevant(t.detections.select("frame", "idx", "cls", "x1", "y1", "x2", "y2"), F.col("cls") == 0)


def looked_up(asked: DataFrame, tracks: DataFrame) -> DataFrame:
    """Asked tracks (frame, track) with what the tracker holds of them, and whether it lacks them, which is an error where they are guarded."""
    j = asked.join(tracks, ["frame", "track"], "left")
    return j.withColumn("lacks", F.col("idx").isNull())


@query("jn_id_lookup", DETECTIONS + ", one AS (SELECT frame, track, min(idx) AS idx FROM det GROUP BY ALL) SELECT a.frame, a.track + a.track % 2 AS track, o.idx, o.idx IS NULL AS lacks FROM (SELECT DISTINCT frame, track FROM det) a LEFT JOIN one o ON o.frame = a.frame AND o.track = a.track + a.track % 2")
def jn_id_lookup(t: Tables) -> DataFrame:
    d = t.detections
    asked = d.select("frame", "track").distinct().withColumn("track", F.col("track") + F.col("track") % 2)
    return looked_up(asked, d.groupBy("frame", "track").agg(F.min("idx").alias("idx")))


@query("jn_near_envelope", MOVED + ", prime AS (SELECT frame, x1, y1, x2, y2, (x2 - x1) / 2 AS gx, (y2 - y1) / 2 AS gy FROM det WHERE idx = 0) SELECT m.frame, count(*) AS near FROM moved m JOIN prime p ON m.frame = p.frame AND m.idx > 0 AND least(m.x1, m.nx1) <= p.x2 + gx AND greatest(m.x2, m.nx2) >= p.x1 - gx AND least(m.y1, m.ny1) <= p.y2 + gy AND greatest(m.y2, m.ny2) >= p.y1 - gy GROUP BY m.frame")
def jn_near_envelope(t: Tables) -> DataFrame:
    """Frames where the span of another track's motion meets the primary's box grown by half its size."""
    m = _moved(t)
    p = m.filter("idx = 0").select("frame", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    j, meets = m.filter("idx > 0").join(p, "frame"), F.lit(True)
    for a in "xy":
        guard = (F.col(f"p_{a}2") - F.col(f"p_{a}1")) / 2
        meets = meets & (F.least(f"{a}1", f"n{a}1") <= F.col(f"p_{a}2") + guard) & (F.greatest(f"{a}2", f"n{a}2") >= F.col(f"p_{a}1") - guard)
    return j.filter(meets).groupBy("frame").agg(F.count("*").alias("near"))


@query("dec_pair_fits", DETECTIONS + "SELECT frame, w + 2 * greatest(w * 0.12::DOUBLE, 16) <= 608 / 1.0::DOUBLE AND h + 2 * greatest(h * 0.16::DOUBLE, 20) <= 1080 / 1.0::DOUBLE AS fits FROM (SELECT frame, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h FROM det WHERE idx < 2 GROUP BY frame HAVING count(*) = 2)")
def dec_pair_fits(t: Tables) -> DataFrame:
    """Whether the padded union of a frame's first two boxes fits the crop at a zoom of 1."""
    g = t.detections.filter("idx < 2").groupBy("frame").agg((F.max("x2") - F.min("x1")).alias("w"), (F.max("y2") - F.min("y1")).alias("h"), F.count("*").alias("n")).filter("n = 2")
    fits = (F.col("w") + 2 * F.greatest(F.col("w") * 0.12, F.lit(16.0)) <= 608.0) & (F.col("h") + 2 * F.greatest(F.col("h") * 0.16, F.lit(20.0)) <= 1080.0)
    return g.select("frame", fits.alias("fits"))


def refresh_reason(confidence: Column, age: Column, gap: Column, interval: Column, sure: Column, oldest: float = 0.1) -> Column:
    """The first of the reasons for which a frame is detected anew; null to predict."""
    return F.when(confidence < 0.45, "low_confidence").when(age >= oldest - 1e-9, "age_limit").when(gap >= interval, "scheduled").when(~sure, "uncertain_motion")


AGED = FRAMES + ", aged AS (SELECT *, frame - last_value(CASE WHEN detected THEN frame END IGNORE NULLS) OVER (PARTITION BY video, scene ORDER BY frame) AS gap FROM frames)\n"


def _aged(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    last = F.last(F.when(F.col("detected"), F.col("frame")), ignorenulls=True).over(Window.partitionBy("video", "scene").orderBy("frame"))
    return t.frames.withColumn("gap", F.col("frame") - last)


@query("trk_refresh_reason", AGED + "SELECT video, frame, CASE WHEN 0.4 + (event_id % 7) / 20.0 < 0.45 THEN 'low_confidence' WHEN gap / 30.0 >= 0.1 - 1e-9 THEN 'age_limit' WHEN gap >= itv THEN 'scheduled' WHEN event_id % 5 = 0 THEN 'uncertain_motion' END AS reason FROM aged")
def trk_refresh_reason(t: Tables) -> DataFrame:
    a = _aged(t)
    return a.select("video", "frame", refresh_reason(0.4 + (F.col("event_id") % 7) / 20.0, F.col("gap") / 30.0, F.col("gap"), F.col("itv"), F.col("event_id") % 5 != 0).alias("reason"))


def metadata_reason(tracks: Column, forced: Column, native: Column, unsettled: Column) -> Column:
    """The first of the reasons known before any pixel is looked at."""
    return F.when(tracks == 0, "no_tracks").when(forced.isNotNull(), forced).when(~native, "unsupported_tracker").when(unsettled, "unsettled_tracks")


@query("trk_metadata_reason", FRAMES + "SELECT video, frame, CASE WHEN event_id % 6 = 0 THEN 'no_tracks' WHEN event_type = 'error' THEN 'error' WHEN event_id % 5 = 0 THEN 'unsupported_tracker' WHEN itv = 3 THEN 'unsettled_tracks' END AS reason FROM frames")
def trk_metadata_reason(t: Tables) -> DataFrame:
    return t.frames.select("video", "frame", metadata_reason(F.col("event_id") % 6, F.when(F.col("event_type") == "error", F.col("event_type")), F.col("event_id") % 5 != 0, F.col("itv") == 3).alias("reason"))


def fresh_mask(stable: Column, seen: Column, change: Column, age: Column, gap: Column, oldest: float = 0.1) -> Column:
    """Whether a mask's evidence still holds: stable, twice observed, changed little, and recent within the scene."""
    return F.coalesce(stable & (seen >= 2) & change.between(0, 0.08) & (age >= 0) & (age <= oldest + 1e-9) & (gap >= 0), F.lit(False))


@query("trk_fresh_mask", AGED + "SELECT video, frame, coalesce(event_id % 4 > 0 AND itv >= 2 AND value / 1000 BETWEEN 0 AND 0.08 AND gap / 30.0 <= 0.1 + 1e-9, false) AS fresh FROM aged")
def trk_fresh_mask(t: Tables) -> DataFrame:
    return _aged(t).select("video", "frame", fresh_mask(F.col("event_id") % 4 > 0, F.col("itv"), F.col("value") / 1000, F.col("gap") / 30.0, F.col("gap")).alias("fresh"))


@query("trk_extension_safe", AGED + "SELECT video, frame, coalesce(event_type = 'click' AND event_id % 4 > 0 AND itv >= 2 AND gap / 30.0 <= 0.1 + 1e-9 AND gap / 30.0 <= 0.05 + 1e-9, false) AS safe FROM aged")
def trk_extension_safe(t: Tables) -> DataFrame:
    """Long gaps are allowed for a person with a fresh mask and a pose that was stable twice and is recent."""
    return _aged(t).select("video", "frame", extension_safe(F.col("event_type") == "click", fresh_mask(F.col("event_id") % 4 > 0, F.col("itv"), F.lit(0.0), F.col("gap") / 30.0, F.col("gap")), F.col("itv"), F.col("gap") / 30.0, 0.05).alias("safe"))


def extension_safe(person: Column, fresh: Column, pose_runs: Column, pose_age: Column, oldest: float) -> Column:
    return F.coalesce(person & fresh & (pose_runs >= 2) & (pose_age >= 0) & (pose_age <= oldest + 1e-9), F.lit(False))


@query("sal_cache_valid", AGED + "SELECT video, frame, coalesce(gap / 30.0 < 0.35 AND value / 5000 < 0.015 AND value / 2000 < 0.045 AND event_id % 3 > 0, false) AS valid FROM aged")
def sal_cache_valid(t: Tables) -> DataFrame:
    """A cached map counts while it is recent, the picture has hardly changed, and the tracks are the same."""
    return _aged(t).select("video", "frame", cache_valid(F.col("gap") / 30.0, F.col("value") / 5000, F.col("value") / 2000, F.col("event_id") % 3 > 0).alias("valid"))


def cache_valid(age: Column, change: Column, tile: Column, same: Column, oldest: float = 0.35) -> Column:
    return F.coalesce((age >= 0) & (age < oldest) & (change < 0.015) & (tile < 0.045) & same, F.lit(False))


@query("rnk_lru", DETECTIONS + "SELECT video, track FROM (SELECT video, track, row_number() OVER (PARTITION BY video ORDER BY max(frame) DESC, track) AS k FROM det GROUP BY video, track) WHERE k <= 8")
def rnk_lru(t: Tables) -> DataFrame:
    return cached(t.detections, 8)


def cached(tracks: DataFrame, most: int) -> DataFrame:
    """The tracks of a video that a cache of `most` still holds: those put in last."""
    from pyspark.sql import Window

    last = tracks.groupBy("video", "track").agg(F.max("frame").alias("frame"))
    return last.withColumn("k", F.row_number().over(Window.partitionBy("video").orderBy(F.desc("frame"), "track"))).filter(F.col("k") <= most).select("video", "track")
