"""What decides where to look closely: subjects and risks of a frame, evidence of masks, unsettled tracks, people a pose may stand for.

A frame is a row with its tracks as an array, so nothing within a frame is joined or
shuffled; frames meet the one before them by a window over the video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import let, q6
from ..plans.catalog import Tables, query
from .overlaps import overlap

Q = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"

#: Embeddings of a label as the frames of a video with up to three tracks; keys choose what comes, goes and moves.
TRACKS = """WITH fr AS (SELECT vec_id, label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings),
tr AS (SELECT *, x1 + 200 + CASE WHEN j = 1 THEN 60 * ((f // 6) % 3) ELSE 0 END + vec_id % 3 AS x2, y1 + 500 - 150 * j + vec_id % 4 AS y2 FROM (SELECT vec_id, video, f, j, CASE WHEN j = 1 AND f % 23 = 0 THEN NULL WHEN j = 0 AND f % 17 = 0 THEN 10 * video + 5 ELSE 10 * video + j END AS track, CASE WHEN j = 2 AND f % 5 = 0 THEN 16 ELSE 0 END AS cls, 0.3::DOUBLE + (vec_id * 13 + j * 29) % 70 / 100 AS conf,
CAST(100 + 420 * j - CASE WHEN f % 11 = 0 THEN 360 * j ELSE 0 END + vec_id % 7 AS DOUBLE) AS x1, CAST(80 + vec_id % 5 AS DOUBLE) AS y1, (vec_id + j) % 13 > 0 AS reliable, (vec_id + 2 * j) % 5 > 0 AS pose_ok FROM fr, range(0, 3) AS s(j) WHERE j < CASE WHEN f % 19 = 0 THEN 0 ELSE 1 + (f // 4) % 3 END))
"""


def _struct(**parts: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def sights(t: Tables) -> DataFrame:
    """The same as DataFrame: vec_id, video, frame, tracks (row, track, cls, confidence, box, reliable, pose_ok)."""
    n, f = F.col("vec_id"), F.col("frame")
    frame = F.row_number().over(Window.partitionBy("video").orderBy("vec_id")).cast("long")
    d = t.read("embeddings").select("vec_id", F.col("label").cast("long").alias("video")).withColumn("frame", frame)

    def track(j: Column) -> Column:
        x1, y1 = (100 + 420 * j - F.when(f % 11 == 0, 360 * j).otherwise(0) + n % 7).cast("double"), (80 + n % 5).cast("double")
        box = _struct(x1=x1, y1=y1, x2=x1 + 200 + F.when(j == 1, 60 * (F.floor(f / 6) % 3)).otherwise(0) + n % 3, y2=y1 + 500 - 150 * j + n % 4)
        name = F.when((j == 1) & (f % 23 == 0), None).when((j == 0) & (f % 17 == 0), 10 * F.col("video") + 5).otherwise(10 * F.col("video") + j)
        return _struct(row=j, track=name, cls=F.when((j == 2) & (f % 5 == 0), 16).otherwise(0), confidence=0.3 + (n * 13 + j * 29) % 70 / 100, box=box, reliable=(n + j) % 13 > 0, pose_ok=(n + 2 * j) % 5 > 0)

    rows = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), lambda j: j < F.when(f % 19 == 0, 0).otherwise(1 + F.floor(f / 4) % 3))
    return d.withColumn("tracks", F.transform(rows, track))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x2"] - box["x1"]) * F.greatest(F.lit(0.0), box["y2"] - box["y1"])


# Subjects and risks.


def subjects(tracks: Column, preferred: Column, lock: Column, two: Column) -> Column:
    """Whom a frame is about: rows, reliable (their poses may stand for the picture), and the reason.

    tracks: array of row, track, cls (0: a person), confidence, box, pose_ok; preferred: the track followed so far; lock: whether only
    that may be one; two: whether two people may be shown.
    """
    people = F.filter(tracks, lambda t: t["cls"] == 0)

    def told(rows: Column, reason: Column | str, reliable: Column | None = None) -> Column:
        return _struct(rows=rows, reliable=F.lit(False) if reliable is None else reliable, reason=F.lit(reason) if isinstance(reason, str) else reason)

    none = F.array().cast("array<bigint>")
    locked = lock & preferred.isNotNull()

    def chosen(p: Column) -> Column:
        own = F.get(F.filter(p, lambda t: t["track"] == preferred), F.lit(0))
        rows = F.transform(p, lambda t: t["row"])
        some = F.when((two & (F.size(p) == 2)) | (F.size(p) == 1), p).when(locked & own.isNotNull(), F.array(own))
        return (
            F.when(F.size(p) == 0, told(none, F.when(locked, "locked_subject_missing").otherwise("no_person_pose")))
            .when(locked & own.isNull(), told(none, "locked_subject_missing"))
            .otherwise(let(some, lambda s: F.when(s.isNull(), told(rows, "ambiguous_subjects")).otherwise(judged(s, p))))
        )

    def judged(s: Column, p: Column) -> Column:
        rows = F.transform(s, lambda t: t["row"])
        over = F.exists(s, lambda a: F.exists(p, lambda b: (a["row"] != b["row"]) & (overlap(a["box"], b["box"]) > 0.35)))
        first = F.get(s, F.lit(0))
        rival = (F.size(s) == 1) & F.exists(p, lambda b: (b["row"] != first["row"]) & (b["confidence"] >= 0.45) & (area(b["box"]) >= 0.60 * area(first["box"])))
        thing = ~lock & F.exists(tracks, lambda t: t["cls"] != 0)
        sure = F.forall(s, lambda t: t["pose_ok"])
        return F.when(over, told(rows, "overlapping_people")).when(rival, told(rows, "competing_person")).when(thing, told(rows, "competing_object")).otherwise(told(rows, F.when(sure, "reliable_pose").otherwise("insufficient_or_stale_pose"), sure))

    return let(people, chosen)


#: What each frame prefers, and whether it is locked or may show two.
ASKED = TRACKS + """, ask AS (SELECT *, CASE f % 4 WHEN 1 THEN 10 * video WHEN 2 THEN 10 * video + 1 WHEN 3 THEN 10 * video + 7 END AS preferred, (f // 8) % 2 = 1 AS locked, (f // 16) % 2 = 1 AS two FROM fr),
sure AS (SELECT * FROM tr WHERE reliable), ppl AS (SELECT * FROM sure WHERE cls = 0),
num AS (SELECT vec_id, count(*) AS n FROM ppl GROUP BY vec_id), thing AS (SELECT DISTINCT vec_id FROM sure WHERE cls <> 0), pref AS (SELECT a.vec_id, min(j) AS pj FROM ask a JOIN ppl p ON p.vec_id = a.vec_id AND p.track = a.preferred GROUP BY a.vec_id),
mode AS (SELECT a.*, pj, CASE WHEN n IS NULL THEN CASE WHEN locked AND preferred IS NOT NULL THEN 'locked_subject_missing' ELSE 'no_person_pose' END WHEN locked AND preferred IS NOT NULL AND pj IS NULL THEN 'locked_subject_missing' WHEN n = 1 OR (two AND n = 2) THEN 'all' WHEN locked AND pj IS NOT NULL THEN 'one' ELSE 'ambiguous_subjects' END AS mode FROM ask a LEFT JOIN num USING (vec_id) LEFT JOIN pref USING (vec_id)),
sub AS (SELECT p.* FROM ppl p JOIN mode m ON m.vec_id = p.vec_id WHERE mode IN ('all', 'ambiguous_subjects') OR (mode = 'one' AND p.j = pj)),
versus AS (SELECT s.vec_id, bool_or(i / greatest(1, a1 + a2 - i) > 0.35::DOUBLE) AS over, bool_or(oconf >= 0.45::DOUBLE AND a2 >= 0.6::DOUBLE * a1) AS rival FROM (SELECT s.vec_id, p.conf AS oconf, greatest(0, least(s.x2, p.x2) - greatest(s.x1, p.x1)) * greatest(0, least(s.y2, p.y2) - greatest(s.y1, p.y1)) AS i, (s.x2 - s.x1) * (s.y2 - s.y1) AS a1, (p.x2 - p.x1) * (p.y2 - p.y1) AS a2 FROM sub s JOIN ppl p ON p.vec_id = s.vec_id AND p.j <> s.j) s GROUP BY s.vec_id),
size AS (SELECT vec_id, count(*) AS ns, bool_and(pose_ok) AS all_ok, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS rows FROM sub GROUP BY vec_id),
who AS (SELECT m.vec_id, m.video, m.f, coalesce(rows, '') AS rows, CASE WHEN mode NOT IN ('all', 'one') THEN mode WHEN coalesce(over, false) THEN 'overlapping_people' WHEN ns = 1 AND coalesce(rival, false) THEN 'competing_person' WHEN NOT locked AND t.vec_id IS NOT NULL THEN 'competing_object' WHEN all_ok THEN 'reliable_pose' ELSE 'insufficient_or_stale_pose' END AS reason FROM mode m LEFT JOIN size USING (vec_id) LEFT JOIN versus USING (vec_id) LEFT JOIN thing t ON t.vec_id = m.vec_id)
"""


def asked(t: Tables) -> DataFrame:
    f, v = F.col("frame"), 10 * F.col("video")
    preferred = F.when(f % 4 == 1, v).when(f % 4 == 2, v + 1).when(f % 4 == 3, v + 7)
    d = sights(t).withColumns({"seen": F.col("tracks"), "tracks": F.filter("tracks", lambda x: x["reliable"])})
    return d.withColumn("who", subjects(F.col("tracks"), preferred, F.floor(f / 8) % 2 == 1, F.floor(f / 16) % 2 == 1))


@query("sal_subjects", ASKED + "SELECT vec_id, rows, reason, reason = 'reliable_pose' AS reliable FROM who")
def sal_subjects(t: Tables) -> DataFrame:
    w = F.col("who")
    return asked(t).select("vec_id", F.array_join(w["rows"].cast("array<string>"), ",").alias("rows"), w["reason"].alias("reason"), w["reliable"].alias("reliable"))


def same_track(now: Column, old: Column, strict: bool = False) -> Column:
    """Whether two sights of one track (cls, track, box) agree in class, place and size; never without an identity."""
    far, low, high = (0.025, 0.96, 1.04) if strict else (0.12, 0.8, 1.25)
    a, b = now["box"], old["box"]
    w, h = F.greatest(b["x2"] - b["x1"], F.lit(1.0)), F.greatest(b["y2"] - b["y1"], F.lit(1.0))
    near = (F.abs((a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2) <= far * w) & (F.abs((a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2) <= far * h)
    sized = ((a["x2"] - a["x1"]) / w).between(low, high) & ((a["y2"] - a["y1"]) / h).between(low, high)
    return F.coalesce((now["track"] == old["track"]) & (now["cls"] == old["cls"]) & near & sized, F.lit(False))


def relevant(tracks: Column, some: Column) -> Column:
    """Tracks that matter to the subjects (array of tracks): themselves, those that touch one grown by a fifth, those of 0.45 of its area; all without subjects."""

    def near(t: Column) -> Column:
        def to(s: Column) -> Column:
            b = s["box"]
            mx, my = (b["x2"] - b["x1"]) * 0.2, (b["y2"] - b["y1"]) * 0.2
            grown = _struct(x1=b["x1"] - mx, y1=b["y1"] - my, x2=b["x2"] + mx, y2=b["y2"] + my)
            return s["track"].eqNullSafe(t["track"]) | (overlap(t["box"], grown) > 0) | (area(t["box"]) >= 0.45 * area(b))

        return F.exists(some, to)

    return F.when(F.size(some) == 0, tracks).otherwise(F.filter(tracks, near))


# Reasons that are risks themselves.
RISKY = ["overlapping_people", "locked_subject_missing", "competing_person", "competing_object", "ambiguous_subjects", "insufficient_or_stale_pose"]


def risks(frames: DataFrame, change: Column, tile: Column) -> DataFrame:
    """frames (video, frame, tracks that are reliable, seen: all tracks, who: of subjects) with risks, sorted, and fresh: those the frame before has not.

    A risk is its kind, a colon and the tracks it is about.  change, tile: how far the picture changed, as a mean and in its worst tile.
    """
    w = Window.partitionBy("video").orderBy("frame")
    some = F.filter("tracks", lambda t: F.array_contains(F.col("who.rows"), t["row"]))
    d = frames.withColumns({"_some": some, "_change": change, "_tile": tile})
    d = d.withColumn("_near", relevant(F.col("tracks"), F.col("_some")))
    d = d.withColumn("_ids", F.array_distinct(F.transform(F.filter("_some", lambda s: s["track"].isNotNull()), lambda s: s["track"])))
    d = d.withColumn("_old", F.lag(F.struct("tracks", "seen", F.col("_ids").alias("ids"))).over(w))
    text = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.coalesce(c.cast("string"), F.lit("")))
    ids = F.array_sort(F.transform(F.filter("_near", lambda t: t["track"].isNotNull()), lambda t: t["track"]))
    first = F.when(F.col("who.reason").isin(*RISKY), F.array(F.concat(F.col("who.reason"), F.lit(":"), F.array_join(ids.cast("array<string>"), ","))))
    image = F.when((F.col("_change") >= 0.12) | (F.col("_tile") >= 0.30), F.array(F.lit("severe_image_change:")))
    lost = F.transform(F.array_except("_old.ids", "_ids"), lambda i: text("subject_missing", i))
    new = F.transform(F.filter("seen", lambda t: t["track"].isNull() | ~F.exists("_old.seen", lambda o: o["track"].eqNullSafe(t["track"]))), lambda t: text("new_subject", t["track"]))
    moved = F.filter("_near", lambda t: let(F.try_element_at(F.filter("_old.tracks", lambda o: o["track"].eqNullSafe(t["track"])), F.lit(-1)), lambda o: o.isNotNull() & ~same_track(t, o)))
    none = F.array().cast("array<string>")
    since = F.when(F.col("_old").isNotNull(), F.concat(lost, new, F.transform(moved, lambda t: text("subject_geometry_change", t["track"]))))
    d = d.withColumn("risks", F.array_sort(F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(image, none), F.coalesce(since, none)))))
    fresh = F.array_except("risks", F.coalesce(F.lag("risks").over(w), none))
    return d.withColumn("fresh", F.array_sort(fresh)).drop("_some", "_change", "_tile", "_near", "_ids", "_old")


@query(
    "sal_risks",
    ASKED
    + """, cand AS (SELECT t.*, m.pj, s.vec_id IS NOT NULL AS subject FROM sure t JOIN mode m USING (vec_id) LEFT JOIN sub s ON s.vec_id = t.vec_id AND s.j = t.j),
rel AS (SELECT DISTINCT t.vec_id, t.j, t.track, t.cls, t.x1, t.y1, t.x2, t.y2, t.video, t.f FROM cand t LEFT JOIN (SELECT vec_id, track, x1, y1, x2, y2, (x2 - x1) * 0.2::DOUBLE AS mx, (y2 - y1) * 0.2::DOUBLE AS my FROM sub) s ON s.vec_id = t.vec_id WHERE s.vec_id IS NULL OR s.track IS NOT DISTINCT FROM t.track OR (least(t.x2, s.x2 + mx) > greatest(t.x1, s.x1 - mx) AND least(t.y2, s.y2 + my) > greatest(t.y1, s.y1 - my)) OR (t.x2 - t.x1) * (t.y2 - t.y1) >= 0.45::DOUBLE * ((s.x2 - s.x1) * (s.y2 - s.y1))),
link AS (SELECT b.vec_id, a.vec_id AS old FROM fr a JOIN fr b ON a.video = b.video AND b.f = a.f + 1),
risk AS (SELECT w.vec_id, reason || ':' || coalesce((SELECT string_agg(CAST(track AS VARCHAR), ',' ORDER BY track) FROM rel r WHERE r.vec_id = w.vec_id AND track IS NOT NULL), '') AS risk FROM who w WHERE reason NOT IN ('no_person_pose', 'reliable_pose')
UNION SELECT vec_id, 'severe_image_change:' FROM fr WHERE vec_id % 20 / 100 >= 0.12::DOUBLE OR vec_id % 9 / 20 >= 0.3::DOUBLE
UNION SELECT l.vec_id, 'subject_missing:' || s.track FROM link l JOIN sub s ON s.vec_id = l.old WHERE s.track IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sub n WHERE n.vec_id = l.vec_id AND n.track = s.track)
UNION SELECT l.vec_id, 'new_subject:' || coalesce(CAST(t.track AS VARCHAR), '') FROM link l JOIN tr t ON t.vec_id = l.vec_id WHERE t.track IS NULL OR NOT EXISTS (SELECT 1 FROM tr o WHERE o.vec_id = l.old AND o.track = t.track)
UNION SELECT r.vec_id, 'subject_geometry_change:' || coalesce(CAST(r.track AS VARCHAR), '') FROM rel r JOIN link l ON l.vec_id = r.vec_id JOIN sure o ON o.vec_id = l.old AND o.track IS NOT DISTINCT FROM r.track WHERE r.track IS NULL OR r.cls <> o.cls OR abs((r.x1 + r.x2 - o.x1 - o.x2) / 2) > 0.12::DOUBLE * greatest(o.x2 - o.x1, 1) OR abs((r.y1 + r.y2 - o.y1 - o.y2) / 2) > 0.12::DOUBLE * greatest(o.y2 - o.y1, 1) OR NOT ((r.x2 - r.x1) / greatest(o.x2 - o.x1, 1) BETWEEN 0.8::DOUBLE AND 1.25) OR NOT ((r.y2 - r.y1) / greatest(o.y2 - o.y1, 1) BETWEEN 0.8::DOUBLE AND 1.25)),
marked AS (SELECT k.*, l.old IS NULL OR NOT EXISTS (SELECT 1 FROM risk b WHERE b.vec_id = l.old AND b.risk = k.risk) AS fresh FROM risk k LEFT JOIN link l ON l.vec_id = k.vec_id)
SELECT vec_id, coalesce(string_agg(risk, '|' ORDER BY risk), '') AS risks, coalesce(string_agg(risk, '|' ORDER BY risk) FILTER (fresh), '') AS fresh FROM fr LEFT JOIN marked USING (vec_id) GROUP BY vec_id""",
)
def sal_risks(t: Tables) -> DataFrame:
    d = risks(asked(t), F.col("vec_id") % 20 / 100, F.col("vec_id") % 9 / 20)
    return d.select("vec_id", F.array_join("risks", "|").alias("risks"), F.array_join("fresh", "|").alias("fresh"))


# Evidence of masks, and tracks that are not settled.


def mask_evidence(measured: DataFrame, oldest: float = 0.1, most: float = 0.08) -> DataFrame:
    """measured (video, measurement, frame, ts, scene, track, geometry: four numbers or null) with what each mask's history says.

    measurement numbers the video's measured frames; a track goes on where it is in the one before, of the same scene and at most `oldest`
    seconds ago.  seen: measured in a row; observations: those in a row whose geometry changed by at most `most`; change: the
    largest of the four (1 without a mask before); stable: two such in a row.  Without a geometry, or an identity, nothing goes on; without
    a geometry there is no evidence.
    """
    w = Window.partitionBy("video", "track").orderBy("measurement")
    old = F.lag(F.struct("measurement", "frame", "ts", "scene", "geometry")).over(w)
    d = measured.withColumn("_old", old)
    since = F.col("ts") - F.col("_old.ts")
    on = (F.col("_old.measurement") == F.col("measurement") - 1) & F.col("track").isNotNull() & (F.col("_old.scene") == F.col("scene")) & (F.col("frame") > F.col("_old.frame")) & (since > 0) & (since <= oldest + 1e-9)
    d = d.withColumn("_on", F.coalesce(on, F.lit(False)))
    change = F.array_max(F.zip_with("geometry", "_old.geometry", lambda a, b: F.abs(a - b)))
    d = d.withColumn("change", F.when(F.col("geometry").isNotNull(), F.when(F.col("_on") & F.col("_old.geometry").isNotNull(), change).otherwise(1.0)))
    d = d.withColumn("_same", F.coalesce(F.col("_on") & F.col("_old.geometry").isNotNull() & (F.col("change") <= most), F.lit(False)))
    d = d.withColumns({"_run": F.sum((~F.col("_on")).cast("long")).over(w), "_kept": F.sum((~F.col("_same")).cast("long")).over(w)})
    count = lambda island: F.when(F.col("track").isNull(), 1).otherwise(F.count("*").over(Window.partitionBy("video", "track", island).orderBy("measurement"))).cast("long")
    some = F.col("geometry").isNotNull()
    d = d.withColumns({"seen": count("_run"), "observations": F.when(some, count("_kept"))})
    return d.withColumn("stable", F.when(some, F.col("_same"))).drop("_old", "_on", "_same", "_run", "_kept")


@query(
    "trk_mask_evidence",
    TRACKS.replace("WITH fr", "WITH RECURSIVE fr", 1)
    + f""", num AS (SELECT vec_id, video, f, f / 30 AS ts, f // 17 AS scene, row_number() OVER (PARTITION BY video ORDER BY f) AS m FROM fr WHERE f % 4 <> 3),
geo AS (SELECT t.vec_id, t.j, n.video, n.f, n.ts, n.scene, n.m, t.track, CASE WHEN (t.vec_id + j) % 9 > 0 THEN [0.5::DOUBLE + (t.vec_id * 7 + j * 3) % 10 / 100, 0.4::DOUBLE + (t.vec_id % 6) / 100, 0.45::DOUBLE + (t.vec_id % 11) / 100, 0.1::DOUBLE] END AS g FROM tr t JOIN num n USING (vec_id)),
walk AS (SELECT *, CAST(1 AS BIGINT) AS seen, CASE WHEN g IS NOT NULL THEN 1.0::DOUBLE END AS change, CASE WHEN g IS NOT NULL THEN CAST(1 AS BIGINT) END AS obs, CASE WHEN g IS NOT NULL THEN false END AS stable FROM geo a WHERE NOT EXISTS (SELECT 1 FROM geo b WHERE b.video = a.video AND b.m = a.m - 1 AND b.track = a.track AND b.scene = a.scene AND a.ts - b.ts <= 0.1::DOUBLE + 1e-9)
UNION ALL SELECT vec_id, j, video, f, ts, scene, m, track, g, seen + 1, d, CASE WHEN g IS NOT NULL THEN CASE WHEN d <= 0.08::DOUBLE AND both_g THEN obs + 1 ELSE 1 END END, CASE WHEN g IS NOT NULL THEN d <= 0.08::DOUBLE AND both_g END FROM (SELECT a.*, w.seen, w.obs, w.g IS NOT NULL AS both_g, CASE WHEN a.g IS NULL THEN NULL WHEN w.g IS NULL THEN 1.0::DOUBLE ELSE greatest(abs(a.g[1] - w.g[1]), abs(a.g[2] - w.g[2]), abs(a.g[3] - w.g[3]), abs(a.g[4] - w.g[4])) END AS d FROM walk w JOIN geo a ON a.video = w.video AND a.m = w.m + 1 AND a.track = w.track AND a.scene = w.scene AND a.ts - w.ts <= 0.1::DOUBLE + 1e-9))
SELECT vec_id, j, track, seen, {Q.format('change')} AS change_q, obs, stable FROM walk""",
)
def trk_mask_evidence(t: Tables) -> DataFrame:
    n, x = F.col("vec_id"), F.col("x")
    d = sights(t).filter("frame % 4 <> 3").withColumn("measurement", F.row_number().over(Window.partitionBy("video").orderBy("frame")).cast("long"))
    d = d.select("vec_id", "video", "frame", (F.col("frame") / 30).alias("ts"), F.floor(F.col("frame") / 17).alias("scene"), "measurement", F.explode("tracks").alias("x"))
    geometry = F.when((n + x["row"]) % 9 > 0, F.array(0.5 + (n * 7 + x["row"] * 3) % 10 / 100, 0.4 + n % 6 / 100, 0.45 + n % 11 / 100, F.lit(0.1)))
    e = mask_evidence(d.withColumns({"track": x["track"], "row": x["row"], "geometry": geometry}))
    return e.select("vec_id", F.col("row").alias("j"), "track", "seen", q6(F.col("change")).alias("change_q"), F.col("observations").alias("obs"), "stable")


def meets(a: Column, b: Column) -> Column:
    return (F.least(a["x2"], b["x2"]) >= F.greatest(a["x1"], b["x1"])) & (F.least(a["y2"], b["y2"]) >= F.greatest(a["y1"], b["y1"]))


def unsettled(tracked: Column, lost: Column, observed: Column, primary: Column, everyone: Column, careful: Column, frame_area: Column) -> Column:
    """Why the next frame must be detected: reason (null: it need not), and relief: small, distant, established tracks that do not count.

    tracked: array of track, activated, box, envelope (null: unsure), measured (in a row); lost: array of track, box, envelope; observed: array of
    track, box; primary: the track followed; everyone: whether all tracks count alike; careful: the profile that adds no rules for
    bystanders.  Lost and tracked ones are judged in their order, and the first that stands against it decides.
    """
    ids = lambda a: F.transform(a, lambda t: t["track"])
    none = F.array().cast("array<bigint>")

    def told(reason: Column | str | None, relief: Column = none) -> Column:
        return _struct(reason=reason if isinstance(reason, Column) else F.lit(reason).cast("string"), relief=relief)

    unsure = F.exists(tracked, lambda t: ~t["activated"])
    changed = (F.size(F.array_except(ids(tracked), ids(observed))) > 0) | (F.size(F.array_except(ids(observed), ids(tracked))) > 0)
    all_ = F.when(F.size(lost) > 0, "all_lost_tracks").when(unsure, "all_unconfirmed_tracks").when(changed, "all_track_set_changed")
    own = F.get(F.filter(tracked, lambda t: t["track"] == primary), F.lit(0))
    doubled = (F.size(F.array_distinct(ids(tracked))) < F.size(tracked)) | (F.size(F.array_distinct(ids(observed))) < F.size(observed)) | F.exists(ids(observed), lambda i: i.isNull())
    gone = own.isNull() | ~F.exists(observed, lambda t: t["track"] == primary) | F.exists(lost, lambda t: t["track"] == primary)
    early = (
        F.when(primary.isNull(), "primary_unselected")
        .when(doubled, "ambiguous_track_ids")
        .when(gone, "primary_missing_or_lost")
        .when(~own["activated"], "primary_unconfirmed")
        .when(unsure, "secondary_unconfirmed")
        .when(F.size(F.array_except(ids(tracked), ids(observed))) > 0, "secondary_new_or_unreported")
        .when(F.size(F.array_except(ids(observed), ids(tracked))) > 0, "secondary_missing")
    )

    def guarded(p: Column) -> Column:
        b, e = p["box"], p["envelope"]
        gx, gy = 0.5 * (b["x2"] - b["x1"]), 0.5 * (b["y2"] - b["y1"])
        return let(_struct(zone=_struct(x1=e["x1"] - gx, y1=e["y1"] - gy, x2=e["x2"] + gx, y2=e["y2"] + gy), area=(b["x2"] - b["x1"]) * (b["y2"] - b["y1"])), judged)

    plain = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])

    def judged(g: Column) -> Column:
        def away(t: Column) -> Column:
            large = ~careful & ((plain(t["box"]) >= 0.35 * g["area"]) | (plain(t["box"]) >= 0.04 * frame_area))
            return F.when(t["envelope"].isNull(), "secondary_lost_uncertain").when(meets(t["envelope"], g["zone"]), "secondary_lost_near_primary").when(large, "secondary_lost_prominent")

        first = F.get(F.filter(F.transform(lost, away), lambda r: r.isNotNull()), F.lit(0))
        others = F.filter(tracked, lambda t: t["track"] != primary)
        fresh = ~careful & F.exists(others, lambda t: F.coalesce(t["measured"], F.lit(0)) < 2)
        seen = lambda t: plain(F.get(F.filter(observed, lambda o: o["track"] == t["track"]), F.lit(0))["box"])
        small = F.filter(others, lambda t: (seen(t) < 0.35 * g["area"]) & (seen(t) < 0.04 * frame_area) & t["envelope"].isNotNull() & ~meets(t["envelope"], g["zone"]))
        return F.when(first.isNotNull(), told(first)).when(fresh, told("secondary_new_measurement")).when(careful, told(None)).otherwise(told(None, ids(small)))

    alone = (F.size(lost) == 0) & (F.size(tracked) == 1)
    rest = F.when(early.isNotNull(), told(early)).when(alone, told(None)).when(own["envelope"].isNull(), told("primary_uncertain_motion")).otherwise(let(own, guarded))
    return F.when(everyone, told(all_)).otherwise(rest)


@query(
    "trk_unsettled",
    TRACKS
    + """, ask AS (SELECT *, f % 10 = 9 AS everyone, (f // 5) % 4 = 3 AS careful, CASE WHEN f % 13 > 0 THEN 10 * video END AS prim FROM fr),
obs AS (SELECT vec_id, j, CASE WHEN vec_id % 16 = 3 AND j = 1 THEN 10 * video ELSE track END AS track, x1, y1, x1 + (x2 - x1) / CASE WHEN j > 0 THEN 4 ELSE 1 END AS x2, y1 + (y2 - y1) / CASE WHEN j > 0 THEN 4 ELSE 1 END AS y2 FROM tr),
nat AS (SELECT vec_id, j, video, CASE WHEN vec_id % 14 = 5 AND j = 1 THEN 10 * video + 8 ELSE 10 * video + j END AS track, (vec_id * 3 + j) % 15 > 0 AS act, x1, y1, x1 + (x2 - x1) / CASE WHEN j > 0 THEN 4 ELSE 1 END AS x2, y1 + (y2 - y1) / CASE WHEN j > 0 THEN 4 ELSE 1 END AS y2, 10 + 10 * (vec_id % 4) AS g, (vec_id + j) % 12 > 0 AS env, CASE WHEN (vec_id + j) % 7 > 0 THEN 1 + (vec_id + j) % 7 END AS cnt FROM tr WHERE NOT (vec_id % 18 = 7 AND j = 1)),
los AS (SELECT vec_id, k, video, CASE WHEN vec_id % 24 = 1 THEN 10 * video ELSE 10 * video + 9 + k END AS track, x1, 600.0::DOUBLE AS y1, x1 + 40 + 50 * (vec_id % 4) AS x2, 600.0::DOUBLE + 60 + 100 * (vec_id % 3) AS y2, (vec_id + k) % 8 > 0 AS env FROM (SELECT vec_id, k, video, CAST(500 + 700 * k + vec_id % 90 AS DOUBLE) AS x1 FROM fr, range(0, 2) AS s(k) WHERE k < CASE vec_id % 4 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN vec_id % 8 = 2 THEN 2 ELSE 0 END ELSE 0 END)),
o AS (SELECT vec_id, count(*) AS n, count(DISTINCT track) AS d, list(track) AS ids FROM obs GROUP BY vec_id), a AS (SELECT vec_id, count(*) AS n, count(DISTINCT track) AS d, list(track) AS ids, bool_and(act) AS sure FROM nat GROUP BY vec_id), l AS (SELECT vec_id, count(*) AS n, list(track) AS ids FROM los GROUP BY vec_id),
p AS (SELECT k.vec_id, t.act, t.env, t.x1 - g - 0.5 * (x2 - x1) AS zx1, t.y1 - g - 0.5 * (y2 - y1) AS zy1, t.x2 + g + 0.5 * (x2 - x1) AS zx2, t.y2 + g + 0.5 * (y2 - y1) AS zy2, (x2 - x1) * (y2 - y1) AS area FROM ask k JOIN nat t ON t.vec_id = k.vec_id AND t.track = k.prim),
lw AS (SELECT vec_id, min_by(why, k) AS why FROM (SELECT s.vec_id, s.k, CASE WHEN NOT s.env THEN 'secondary_lost_uncertain' WHEN least(x2 + 20, zx2) >= greatest(x1 - 20, zx1) AND least(y2 + 20, zy2) >= greatest(y1 - 20, zy1) THEN 'secondary_lost_near_primary' WHEN NOT careful AND ((x2 - x1) * (y2 - y1) >= 0.35::DOUBLE * area OR (x2 - x1) * (y2 - y1) >= 0.04::DOUBLE * 2073600) THEN 'secondary_lost_prominent' END AS why FROM los s JOIN p USING (vec_id) JOIN ask USING (vec_id)) WHERE why IS NOT NULL GROUP BY vec_id),
nw AS (SELECT n.vec_id, bool_or(coalesce(cnt, 0) < 2) AS fresh FROM nat n JOIN ask k ON k.vec_id = n.vec_id AND n.track <> k.prim GROUP BY n.vec_id),
rf AS (SELECT n.vec_id, string_agg(CAST(n.track AS VARCHAR), ',' ORDER BY n.j) AS ids FROM nat n JOIN ask k ON k.vec_id = n.vec_id AND n.track <> k.prim JOIN p ON p.vec_id = n.vec_id JOIN obs o ON o.vec_id = n.vec_id AND o.track = n.track WHERE (o.x2 - o.x1) * (o.y2 - o.y1) < 0.35::DOUBLE * area AND (o.x2 - o.x1) * (o.y2 - o.y1) < 0.04::DOUBLE * 2073600 AND n.env AND NOT (least(n.x2 + g, zx2) >= greatest(n.x1 - g, zx1) AND least(n.y2 + g, zy2) >= greatest(n.y1 - g, zy1)) GROUP BY n.vec_id),
told AS (SELECT k.vec_id, careful, everyone, coalesce(l.n, 0) = 0 AND a.n = 1 AS alone, CASE WHEN everyone THEN CASE WHEN l.n IS NOT NULL THEN 'all_lost_tracks' WHEN NOT a.sure THEN 'all_unconfirmed_tracks' WHEN coalesce(list_sort(list_distinct(o.ids)) IS DISTINCT FROM list_sort(list_distinct(a.ids)), true) OR o.d < o.n AND list_contains(list_transform(o.ids, lambda x: x IS NULL), true) THEN CASE WHEN o.n IS NULL AND a.n IS NULL THEN NULL ELSE 'all_track_set_changed' END END
WHEN prim IS NULL THEN 'primary_unselected' WHEN coalesce(a.d < a.n, false) OR coalesce(o.d < o.n, false) THEN 'ambiguous_track_ids' WHEN p.vec_id IS NULL OR NOT list_contains(coalesce(o.ids, []), prim) OR list_contains(coalesce(l.ids, []), prim) THEN 'primary_missing_or_lost' WHEN NOT p.act THEN 'primary_unconfirmed' WHEN NOT a.sure THEN 'secondary_unconfirmed'
WHEN len(list_filter(a.ids, lambda x: NOT list_contains(o.ids, x))) > 0 THEN 'secondary_new_or_unreported' WHEN len(list_filter(o.ids, lambda x: NOT list_contains(a.ids, x))) > 0 THEN 'secondary_missing' WHEN l.n IS NULL AND a.n = 1 THEN NULL WHEN NOT p.env THEN 'primary_uncertain_motion' WHEN lw.why IS NOT NULL THEN lw.why WHEN NOT careful AND coalesce(fresh, false) THEN 'secondary_new_measurement' END AS reason
FROM ask k LEFT JOIN o USING (vec_id) LEFT JOIN a USING (vec_id) LEFT JOIN l USING (vec_id) LEFT JOIN p USING (vec_id) LEFT JOIN lw USING (vec_id) LEFT JOIN nw USING (vec_id))
SELECT vec_id, reason, CASE WHEN reason IS NULL AND NOT everyone AND NOT careful AND NOT alone THEN coalesce(ids, '') ELSE '' END AS relief FROM told LEFT JOIN rf USING (vec_id)""",
)
def trk_unsettled(t: Tables) -> DataFrame:
    n, f, v = F.col("vec_id"), F.col("frame"), F.col("video")

    def shrunk(x: Column) -> Column:
        b, part = x["box"], F.when(x["row"] > 0, 4).otherwise(1)
        return _struct(x1=b["x1"], y1=b["y1"], x2=b["x1"] + (b["x2"] - b["x1"]) / part, y2=b["y1"] + (b["y2"] - b["y1"]) / part)

    grown = lambda b, g: _struct(x1=b["x1"] - g, y1=b["y1"] - g, x2=b["x2"] + g, y2=b["y2"] + g)
    observed = F.transform("tracks", lambda x: _struct(track=F.when((n % 16 == 3) & (x["row"] == 1), 10 * v).otherwise(x["track"]), box=shrunk(x)))

    def native(x: Column) -> Column:
        j = x["row"]
        return _struct(
            track=F.when((n % 14 == 5) & (j == 1), 10 * v + 8).otherwise(10 * v + j), activated=(n * 3 + j) % 15 > 0, box=shrunk(x), envelope=F.when((n + j) % 12 > 0, grown(shrunk(x), 10 + 10 * (n % 4))), measured=F.when((n + j) % 7 > 0, 1 + (n + j) % 7)
        )

    tracked = F.transform(F.filter("tracks", lambda x: ~((n % 18 == 7) & (x["row"] == 1))), native)

    def left(k: Column) -> Column:
        x1 = (500 + 700 * k + n % 90).cast("double")
        box = _struct(x1=x1, y1=F.lit(600.0), x2=x1 + 40 + 50 * (n % 4), y2=F.lit(600.0) + 60 + 100 * (n % 3))
        return _struct(track=F.when(n % 24 == 1, 10 * v).otherwise(10 * v + 9 + k), box=box, envelope=F.when((n + k) % 8 > 0, grown(box, 20)))

    lost = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long")), lambda k: k < F.when(n % 4 == 1, 1).when(n % 8 == 2, 2).otherwise(0)), left)
    d = sights(t).withColumns({"observed": observed, "tracked": tracked, "lost": lost})
    why = unsettled(F.col("tracked"), F.col("lost"), F.col("observed"), F.when(f % 13 > 0, 10 * v), f % 10 == 9, F.floor(f / 5) % 4 == 3, F.lit(1920.0 * 1080.0))
    d = d.withColumn("why", why)
    return d.select("vec_id", F.col("why.reason").alias("reason"), F.array_join(F.col("why.relief").cast("array<string>"), ",").alias("relief"))


# People whose pose may stand for a new one.


def prepared(frames: DataFrame) -> DataFrame:
    """frames (video, frame, ts, scene, frame_w, frame_h, cut, missed, pair_frames, tracks) with people and what the pose cache makes of the frame.

    cleared: all kept poses are dropped (a cut, a step back, another scene or shape); identities_stable: the same known people as in the frame directly
    before; safe: nothing about the state forbids to go on with old poses.
    """
    w = Window.partitionBy("video").orderBy("no")
    ids = F.array_sort(F.array_distinct(F.transform("people", lambda p: p["track"])))
    d = frames.withColumn("people", F.filter("tracks", lambda t: t["cls"] == 0)).withColumn("_ids", ids)
    d = d.withColumn("_old", F.lag(F.struct("frame", "ts", "scene", "frame_w", "frame_h", "_ids")).over(w))
    same = (F.col("_old.scene") == F.col("scene")) & (F.col("_old.frame_w") == F.col("frame_w")) & (F.col("_old.frame_h") == F.col("frame_h"))
    goes_on = (F.col("frame") > F.col("_old.frame")) & (F.col("ts") > F.col("_old.ts")) & same
    known = ~F.exists("_ids", lambda i: i.isNull())
    stable = ~F.col("cut") & goes_on & (F.col("_old.frame") + 1 == F.col("frame")) & (F.col("_old._ids") == F.col("_ids")) & known
    return d.withColumns({
        "cleared": F.col("cut") | F.coalesce(F.col("_old").isNotNull() & ~goes_on, F.lit(False)),
        "identities_stable": F.coalesce(F.col("_old").isNotNull() & stable, F.lit(False)),
        "safe": ~(F.col("cut") | (F.col("missed") > 0) | (F.col("pair_frames") > 0)),
    }).drop("_ids", "_old")


PREPARED = TRACKS + """, st AS (SELECT vec_id, video, f AS no, f - CASE WHEN f % 21 = 0 THEN 2 ELSE 0 END AS frame, f / 30 AS ts, f // 9 AS scene, CASE WHEN f % 37 = 0 THEN 1080 ELSE 1920 END AS w, f % 14 = 0 AS cut, CASE WHEN f % 8 = 5 THEN 1 ELSE 0 END AS missed, CASE WHEN f % 15 = 4 THEN 2 ELSE 0 END AS pairf FROM fr),
ids AS (SELECT vec_id, list_sort(list(DISTINCT track) FILTER (track IS NOT NULL)) AS known, bool_or(track IS NULL) AS anon FROM tr WHERE cls = 0 GROUP BY vec_id),
seq AS (SELECT s.*, coalesce(known, []) AS known, coalesce(anon, false) AS anon, lag(frame) OVER w AS of, lag(ts) OVER w AS ot, lag(scene) OVER w AS os, lag(s.w) OVER w AS ow, lag(coalesce(known, [])) OVER w AS ok, lag(coalesce(anon, false)) OVER w AS oa FROM st s LEFT JOIN ids USING (vec_id) WINDOW w AS (PARTITION BY video ORDER BY no)),
prep AS (SELECT *, cut OR (of IS NOT NULL AND NOT (frame > of AND ts > ot AND os = scene AND ow = w)) AS cleared, coalesce(of IS NOT NULL AND NOT cut AND frame = of + 1 AND ts > ot AND os = scene AND ow = w AND ok = known AND NOT anon AND NOT oa, false) AS stable, NOT cut AND missed = 0 AND pairf = 0 AS safe FROM seq)
"""


def states(t: Tables) -> DataFrame:
    f = F.col("no")
    d = sights(t).withColumnRenamed("frame", "no")
    return d.withColumns({
        "frame": f - F.when(f % 21 == 0, 2).otherwise(0), "ts": f / 30, "scene": F.floor(f / 9), "frame_w": F.when(f % 37 == 0, 1080).otherwise(1920), "frame_h": F.lit(1080),
        "cut": f % 14 == 0, "missed": F.when(f % 8 == 5, 1).otherwise(0), "pair_frames": F.when(f % 15 == 4, 2).otherwise(0),
    })


@query("pos_prepare", PREPARED + "SELECT vec_id, cleared, stable, safe FROM prep")
def pos_prepare(t: Tables) -> DataFrame:
    return prepared(states(t)).select("vec_id", "cleared", F.col("identities_stable").alias("stable"), "safe")


def primary_person(d: DataFrame, fps: int, adaptive: bool = True) -> Column:
    """The row of the one person whose pose is asked for alone; null where all are.

    d: people (row, track, confidence, box, reliable, trusted), before (ids of the people looked at last, sorted), safe (no cut, no misses, no pair), followed,
    followed_cls (the locked or tracked subject), locked, since (frames since the subject changed).
    """
    ids = F.array_sort(F.array_distinct(F.transform("people", lambda p: p["track"])))
    steady = (F.size("people") > 0) & F.col("before").isNotNull() & (F.col("before") == ids) & ~F.exists(ids, lambda i: i.isNull()) & F.col("safe")
    own = F.get(F.filter("people", lambda p: p["track"] == F.col("followed")), F.lit(0))
    prominence = lambda p: p["confidence"] * F.greatest(F.lit(0.0), p["box"]["x2"] - p["box"]["x1"]) * F.greatest(F.lit(0.0), p["box"]["y2"] - p["box"]["y1"])

    def judged(p: Column) -> Column:
        other = lambda f: F.exists("people", lambda o: (o["row"] != p["row"]) & f(o))
        near = other(lambda o: overlap(p["box"], o["box"]) > 0.15)
        rival = (~F.col("locked") | F.lit(adaptive)) & other(lambda o: prominence(o) * 1.5 >= prominence(p))
        held = F.col("locked") | (F.col("since") >= max(2, round(fps * 0.1)))
        ok = (p["confidence"] >= 0.5) & F.forall("people", lambda o: o["reliable"]) & ~near & held & ~rival & p["trusted"]
        return F.when(ok, p["row"])

    return F.when(F.coalesce(steady & (F.col("followed_cls") == 0), F.lit(False)), let(own, judged))


@query(
    "pos_primary",
    PREPARED
    + """, ask AS (SELECT p.*, lag(known) OVER (PARTITION BY video ORDER BY no) AS bk, lag(anon) OVER (PARTITION BY video ORDER BY no) AS ba, CASE WHEN no % 5 > 0 THEN 10 * video END AS followed, CASE WHEN no % 11 = 2 THEN 16 ELSE 0 END AS fcls, (no // 10) % 2 = 1 AS locked, no % 7 AS since FROM prep p),
own AS (SELECT a.*, t.j, t.conf, t.x1, t.y1, t.x2, t.y2, t.pose_ok FROM ask a JOIN tr t ON t.vec_id = a.vec_id AND t.cls = 0 AND t.track = a.followed WHERE bk IS NOT NULL AND bk = known AND NOT anon AND NOT ba AND safe AND fcls = 0),
vs AS (SELECT o.vec_id, bool_and(t.reliable) AS sure, bool_or(t.j <> o.j AND greatest(0, least(o.x2, t.x2) - greatest(o.x1, t.x1)) * greatest(0, least(o.y2, t.y2) - greatest(o.y1, t.y1)) / greatest(1, (o.x2 - o.x1) * (o.y2 - o.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - greatest(0, least(o.x2, t.x2) - greatest(o.x1, t.x1)) * greatest(0, least(o.y2, t.y2) - greatest(o.y1, t.y1))) > 0.15::DOUBLE) AS near, bool_or(t.j <> o.j AND t.conf * (t.x2 - t.x1) * (t.y2 - t.y1) * 1.5 >= o.conf * (o.x2 - o.x1) * (o.y2 - o.y1)) AS rival FROM own o JOIN tr t ON t.vec_id = o.vec_id AND t.cls = 0 GROUP BY o.vec_id)
SELECT a.vec_id, CASE WHEN o.conf >= 0.5 AND sure AND NOT near AND NOT rival AND (o.locked OR o.since >= 3) AND o.pose_ok THEN o.j END AS row FROM ask a LEFT JOIN own o USING (vec_id) LEFT JOIN vs USING (vec_id)""",
)
def pos_primary(t: Tables) -> DataFrame:
    f, v = F.col("no"), F.col("video")
    d = prepared(states(t))
    ids = F.array_sort(F.array_distinct(F.transform("people", lambda p: p["track"])))
    d = d.withColumn("before", F.lag(ids).over(Window.partitionBy("video").orderBy("no")))
    people = F.transform("people", lambda p: _struct(row=p["row"], track=p["track"], confidence=p["confidence"], box=p["box"], reliable=p["reliable"], trusted=p["pose_ok"]))
    d = d.withColumns({"people": people, "followed": F.when(f % 5 > 0, 10 * v), "followed_cls": F.when(f % 11 == 2, 16).otherwise(0), "locked": F.floor(f / 10) % 2 == 1, "since": f % 7})
    return d.select("vec_id", primary_person(d, 30).alias("row"))
