"""When a frame is detected anew and when its tracks are carried on: a fold over frames, fed by what other operators say of each frame."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import q6
from ..plans.catalog import Tables, query
from .folds import fold
from .routing import TRACKS, sights

Q = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"


@dataclass
class Policy:
    """Limits of a schedule: the longest gap asked for, how old a measurement may get, and the profile."""

    gap: int = 6
    oldest: float = 0.1
    fps: float = 30.0
    profile: str = "balanced"

    @property
    def longest(self) -> int:
        return min(self.gap, 3 if self.profile == "conservative" else self.gap, max(1, math.floor(self.oldest * self.fps + 1e-9)))


@dataclass
class Schedule:
    """What is known of a video up to a frame."""

    frame: int | None = None
    ts: float = 0.0
    scene: int = 0
    measured: list[dict] = field(default_factory=list)
    at: tuple[int, float] = (0, 0.0)
    since: float | None = None
    interval: int = 1
    force: str | None = None
    primary: int | None = None


def steady(old: list[dict], new: list[dict]) -> bool:
    """Whether two measurements hold the same known tracks, sure and hardly moved or resized."""
    before = {t["track"]: t for t in old}
    if not new or None in before or {t["track"] for t in new} != set(before):
        return False
    for t in new:
        a, b = before[t["track"]], t
        w, h = max(a["x2"] - a["x1"], 1), max(a["y2"] - a["y1"], 1)
        moved = max(abs(b["x1"] - a["x1"]) / w, abs(b["y1"] - a["y1"]) / h, abs(b["x2"] - a["x2"]) / w, abs(b["y2"] - a["y2"]) / h)
        if t["confidence"] < 0.45 or moved > 0.12 or max(abs((b["x2"] - b["x1"]) / w - 1), abs((b["y2"] - b["y1"]) / h - 1)) > 0.08:
            return False
    return True


def decide(s: Schedule, row: dict, policy: Policy) -> str | None:
    """Why this frame is detected; None to carry its tracks on."""
    if policy.gap == 1:
        return "every_frame"
    if s.frame is None:
        return "initial"
    if not s.measured:
        return "no_tracks"
    if s.force or row["gate"]:
        return s.force or row["gate"]
    if row["changed"]:
        return "frame_change"
    if row["unsure"]:
        return "low_confidence"
    if row["ts"] - s.at[1] >= policy.oldest - 1e-9:
        return "age_limit"
    if s.interval > 3 and not row["extendable"]:
        s.interval = 3
    if row["frame"] - s.at[0] >= s.interval:
        return "scheduled"
    return "uncertain_motion" if row["uncertain"] else row["flow"]


def step(s: Schedule, row: dict, policy: Policy) -> tuple[Schedule, tuple]:
    if s.frame is not None and (row["frame"] != s.frame + 1 or row["ts"] <= s.ts or row["scene"] != s.scene):
        s = Schedule()
    reason = decide(s, row, policy)
    if reason is not None:
        if reason not in ("scheduled", "age_limit", "every_frame"):
            s.since, s.interval = None, 1
        if s.since is None or not steady(s.measured, row["tracks"]):
            s.since = row["ts"]
        lasted = row["ts"] - s.since
        s.interval = 3 if lasted >= 0.25 else 2 if lasted >= 0.1 else 1
        if policy.longest > 3 and row["extendable"]:
            s.interval = 6 if lasted >= (0.5 if policy.profile == "fast" else 1.0) else 4 if lasted >= 0.5 else s.interval
        s.interval = min(policy.longest, s.interval)
        s.measured, s.at, s.force = row["tracks"], (row["frame"], row["ts"]), None
    s.frame, s.ts, s.scene = row["frame"], row["ts"], row["scene"]
    out = (reason is not None, reason, s.interval, row["ts"] - s.at[1])
    # What the poses of this frame say about the next.
    if s.primary is not None and row["preferred"] != s.primary:
        s.force = "primary_changed"
    s.primary = row["preferred"]
    if row["preferred"] is not None and not row["present"]:
        s.force = "primary_missing"
    elif row["present"] and row["pose"] is not None:
        if row["pose"] == "weak_fresh":
            s.force = "weak_primary_pose"
        if not row["extendable"]:
            s.interval = min(s.interval, 3)
    return s, out


def schedule(frames: DataFrame, policy: Policy) -> DataFrame:
    """video, no, detected, reason (null: carried on), interval, age of the measurement.

    frames: video, no (their order), frame, ts, scene; tracks: what a detector would find (array of track, confidence, x1 to y2); gate: why the
    tracks alone ask for it (unsettled_tracks, unsupported_tracker; null); changed: the picture; unsure, uncertain: confidence and motion
    of tracks; flow: why points do not agree; extendable: pose and mask allow long gaps; preferred: the track followed, present: it is
    there, pose: of it, reliable, weak, weak_fresh (weak though measured now, and no mask to go by) or null (no person).
    A skipped frame, a step back in time or another scene starts anew.
    """
    return fold(frames, ["video"], ["no"], "detected boolean, reason string, interval int, age double", Schedule, lambda s, row: step(s, row, policy))


#: Frames with a track or two, in numbers that skip one now and then, and what is said of them.
FRAMES_OF = TRACKS.replace("WITH fr", "WITH RECURSIVE fr", 1) + """, list_of AS (SELECT vec_id, list({'track': track, 'confidence': CASE WHEN conf < 0.35 THEN conf ELSE 0.8::DOUBLE END, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY j) AS tracks FROM tr WHERE j < 1 + (f // 24) % 2 GROUP BY vec_id),
rows AS MATERIALIZED (SELECT fr.*, coalesce(tracks, []) AS tracks, f + f // 33 AS frame, (f + f // 33) / 30 AS ts, f // 40 AS scene, CASE WHEN vec_id % 47 = 0 THEN 'unsettled_tracks' END AS gate, vec_id % 41 = 0 AS changed, vec_id % 61 = 0 AS unsure, vec_id % 37 = 0 AS uncertain, CASE WHEN vec_id % 29 = 0 THEN 'flow_jump' WHEN vec_id % 43 = 0 THEN 'flow_low_quality' END AS flow, vec_id % 9 > 0 AS ext,
CASE WHEN f > 3 THEN 10 * video + (f // 30) % 2 END AS preferred, f > 3 AND f % 23 > 0 AS present, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 53 = 1 THEN 'weak_fresh' WHEN vec_id % 5 = 1 THEN 'weak' ELSE 'reliable' END AS pose FROM fr LEFT JOIN list_of USING (vec_id)),
run AS (SELECT video, f, frame, ts, scene, tracks AS mt, frame AS mf, ts AS mts, ts AS since, 1 AS told, 1 AS itv, CASE WHEN preferred IS NOT NULL AND NOT present THEN 'primary_missing' WHEN present AND pose = 'weak_fresh' THEN 'weak_primary_pose' END AS force, preferred AS prim, 'initial' AS reason FROM rows WHERE f = 1
UNION ALL SELECT video, f, frame, ts, scene, CASE WHEN reason IS NULL THEN mt ELSE tracks END, CASE WHEN reason IS NULL THEN mf ELSE frame END, CASE WHEN reason IS NULL THEN mts ELSE ts END, since, told, CASE WHEN present AND pose IS NOT NULL AND NOT ext THEN least(told, 3) ELSE told END,
CASE WHEN preferred IS NOT NULL AND NOT present THEN 'primary_missing' WHEN present AND pose = 'weak_fresh' THEN 'weak_primary_pose' WHEN prim IS NOT NULL AND preferred IS DISTINCT FROM prim THEN 'primary_changed' END, preferred, reason
FROM (SELECT *, CASE WHEN reason IS NULL THEN capped ELSE least(6, CASE WHEN ext AND ts - since >= 1.0 THEN 6 WHEN ext AND ts - since >= 0.5 THEN 4 WHEN ts - since >= 0.25 THEN 3 WHEN ts - since >= 0.1::DOUBLE THEN 2 ELSE 1 END) END AS told
FROM (SELECT * REPLACE (CASE WHEN reason IS NULL THEN since WHEN reason IN ('scheduled', 'age_limit') AND since IS NOT NULL AND steady THEN since ELSE ts END AS since) FROM (SELECT *, len(tracks) > 0 AND len(list_filter(mt, lambda o: o.track IS NULL)) = 0 AND list_sort(list_distinct(list_transform(tracks, lambda t: t.track))) = list_sort(list_distinct(list_transform(mt, lambda o: o.track))) AND len(list_filter(tracks, lambda t: t.track IS NULL)) = 0
AND len(list_filter(tracks, lambda t: t.confidence < 0.45::DOUBLE OR len(list_filter(mt, lambda o: o.track = t.track AND greatest(abs(t.x1 - o.x1) / greatest(o.x2 - o.x1, 1), abs(t.y1 - o.y1) / greatest(o.y2 - o.y1, 1), abs(t.x2 - o.x2) / greatest(o.x2 - o.x1, 1), abs(t.y2 - o.y2) / greatest(o.y2 - o.y1, 1)) <= 0.12::DOUBLE AND greatest(abs((t.x2 - t.x1) / greatest(o.x2 - o.x1, 1) - 1), abs((t.y2 - t.y1) / greatest(o.y2 - o.y1, 1) - 1)) <= 0.08::DOUBLE)) = 0)) = 0 AS steady
FROM (SELECT *, CASE WHEN fresh THEN 'initial' WHEN len(mt) = 0 THEN 'no_tracks' WHEN force IS NOT NULL THEN force WHEN gate IS NOT NULL THEN gate WHEN changed THEN 'frame_change' WHEN unsure THEN 'low_confidence' WHEN ts - mts >= 0.25 - 1e-9::DOUBLE THEN 'age_limit' WHEN frame - mf >= capped THEN 'scheduled' WHEN uncertain THEN 'uncertain_motion' ELSE flow END AS reason
FROM (SELECT n.*, r.mf, r.mts, r.since, CASE WHEN r.itv > 3 AND NOT n.ext THEN 3 ELSE r.itv END AS capped, r.force, n.frame <> r.frame + 1 OR n.ts <= r.ts OR n.scene <> r.scene AS fresh, CASE WHEN n.frame <> r.frame + 1 OR n.ts <= r.ts OR n.scene <> r.scene THEN [] ELSE r.mt END AS mt, CASE WHEN n.frame <> r.frame + 1 OR n.ts <= r.ts OR n.scene <> r.scene THEN NULL ELSE r.prim END AS prim FROM run r JOIN rows n ON n.video = r.video AND n.f = r.f + 1))))))
"""


def said(t: Tables) -> DataFrame:
    """The same as DataFrame."""
    n, f, v = F.col("vec_id"), F.col("no"), F.col("video")
    d = sights(t).withColumnRenamed("frame", "no")
    kept = F.filter("tracks", lambda x: x["row"] < 1 + F.floor(f / 24) % 2)
    tracks = F.transform(kept, lambda x: F.struct(x["track"].alias("track"), F.when(x["confidence"] < 0.35, x["confidence"]).otherwise(0.8).alias("confidence"), *[x["box"][c].alias(c) for c in ("x1", "y1", "x2", "y2")]))
    frame = f + F.floor(f / 33)
    pose = F.when(n % 5 == 0, None).when(n % 53 == 1, "weak_fresh").when(n % 5 == 1, "weak").otherwise("reliable")
    return d.select(
        "video", "no", frame.alias("frame"), (frame / 30).alias("ts"), F.floor(f / 40).alias("scene"), tracks.alias("tracks"), F.when(n % 47 == 0, "unsettled_tracks").alias("gate"), (n % 41 == 0).alias("changed"), (n % 61 == 0).alias("unsure"), (n % 37 == 0).alias("uncertain"),
        F.when(n % 29 == 0, "flow_jump").when(n % 43 == 0, "flow_low_quality").alias("flow"), (n % 9 > 0).alias("extendable"), F.when(f > 3, 10 * v + F.floor(f / 30) % 2).alias("preferred"), ((f > 3) & (f % 23 > 0)).alias("present"), pose.alias("pose"),
    )


@query("trk_feedback", FRAMES_OF + f"SELECT video, f AS no, reason IS NOT NULL AS detected, reason, told AS interval, {Q.format('ts - mts')} AS age_q FROM run")
def trk_feedback(t: Tables) -> DataFrame:
    return schedule(said(t), Policy(gap=6, oldest=0.25)).select("video", "no", "detected", "reason", "interval", q6(F.col("age")).alias("age_q"))


def carried(tracks: Column, moves: Column, relief: Column, middles: Column) -> Column:
    """The tracks of a frame that is not detected: moved as their points agree, trusted as far as these do.

    tracks: array of track, box, trust, mask (size, cx, cy, top, or null); moves: array of track, dx, dy, quality; relief: tracks that were not
    measured by points, which go to the middle that their filter predicts (middles: array of track, x, y) and are not trusted.
    Null where a track has neither: the frame has to be detected.
    """
    find = lambda a, t: F.get(F.filter(a, lambda m: m["track"] == t["track"]), F.lit(0))

    def move(t: Column) -> Column:
        m, p, b = find(moves, t), find(middles, t), t["box"]
        by_filter = F.when(F.array_contains(relief, t["track"]), F.struct((p["x"] - (b["x1"] + b["x2"]) / 2).alias("dx"), (p["y"] - (b["y1"] + b["y2"]) / 2).alias("dy"), F.lit(0.65).alias("quality")))
        return F.coalesce(F.when(m.isNotNull(), F.struct(m["dx"].alias("dx"), m["dy"].alias("dy"), m["quality"].alias("quality"))), by_filter)

    def moved(t: Column, d: Column) -> Column:
        b, k = t["box"], t["mask"]
        box = F.struct((b["x1"] + d["dx"]).alias("x1"), (b["y1"] + d["dy"]).alias("y1"), (b["x2"] + d["dx"]).alias("x2"), (b["y2"] + d["dy"]).alias("y2"))
        mask = F.when(k.isNotNull(), F.struct(k["size"].alias("size"), (k["cx"] + d["dx"]).alias("cx"), (k["cy"] + d["dy"]).alias("cy"), (k["top"] + d["dy"]).alias("top")))
        return F.struct(t["track"].alias("track"), box.alias("box"), F.least(t["trust"], d["quality"]).alias("trust"), mask.alias("mask"))

    paired = F.transform(tracks, lambda t: F.struct(t.alias("t"), move(t).alias("d")))
    return F.when(~F.exists(paired, lambda p: p["d"].isNull()), F.transform(paired, lambda p: moved(p["t"], p["d"])))


@query(
    "trk_predict",
    TRACKS
    + f""", mv AS (SELECT t.*, (vec_id % 9 - 4) / 2 AS mx, (vec_id % 7 - 3) / 4 AS my, (vec_id + j) % 4 > 0 AS flows, j > 0 AND vec_id % 3 > 0 AS rel, 1 - ((vec_id + j) % 5) / 16 AS trust, 0.75::DOUBLE + ((vec_id * 3 + j) % 4) / 16 AS quality, (vec_id + j) % 6 > 0 AS masked FROM tr t WHERE track IS NOT NULL),
d AS (SELECT *, CASE WHEN flows THEN mx + j ELSE 5 + vec_id % 3 END AS dx, CASE WHEN flows THEN my ELSE -2 END AS dy, bool_and(flows OR rel) OVER (PARTITION BY vec_id) AS ok FROM mv)
SELECT vec_id, j, {Q.format('x1 + dx')} AS x1, {Q.format('y2 + dy')} AS y2, {Q.format('least(trust, CASE WHEN flows THEN quality ELSE 0.65::DOUBLE END)')} AS trust_q, CASE WHEN masked THEN {Q.format('y1 + 3 + dy')} END AS top FROM d WHERE ok""",
)
def trk_predict(t: Tables) -> DataFrame:
    n = F.col("vec_id")
    known = F.filter("tracks", lambda x: x["track"].isNotNull())
    flows, rel = (lambda x: (n + x["row"]) % 4 > 0), (lambda x: (x["row"] > 0) & (n % 3 > 0))
    size = lambda b: F.lit(100.0)
    tracks = F.transform(known, lambda x: F.struct(x["track"].alias("track"), x["box"].alias("box"), (1 - (n + x["row"]) % 5 / 16).alias("trust"), F.when((n + x["row"]) % 6 > 0, F.struct(size(x).alias("size"), x["box"]["x1"].alias("cx"), x["box"]["y1"].alias("cy"), (x["box"]["y1"] + 3).alias("top"))).alias("mask")))
    moves = F.transform(F.filter(known, flows), lambda x: F.struct(x["track"].alias("track"), ((n % 9 - 4) / 2 + x["row"]).alias("dx"), ((n % 7 - 3) / 4).alias("dy"), (0.75 + (n * 3 + x["row"]) % 4 / 16).alias("quality")))
    relief = F.transform(F.filter(known, rel), lambda x: x["track"])
    middles = F.transform(known, lambda x: F.struct(x["track"].alias("track"), ((x["box"]["x1"] + x["box"]["x2"]) / 2 + 5 + n % 3).alias("x"), ((x["box"]["y1"] + x["box"]["y2"]) / 2 - 2).alias("y")))
    d = sights(t).withColumn("rows", F.transform(known, lambda x: x["row"])).withColumn("next", carried(tracks, moves, relief, middles))
    d = d.filter("next IS NOT NULL").select("vec_id", F.inline(F.arrays_zip("rows", "next")))
    return d.select("vec_id", F.col("rows").alias("j"), q6(F.col("next.box.x1")).alias("x1"), q6(F.col("next.box.y2")).alias("y2"), q6(F.col("next.trust")).alias("trust_q"), q6(F.col("next.mask.top")).alias("top"))


# Which look at the picture a frame gets.


@dataclass
class Tier:
    """What the router knows of a video: the frame before, steady frames so far, the tier, the last call of the network and what it left."""

    frame: int | None = None
    ts: float = 0.0
    scene: int = 0
    stable: int = 0
    cheap: int = 0
    tier: str | None = None
    asked: int | None = None
    cached: float | None = None


def route(s: Tier, row: dict, interval: int, oldest: float) -> tuple[Tier, tuple]:
    known = s.frame is not None
    if known and (row["scene"] != s.scene or row["frame"] <= s.frame or row["ts"] < s.ts):
        s, known = Tier(), False
    if row["urgent"]:
        s.stable = s.cheap = 0
        s.cached = None
    s.stable = s.stable + 1 if row["reliable"] and row["steady"] and known and not row["urgent"] else 0
    s.frame, s.ts, s.scene = row["frame"], row["ts"], row["scene"]

    def told(tier: str, reason: str, called: bool = False) -> tuple[Tier, tuple]:
        changed = s.tier is not None and tier != s.tier
        s.tier = tier
        return s, (tier, reason, called, changed)

    if s.stable >= 3:
        return told("pose_only", "stable_reliable_pose")
    enough = (row["reliable"] and not row["urgent"]) or row["compact"]
    s.cheap = s.cheap + 1 if enough else 0
    valid = s.cached is not None and 0 <= row["ts"] - s.cached < oldest and row["unchanged"]
    if enough:
        if s.tier == "deepgaze" and s.cheap < 3 and valid:
            return told("deepgaze", "settling_evidence")
        return told("handcrafted", "pose_stabilizing" if row["reliable"] else "cheap_evidence_sufficient")
    if not row["window"]:
        return told("handcrafted", "temporal_window")
    if valid:
        return told("deepgaze", "valid_neural_cache")
    if s.asked is not None and row["frame"] - s.asked < interval and not row["urgent"]:
        return told("handcrafted", "neural_cooldown")
    s.asked = row["frame"]
    if row["status"] != "predicted":
        return told("handcrafted", row["status"], True)
    s.cached = row["ts"]
    return told("deepgaze", row["reason"], True)


def tiers(frames: DataFrame, interval: int = 3, oldest: float = 0.35) -> DataFrame:
    """video, no, tier, reason, called (the network was), changed (the tier differs from the frame before).

    frames: video, no (their order), frame, ts, scene; reliable and reason (of subjects), urgent (a fresh risk), steady (subjects and picture since
    the frame before), compact (cheap_evidence), window (enough frames for the network), unchanged (since what it left last), status
    (predicted, or why the network gave nothing).  Three steady reliable frames need no look; a cheap map serves where it decides; the
    network is called at most every `interval` frames but for fresh risks, and what it left counts for `oldest` seconds.
    """
    return fold(frames, ["video"], ["no"], "tier string, reason string, called boolean, changed boolean", Tier, lambda s, row: route(s, row, interval, oldest))


@query(
    "sal_tier",
    TRACKS.replace("WITH fr", "WITH RECURSIVE fr", 1)
    + """, rows AS MATERIALIZED (SELECT video, f, f - CASE WHEN f % 21 = 0 THEN 2 ELSE 0 END AS frame, f / 30 AS ts, f // 40 AS scene, vec_id % 5 > 1 AS reliable, vec_id % 11 > 0 AS steady, vec_id % 19 = 0 AS urgent, vec_id % 7 = 0 AS compact, f > 4 AS win, vec_id % 4 > 0 AS unchanged, CASE WHEN vec_id % 6 = 1 THEN 'disabled' ELSE 'predicted' END AS status, CASE vec_id % 3 WHEN 0 THEN 'ambiguous_subjects' WHEN 1 THEN 'competing_person' ELSE 'no_person_pose' END AS subject FROM fr),
run AS (SELECT DISTINCT video, CAST(0 AS BIGINT) AS f, CAST(NULL AS BIGINT) AS frame, 0.0::DOUBLE AS ts, CAST(0 AS BIGINT) AS scene, 0 AS stable, 0 AS cheap, CAST(NULL AS VARCHAR) AS tier, CAST(NULL AS BIGINT) AS deep, CAST(NULL AS DOUBLE) AS cache, CAST(NULL AS VARCHAR) AS why, false AS called, false AS changed FROM fr
UNION ALL SELECT video, f, frame, ts, scene, stable, cheap, tier, CASE WHEN called THEN frame ELSE deep END, CASE WHEN called AND status = 'predicted' THEN ts ELSE cache END, why, called, tier IS DISTINCT FROM before AND before IS NOT NULL
FROM (SELECT * REPLACE (CASE WHEN pose THEN 'pose_only' WHEN why IN ('settling_evidence', 'valid_neural_cache') OR (called AND status = 'predicted') THEN 'deepgaze' ELSE 'handcrafted' END AS tier), tier AS before
FROM (SELECT *, NOT pose AND NOT enough AND win AND NOT valid AND NOT cooling AS called, CASE WHEN pose THEN 'stable_reliable_pose' WHEN enough THEN CASE WHEN tier = 'deepgaze' AND cheap < 3 AND valid THEN 'settling_evidence' WHEN reliable THEN 'pose_stabilizing' ELSE 'cheap_evidence_sufficient' END WHEN NOT win THEN 'temporal_window' WHEN valid THEN 'valid_neural_cache' WHEN cooling THEN 'neural_cooldown' WHEN status <> 'predicted' THEN status ELSE subject END AS why
FROM (SELECT * REPLACE (CASE WHEN stable >= 3 THEN cheap WHEN enough THEN cheap + 1 ELSE 0 END AS cheap), stable >= 3 AS pose, coalesce(cache IS NOT NULL AND ts - cache >= 0 AND ts - cache < 0.35::DOUBLE AND unchanged, false) AS valid, coalesce(frame - deep < 3 AND NOT urgent, false) AS cooling
FROM (SELECT n.*, CASE WHEN n.reliable AND n.steady AND NOT n.urgent AND r.frame IS NOT NULL AND NOT fresh THEN r.stable + 1 ELSE 0 END AS stable, CASE WHEN fresh OR n.urgent THEN 0 ELSE r.cheap END AS cheap, CASE WHEN NOT fresh THEN r.tier END AS tier, CASE WHEN NOT fresh THEN r.deep END AS deep, CASE WHEN NOT fresh AND NOT n.urgent THEN r.cache END AS cache, (n.reliable AND NOT n.urgent) OR n.compact AS enough
FROM (SELECT r.*, m.f AS nf, r.frame IS NOT NULL AND (m.scene <> r.scene OR m.frame <= r.frame OR m.ts < r.ts) AS fresh FROM run r JOIN rows m ON m.video = r.video AND m.f = r.f + 1) r JOIN rows n ON n.video = r.video AND n.f = r.nf)))))
SELECT video, f AS no, tier, why AS reason, called, changed FROM run WHERE f > 0""",
)
def sal_tier(t: Tables) -> DataFrame:
    n, f = F.col("vec_id"), F.col("no")
    d = sights(t).withColumnRenamed("frame", "no")
    subject = F.when(n % 3 == 0, "ambiguous_subjects").when(n % 3 == 1, "competing_person").otherwise("no_person_pose")
    d = d.select(
        "video", "no", (f - F.when(f % 21 == 0, 2).otherwise(0)).alias("frame"), (f / 30).alias("ts"), F.floor(f / 40).alias("scene"), (n % 5 > 1).alias("reliable"), (n % 11 > 0).alias("steady"), (n % 19 == 0).alias("urgent"), (n % 7 == 0).alias("compact"), (f > 4).alias("window"),
        (n % 4 > 0).alias("unchanged"), F.when(n % 6 == 1, "disabled").otherwise("predicted").alias("status"), subject.alias("reason"),
    )
    return tiers(d)
