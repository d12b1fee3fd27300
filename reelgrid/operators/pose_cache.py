"""Poses kept from frame to frame: which are asked for anew, which are carried over, and why; one step for batches and streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import Tables, query
from .folds import fold
from .overlaps import overlap
from .poses import LIMBS, _struct, assessed
from .routing import prepared, primary_person, states

ROW = "mode string, told array<struct<row:bigint,track:bigint,source:string,reason:string,gap:bigint>>"


@dataclass
class Limits:
    """How long poses count: frames until one is asked for again (soft), seconds at most (hard), and how many tracks are kept."""

    interval: int = 3
    fps: float = 30.0
    oldest: float = 0.35
    adaptive: bool = True
    most: int = 128

    @property
    def frames(self) -> int:
        return math.ceil(self.oldest * self.fps)


@dataclass
class Poses:
    """Of each track: when its pose was put in and measured, the box and what was found then; and how often in a row it stood still."""

    kept: dict[str, dict] = field(default_factory=dict)
    still: dict[str, int] = field(default_factory=dict)


def same_box(old: dict, new: dict, tolerance: float = 0.2) -> bool:
    w, h = max(1.0, old["x2"] - old["x1"]), max(1.0, old["y2"] - old["y1"])
    low, high = 1 - tolerance, 1 / (1 - tolerance)
    sized = low <= (new["x2"] - new["x1"]) / w <= high and low <= (new["y2"] - new["y1"]) / h <= high
    return sized and abs(new["x1"] - old["x1"]) < w * tolerance and abs(new["y1"] - old["y1"]) < h * tolerance


def stood(old: dict | None, new: dict | None) -> bool:
    """Whether two found poses are of reliable torsos that have hardly moved, limbs neither."""
    if not old or not new or not old["torso"] or not new["torso"]:
        return False
    far = [math.hypot(b["x"] - a["x"], b["y"] - a["y"]) if a and b else 0.0 for a, b in zip(old["places"], new["places"], strict=True)]
    torso = [d for d, a, b in zip(far, old["torso_points"], new["torso_points"], strict=True) if a and b]
    limbs = [far[k] for k in LIMBS if old["points"][k] and new["points"][k]]
    return len(torso) >= 3 and max(torso) <= 0.10 and max(limbs, default=0.0) <= 0.18


def extension(person: dict, kept: dict, still: int, row: dict, limits: Limits) -> str:
    """'extended', or the first reason why a pose past its interval is not used longer."""
    if not limits.adaptive:
        return "profile_disabled"
    if not row["safe"]:
        return "unsafe_frame"
    if not row["identities_stable"]:
        return "identity_changed"
    if not person["reliable"]:
        return "tracking_unreliable"
    if person["confidence"] < 0.5 or not same_box(kept["box"], person["box"], 0.08):
        return "track_motion"
    if not (kept["found"] or {}).get("torso"):
        return "torso_unreliable"
    if still < 2:
        return "pose_history_or_motion"
    return person["rival"] or person["mask"] or "extended"


def trusted(s: Poses, person: dict, row: dict, limits: Limits, fresh: bool) -> bool:
    """Whether the pose kept of a person may stand in for all looks; with fresh false, whether it is worth asking for first."""
    kept = s.kept.get(str(person["track"]))
    if not person["reliable"] or kept is None:
        return False
    gap, age = row["frame"] - kept["frame"], row["ts"] - kept["ts"]
    most = max(limits.interval, limits.frames) if fresh else max(2, limits.interval * 2, limits.frames)
    found = kept["found"] or {}
    if kept["scene"] != row["scene"] or not 0 <= gap < most or not 0 <= age < most / limits.fps or not same_box(kept["box"], person["box"], 0.1) or not found.get("has_pose") or not found.get("torso"):
        return False
    if not fresh or (gap == 0 and age == 0):
        return True
    if limits.oldest == 0 or age + 1e-9 >= limits.oldest:
        return False
    past = gap >= limits.interval or age + 1e-9 >= limits.interval / limits.fps
    return not past or extension(person, kept, s.still.get(str(person["track"]), 0), row, limits) == "extended"


def reuse(s: Poses, person: dict, row: dict, limits: Limits) -> tuple[bool, str, int | None]:
    """Whether a person's kept pose is carried over, why it is or is not, and how many frames ago it was measured."""
    kept = s.kept.get(str(person["track"])) if person["track"] is not None else None
    if kept is None:
        return False, "missing_pose", None
    if person["crowded"]:
        return False, "crowded", None
    gap, age = row["frame"] - kept["frame"], row["ts"] - kept["ts"]
    if gap < 0 or age < 0 or kept["scene"] != row["scene"]:
        return False, "context_changed", gap
    if not ((gap == 0 and age == 0) or (limits.oldest > 0 and age + 1e-9 < limits.oldest and gap < limits.frames)):
        return False, "hard_age_expired", gap
    if gap < limits.interval and age + 1e-9 < limits.interval / limits.fps:
        return (True, "fresh", gap) if same_box(kept["box"], person["box"]) else (False, "box_motion", gap)
    why = extension(person, kept, s.still.get(str(person["track"]), 0), row, limits)
    return why == "extended", why, gap


def get_many(s: Poses, people: list[dict], row: dict, limits: Limits) -> list[dict]:
    """What becomes of each asked person's pose; those that are not carried over are measured, and kept for later."""
    oldest = max(2, limits.interval * 2, limits.frames + 1)
    s.kept = {k: v for k, v in s.kept.items() if 0 <= row["frame"] - v["frame_in"] < oldest}
    told, pending = [], []
    for p in people:
        ok, why, gap = reuse(s, p, row, limits)
        told.append({"row": p["row"], "track": p["track"], "source": "remapped" if ok else "inferred", "reason": why, "gap": gap if ok else 0})
        if not ok:
            pending.append(p)
    for p in pending:
        if p["track"] is None:
            continue
        name, old = str(p["track"]), s.kept.get(str(p["track"]))
        still = False
        if old is not None:
            age = row["ts"] - old["ts"]
            near = old["scene"] == row["scene"] and 0 < age <= max(limits.oldest, limits.interval / limits.fps) + 1e-9 and row["frame"] > old["frame"]
            still = near and same_box(old["box"], p["box"], 0.08) and stood(old["found"], p["found"])
        s.still[name] = min(3, s.still.get(name, 1) + 1) if still else 1
        s.kept[name] = {"frame_in": row["frame"], "frame": row["frame"], "ts": row["ts"], "scene": row["scene"], "box": p["box"], "found": p["found"]}
    while len(s.kept) > limits.most:
        first = next(iter(s.kept))
        del s.kept[first]
        s.still.pop(first, None)
    return told


def observe(s: Poses, row: dict, limits: Limits) -> tuple[Poses, tuple]:
    """One frame: mode (primary: one person was enough; primary_then_full; full) and what was told of each person asked for."""
    if row["cleared"]:
        s = Poses()
    live = {str(p["track"]) for p in row["people"]}
    s.still = {k: v for k, v in s.still.items() if k in live}
    people = [p for p in row["people"] if p["reliable"]]
    first = next((p for p in people if p["row"] == row["candidate"]), None)
    if first is None or not trusted(s, first, row, limits, fresh=False):
        return s, ("full", get_many(s, people, row, limits))
    told = get_many(s, [first], row, limits)
    if trusted(s, first, row, limits, fresh=True):
        return s, ("primary", told)
    return s, ("primary_then_full", told + get_many(s, [p for p in people if p is not first], row, limits))


def observed(frames: DataFrame, limits: Limits) -> DataFrame:
    """video, no, mode and told: for each person asked for the row, track, source (inferred or remapped), reason, and gap (frames since it was measured).

    frames: video, no (their order), frame, ts, scene, cleared, identities_stable, safe (of prepared), candidate (the row of the one person that may be
    enough: primary_person but for the trust in its pose), people: array of row, track, confidence, box, reliable, crowded, rival and mask (reasons
    against longer use, null: none), found (what a look would find: has_pose, torso, places, points and torso_points; null: nothing).
    At most `most` tracks are kept, those put in first go first; a task holds the poses of one video.
    """
    return fold(frames, ["video"], ["no"], ROW, Poses, lambda s, row: observe(s, row, limits))


def replayed(state: dict | None, rows: Iterator[dict], limits: Limits) -> tuple[dict, list[tuple]]:
    """The same for rows of a stream: state before (null: none) to state after, and what each row gives."""
    s, out = Poses(**state) if state else Poses(), []
    for row in rows:
        s, told = observe(s, row, limits)
        out.append(told)
    return asdict(s), out


def looks(t: Tables) -> DataFrame:
    """Frames with their people, and with the pose that a look at any of them would find; keys choose what is against longer use."""
    n = F.col("vec_id")
    d = prepared(states(t))
    ids = F.array_sort(F.array_distinct(F.transform(F.filter("people", lambda p: p["reliable"]), lambda p: p["track"])))
    d = d.withColumn("before", F.when(~F.col("cleared"), F.lag(ids).over(Window.partitionBy("video").orderBy("no"))))
    e = assessed(t).select("vec_id", F.col("box").alias("pose_box"), "points", "evidence").withColumnRenamed("vec_id", "of")
    d = d.join(e, n == F.col("of"))
    b, ev = F.col("pose_box"), F.col("evidence")
    places = F.transform("points", lambda p, i: F.when(F.get(ev["valid"], i), _struct(x=(p["x"] - b["x1"]) / F.nullif(b["x2"] - b["x1"], F.lit(0.0)), y=(p["y"] - b["y1"]) / (b["y2"] - b["y1"]))))  # points that count are finite
    found = F.when(F.size("points") == 17, _struct(has_pose=n % 6 > 0, torso=ev["torso_reliable"], places=places, points=ev["valid"], torso_points=ev["torso"]))

    def person(p: Column) -> Column:
        crowded = F.exists("people", lambda o: (o["row"] != p["row"]) & o["reliable"] & (overlap(o["box"], p["box"]) > 0.35))
        rival = F.when((n + p["row"]) % 9 == 0, "near_competitor").when((n + p["row"]) % 14 == 0, "prominent_competitor")
        mask = F.when((n + p["row"]) % 10 == 3, "mask_unstable_or_missing").when((n + p["row"]) % 22 == 5, "mask_stale_or_changed")
        return _struct(row=p["row"], track=p["track"], confidence=F.greatest(p["confidence"], F.lit(0.45)) + 0.1, box=p["box"], reliable=p["reliable"], crowded=crowded, rival=rival, mask=mask, found=found)

    f, v = F.col("no"), F.col("video")
    alone = F.transform(F.filter("people", lambda p: p["reliable"]), lambda p: _struct(row=p["row"], track=p["track"], confidence=p["confidence"], box=p["box"], reliable=p["reliable"], trusted=F.lit(True)))
    named = d.withColumns({"all_people": F.transform("people", person), "people": alone, "followed": 10 * v, "followed_cls": F.lit(0), "locked": F.floor(f / 10) % 2 == 1, "since": f % 7})
    named = named.withColumn("candidate", primary_person(named, 30))
    return named.select("video", "no", "frame", "ts", "scene", "cleared", "identities_stable", "safe", "candidate", F.col("all_people").alias("people"))


@query("pos_cache")
def pos_cache(t: Tables) -> DataFrame:
    """A row per person asked for; a fold over nested state that SQL has no short form of: tested by hand, and against the stream."""
    return observed(looks(t), Limits()).select("video", "no", F.inline("told"))


@query("pos_observe")
def pos_observe(t: Tables) -> DataFrame:
    """A row per frame: how it was looked at, and how many people were asked for and measured."""
    d = observed(looks(t), Limits())
    return d.select("video", "no", "mode", F.size("told").cast("long").alias("asked"), F.size(F.filter("told", lambda x: x["source"] == "inferred")).cast("long").alias("measured"))
