"""Settings, routing and scheduling on rows made by hand, and tables that are written."""

import json

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import routing, runs, scheduler, shapes
from reelgrid.operators import settings as S


def test_each_fault_breaks_its_rule(spark):
    rows = [(k,) for k in range(len(S.FAULTS) + 1)]
    given = {}
    for k, (_, values) in enumerate(S.FAULTS):
        for name, value in values.items():
            kind, usual = S.DEFAULTS[name]
            given[name] = F.when(F.col("run") == k, F.lit(value).cast(kind)).otherwise(given.get(name, F.lit(usual).cast(kind)))
    told = S.rule_faults(S.settings(spark.createDataFrame(rows, "run long"), given), S.rules(), ["run"]).collect()
    assert sorted((r["run"], r["rule"]) for r in told) == [(k, name) for k, (name, _) in enumerate(S.FAULTS)]
    assert {name for name, _ in S.FAULTS} == set(S.rules())


def test_preset_follows(spark):
    d = S.with_preset(S.settings(spark.createDataFrame([("sports",), ("other",)], "preset string"), {"pan_time": F.lit(0.2)}))
    r = d.collect()
    assert len(r) == 1 and r[0]["classes"] == ["person", "car", "bicycle", "motorcycle"] and (r[0]["min_zoom"], r[0]["max_zoom"], r[0]["pan_time"]) == (1.0, 1.35, 0.2)
    assert r[0]["zoom_time"] == pytest.approx(0.6) and r[0]["target_time"] == pytest.approx(0.39977, abs=1e-4) and r[0]["lost_hold_seconds"] == pytest.approx(40 / 30) and r[0]["zoom_speed"] == pytest.approx(1.05)


def test_encoders_and_devices(spark):
    one = spark.range(1)
    args = lambda e: one.select(S.encoder_args(F.lit(e), F.lit(18), F.lit("slow"), F.lit("p7"), F.lit("8M")).alias("a")).first()["a"]
    assert args("libx265") == "-crf 18 -preset slow" and args("hevc_nvenc") == "-cq 18 -preset p7 -rc vbr -b:v 0" and args("h264_videotoolbox") == "-b:v 8M"
    device = lambda name, gpus=2, mps=False: tuple(one.select(shapes.device(F.lit(name), F.lit(gpus), F.lit(mps)).alias("d")).first()["d"])
    assert device(" CUDA ") == ("cuda:0", None) and device("1") == ("cuda:1", None) and device("auto", 0) == ("cpu", None) and device("mps", mps=True) == ("mps", None)
    assert device("cuda:5") == (None, "unavailable") and device("mps") == (None, "unavailable") and device("cuda", 0) == (None, "unavailable") and device("cuda:-1") == (None, "unknown") and device("tpu") == (None, "unknown")


def test_canonical_strings(spark):
    """Control characters, quotes and backslashes as JSON has them."""
    for value in ("a\tb\nc", 'q"\\', "\x01\x1f", "é/ü", ""):
        got = spark.createDataFrame([(value,)], "v string").select(runs.text(F.col("v")).alias("t")).first()["t"]
        assert json.loads(got) == value and "\n" not in got
    assert spark.createDataFrame([(None,)], "v string").select(runs.text(F.col("v")).alias("t")).first()["t"] is None


def test_tables_are_written(spark, tmp_path):
    ok = spark.createDataFrame([(1, "a", 0, "ok", 2.5), (2, "a", 1, "ok", 3.5), (3, "b", 1, "ok", 4.0)], "run long, case_name string, repeat long, status string, wall double")
    bad = spark.createDataFrame([(4, "stopped")], "run long, error string")
    runs.write_csv(str(tmp_path / "csv"), ok, bad)
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("run").collect()
    assert rows[0].asDict() == {"case_name": "a", "error": None, "repeat": "0", "run": "1", "status": "ok", "wall": "2.5"} and rows[3]["error"] == "stopped" and rows[3]["wall"] is None
    segments = spark.createDataFrame([(1, 1, 60), (2, 1, 30)], "run long, segment long, frames long")
    runs.write_segments(str(tmp_path / "segments"), segments, ok)
    lines = spark.read.json(str(tmp_path / "segments/jsonl")).orderBy("run").collect()
    assert [(r["run"], r["warmup"], r["case_name"], r["frames"]) for r in lines] == [(1, True, "a", 60), (2, False, "a", 30)]
    runs.write_results(str(tmp_path / "results"), ok, segments, ["wall"])
    assert spark.read.json(str(tmp_path / "results/results.json")).count() == 3
    assert {p.name for p in (tmp_path / "results").iterdir()} >= {"results.json", "results.csv"}


TRACK = "struct<row:long,track:long,cls:int,confidence:double,box:struct<x1:double,y1:double,x2:double,y2:double>,pose_ok:boolean>"


def person(row, track, x=0.0, w=100.0, cls=0, confidence=0.9, pose_ok=True):
    return (row, track, cls, confidence, (x, 0.0, x + w, 200.0), pose_ok)


def who(spark, tracks, preferred=None, lock=False, two=False):
    d = spark.createDataFrame([(tracks, preferred)], f"tracks array<{TRACK}>, preferred long")
    r = d.select(routing.subjects(F.col("tracks"), F.col("preferred"), F.lit(lock), F.lit(two)).alias("w")).first()["w"]
    return r["rows"], r["reason"]


def test_subjects(spark):
    a, b, far = person(0, 1), person(1, 2, 60.0), person(1, 2, 500.0)
    assert who(spark, []) == ([], "no_person_pose") and who(spark, [], 1, True) == ([], "locked_subject_missing") and who(spark, [a], 9, True) == ([], "locked_subject_missing")
    assert who(spark, [a]) == ([0], "reliable_pose") and who(spark, [person(0, 1, pose_ok=False)]) == ([0], "insufficient_or_stale_pose")
    assert who(spark, [a, far]) == ([0, 1], "ambiguous_subjects") and who(spark, [a, far], two=True) == ([0, 1], "reliable_pose") and who(spark, [a, person(1, 2, 40.0)], two=True) == ([0, 1], "overlapping_people")
    assert who(spark, [a, far], 1, True) == ([0], "competing_person") and who(spark, [a, person(1, 2, 500.0, 30.0)], 1, True) == ([0], "reliable_pose")
    assert who(spark, [a, person(1, 5, 900.0, cls=16)]) == ([0], "competing_object") and who(spark, [a, b]) == ([0, 1], "ambiguous_subjects")


SEEN = "struct<track:long,activated:boolean,box:struct<x1:double,y1:double,x2:double,y2:double>,envelope:struct<x1:double,y1:double,x2:double,y2:double>,measured:int>"


def seen(track, x=0.0, size=300.0, activated=True, envelope=True, measured=5):
    box = (x, 0.0, x + size, size)
    return (track, activated, box, box if envelope else None, measured)


def settled(spark, tracked, lost=(), observed=None, primary=1, everyone=False, careful=False):
    row = [(list(tracked), list(lost), list(tracked if observed is None else observed), primary)]
    d = spark.createDataFrame(row, f"tracked array<{SEEN}>, lost array<{SEEN}>, observed array<{SEEN}>, prime long")
    r = d.select(routing.unsettled(F.col("tracked"), F.col("lost"), F.col("observed"), F.col("prime"), F.lit(everyone), F.lit(careful), F.lit(1e6)).alias("u")).first()["u"]
    return r["reason"], r["relief"]


def test_unsettled(spark):
    one, two = seen(1), seen(2, 800.0, 100.0)
    assert settled(spark, [one]) == (None, []) and settled(spark, [one, two]) == (None, [2]) and settled(spark, [one, two], careful=True) == (None, [])
    every = {"everyone": True}
    assert settled(spark, [one], [two], **every)[0] == "all_lost_tracks" and settled(spark, [seen(1, activated=False)], **every)[0] == "all_unconfirmed_tracks" and settled(spark, [one], observed=[], **every)[0] == "all_track_set_changed"
    assert settled(spark, [one], primary=None)[0] == "primary_unselected" and settled(spark, [one, one])[0] == "ambiguous_track_ids" and settled(spark, [two])[0] == "primary_missing_or_lost" and settled(spark, [one], [one])[0] == "primary_missing_or_lost"
    assert settled(spark, [seen(1, activated=False)])[0] == "primary_unconfirmed" and settled(spark, [one, seen(2, 800.0, activated=False)])[0] == "secondary_unconfirmed"
    assert settled(spark, [one, two], observed=[one])[0] == "secondary_new_or_unreported" and settled(spark, [one], observed=[one, two])[0] == "secondary_missing"
    assert settled(spark, [seen(1, envelope=False), two])[0] == "primary_uncertain_motion" and settled(spark, [one], [seen(3, 900.0, envelope=False)])[0] == "secondary_lost_uncertain"
    assert settled(spark, [one], [seen(3, 400.0)])[0] == "secondary_lost_near_primary" and settled(spark, [one], [seen(3, 900.0, 250.0)])[0] == "secondary_lost_prominent" and settled(spark, [one], [seen(3, 900.0, 250.0)], careful=True)[0] is None
    assert settled(spark, [one, seen(2, 800.0, 100.0, measured=1)])[0] == "secondary_new_measurement" and settled(spark, [one], [seen(3, 900.0, 50.0)]) == (None, [])
    assert settled(spark, [one, seen(2, 400.0, 100.0)]) == (None, []) and settled(spark, [one, seen(2, 800.0, 250.0)]) == (None, [])  # near or large: guarded, not relieved


def walk(rows, **policy):
    state, out = scheduler.Schedule(), []
    for k, row in enumerate(rows, 1):
        usual = {"frame": k, "ts": k / 30, "scene": 0, "tracks": [{"track": 1, "confidence": 0.9, "x1": 0.0, "y1": 0.0, "x2": 100.0, "y2": 200.0}], "gate": None, "changed": False, "unsure": False, "uncertain": False, "flow": None, "extendable": True, "preferred": 1, "present": True, "pose": "reliable"}
        state, told = scheduler.step(state, usual | row, scheduler.Policy(**({"oldest": 0.25} | policy)))
        out.append(told[:3])
    return out


def test_schedule():
    """Gaps widen while all is steady, up to what age and profile allow, and fall back to one at the first sign of change."""
    steady = walk([{}] * 60)
    assert steady[0] == (True, "initial", 1) and [i for d, _, i in steady if d][:6] == [1, 1, 1, 2, 2, 2] and {i for _, _, i in steady} == {1, 2, 3, 4, 6}
    assert {r for _, r, _ in steady} == {"initial", "scheduled", None} and max(i for _, _, i in walk([{}] * 60, profile="conservative")) == 3 and {d for d, _, _ in walk([{}] * 9, gap=1)} == {True}
    at = 45
    for change, why in ({"gate": "unsettled_tracks"}, "unsettled_tracks"), ({"changed": True}, "frame_change"), ({"unsure": True}, "low_confidence"), ({"scene": 1}, "initial"), ({"frame": 99}, "initial"), ({"flow": "flow_jump"}, "flow_jump"):
        quiet = next(k for k in range(at, 60) if not steady[k][0])
        told = walk([{}] * quiet + [change])
        assert told[quiet] == (True, why, 1), (change, told[quiet])
    quiet = next(k for k in range(at, 58) if not steady[k][0] and not steady[k + 1][0])
    assert walk([{}] * quiet + [{"present": False}, {}])[quiet + 1][:2] == (True, "primary_missing") and walk([{}] * quiet + [{"preferred": 2}, {"preferred": 2}])[quiet + 1][:2] == (True, "primary_changed")
    assert walk([{}] * quiet + [{"pose": "weak_fresh"}, {}])[quiet + 1][:2] == (True, "weak_primary_pose")
    assert {i for _, _, i in walk([{"extendable": False}] * 60)} == {1, 2, 3} and walk([{"tracks": []}] * 3)[2] == (True, "no_tracks", 1)
    assert max(i for _, _, i in walk([{}] * 60, oldest=0.1)) == 3


def routed(rows, interval=3):
    state, out = scheduler.Tier(), []
    for k, row in enumerate(rows, 1):
        usual = {"frame": k, "ts": k / 30, "scene": 0, "reliable": False, "steady": True, "urgent": False, "compact": False, "window": True, "unchanged": True, "status": "predicted", "reason": "ambiguous_subjects"}
        state, told = scheduler.route(state, usual | row, interval, 0.35)
        out.append(told[:2])
    return out


def test_tiers():
    """Every outcome: reliable and steady needs no look, cheap maps come before the network, whose map is kept, settles and cools down."""
    good = {"reliable": True}
    assert routed([good] * 4) == [("handcrafted", "pose_stabilizing")] * 3 + [("pose_only", "stable_reliable_pose")]
    assert routed([good] * 4 + [good | {"steady": False}, good | {"urgent": True}])[4:] == [("handcrafted", "pose_stabilizing"), ("deepgaze", "ambiguous_subjects")]
    assert routed([{"compact": True}]) == [("handcrafted", "cheap_evidence_sufficient")] and routed([{"window": False}]) == [("handcrafted", "temporal_window")]
    assert routed([{}, {}, {"unchanged": False}, {"unchanged": False}]) == [("deepgaze", "ambiguous_subjects"), ("deepgaze", "valid_neural_cache"), ("handcrafted", "neural_cooldown"), ("deepgaze", "ambiguous_subjects")]
    assert routed([{}, {"compact": True}, {"compact": True}, {"compact": True}])[1:] == [("deepgaze", "settling_evidence")] * 2 + [("handcrafted", "cheap_evidence_sufficient")]
    assert routed([{"status": "failed"}, {}, {"urgent": True}]) == [("handcrafted", "failed"), ("handcrafted", "neural_cooldown"), ("deepgaze", "ambiguous_subjects")]
    assert routed([{}] * 11 + [{"ts": 13 / 30}])[11] == ("deepgaze", "ambiguous_subjects")  # too old
    assert routed([good] * 4 + [good | {"scene": 1}])[4] == ("handcrafted", "pose_stabilizing") and routed([{}, {"frame": 1}])[1] == ("deepgaze", "ambiguous_subjects")
