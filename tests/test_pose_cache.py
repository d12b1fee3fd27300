"""The pose cache by hand, and its stream against its batch."""

from datetime import datetime

from pyspark.sql import functions as F

from reelgrid.operators import pose_cache as P
from reelgrid.plans.catalog import Tables
from reelgrid.streaming.poses import pose_stream

BOX = {"x1": 0.0, "y1": 0.0, "x2": 100.0, "y2": 200.0}


def found(**change):
    place = [{"x": 0.5, "y": k / 17} for k in range(17)]
    return {"has_pose": True, "torso": True, "places": place, "points": [True] * 17, "torso_points": [k in (5, 6, 11, 12) for k in range(17)]} | change


def person(**change):
    return {"row": 0, "track": 1, "confidence": 0.9, "box": BOX, "reliable": True, "crowded": False, "rival": None, "mask": None, "found": found()} | change


def walk(frames, **limits):
    """frames: changes of (frame, person); reasons of the first person asked for in each."""
    state, out = P.Poses(), []
    for k, (row, who) in enumerate(frames, 1):
        usual = {"no": k, "frame": k, "ts": k / 30, "scene": 0, "cleared": False, "identities_stable": k > 1, "safe": True, "candidate": None, "people": [person(**who)]}
        state, (mode, told) = P.observe(state, usual | row, P.Limits(**limits))
        out.append((mode, told[0]["source"], told[0]["reason"]) if told else (mode, None, None))
    return out, state


def reasons(frames, **limits):
    return [r for _, _, r in walk(frames, **limits)[0]]


def test_soft_and_hard_age():
    """Fresh for three frames; then measured again until two measurements stood still; then carried on up to the hard age."""
    got, state = walk([({}, {})] * 24)
    assert [r for _, _, r in got[:8]] == ["missing_pose", "fresh", "fresh", "pose_history_or_motion", "fresh", "fresh", "extended", "extended"]
    assert "hard_age_expired" in [r for _, _, r in got] and [k for k, (_, s, _) in enumerate(got, 1) if s == "inferred"] == [1, 4, 15, 18] and state.still["1"] == 2
    assert set(reasons([({}, {})] * 24, adaptive=False)) == {"missing_pose", "fresh", "profile_disabled"}


def test_each_reason():
    quiet = [({}, {})] * 6  # the next would be extended
    cases = {
        "unsafe_frame": ({"safe": False}, {}), "identity_changed": ({"identities_stable": False}, {}), "track_motion": ({}, {"confidence": 0.4}), "near_competitor": ({}, {"rival": "near_competitor"}),
        "mask_unstable_or_missing": ({}, {"mask": "mask_unstable_or_missing"}), "crowded": ({}, {"crowded": True}), "context_changed": ({"scene": 1}, {}), "missing_pose": ({}, {"track": 2}), "extended": ({}, {}),
    }
    for why, change in cases.items():
        assert reasons([*quiet, change])[-1] == why
    assert reasons([({}, {}), ({}, {"box": BOX | {"x1": 30.0, "x2": 130.0}})])[-1] == "box_motion" and reasons([*quiet, ({"cleared": True}, {})])[-1] == "missing_pose"
    assert reasons([({}, {"found": None})] * 4)[-1] == "torso_unreliable" and walk([*quiet, ({}, {"reliable": False})])[0][-1] == ("full", None, None)
    moved = found(places=[{"x": 0.9, "y": k / 17} for k in range(17)])
    assert reasons([({}, {})] * 3 + [({}, {"found": moved})] + [({}, {})] * 3)[-1] == "pose_history_or_motion"


def test_primary_alone():
    """A candidate with a kept pose is asked for alone; if its new pose is weak, the rest is looked at in the same frame."""
    both = lambda **c: {"people": [person(**c), person(row=1, track=2)]}
    got, _ = walk([(both(), {}), (both() | {"candidate": 0}, {}), (both(found=None) | {"candidate": 0, "safe": False}, {}), (both(found=None) | {"candidate": 0, "safe": False}, {})])
    assert [m for m, _, _ in got] == ["full", "primary", "primary", "primary_then_full"]


def test_few_tracks_are_kept():
    state = P.Poses()
    for k in range(300):
        row = {"no": k, "frame": 1, "ts": 0.0, "scene": 0, "cleared": False, "identities_stable": True, "safe": True, "candidate": None, "people": [person(track=k)]}
        state, _ = P.observe(state, row, P.Limits())
    assert len(state.kept) == 128 and next(iter(state.kept)) == "172"


def test_stream_equals_batch(spark, tmp_path):
    """The same rows out of a stream that is stopped and started again from its checkpoint."""
    frames = P.looks(Tables(spark, "/root/testdata/sf0.001")).persist()
    batch = P.observed(frames, P.Limits()).select("video", "no", "mode", F.explode_outer("told").alias("x")).select("video", "no", "x.row", "x.track", "x.source", "x.reason", "x.gap", "mode")
    want = sorted(map(str, map(tuple, batch.collect())))
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    base = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    staged = frames.withColumn("at", base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("no") / 30).cast("decimal(18,6)")))
    bound = [(0, 20), (20, 41), (41, 10**6)]
    for k, (low, high) in enumerate(bound):
        staged.filter((F.col("no") > low) & (F.col("no") <= high)).coalesce(1).write.mode("append").parquet(f"{source}/part={k}")
        if k == 1:
            continue  # the second and third file come after the stream has stopped
        read = spark.readStream.schema(staged.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = pose_stream(read, P.Limits()).writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(map(str, map(tuple, spark.read.parquet(out).collect()))) == want
    assert {r["source"] for r in batch.collect()} >= {"inferred", "remapped"}
