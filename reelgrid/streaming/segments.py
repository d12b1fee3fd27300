"""Segments of videos from a stream of frames: a row when a scene, a window or the video ends, and rows of open ones in between if asked for.

Frames of a video are taken in order of their number within a trigger.  A frame whose
number is not beyond the last one taken is late: it is dropped, and counted by the
segment that is open then (by the next one if none is).  A number that is skipped is
counted as missing and is late should it come.  When a frame fails, its video ends:
segments already finished stay, the open one is not reported, and what follows is
ignored.  A video that has been silent beyond the watermark ends as well.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROW = (
    "video long, segment long, scene long, win long, frame_start long, frame_end long, n_frames long, n_detected long, n_predicted long, "
    "gaps map<string,long>, intervals map<string,long>, missing long, late long, reason string, final boolean"
)
STATE = "last long, scene long, detection long, emitted long, late long, closed boolean, open string"


class Segments:
    """What is known of one video: the last frame taken, its scene, and the segment that is open."""

    def __init__(self, window_frames: float, kept: tuple | None = None):
        self.window_frames = window_frames
        self.last, self.scene, self.detection, self.emitted, self.late, self.closed, held = kept or (0, 0, 0, 0, 0, False, "")
        self.open: dict | None = json.loads(held) if held else None

    def state(self) -> tuple:
        return self.last, self.scene, self.detection, self.emitted, self.late, self.closed, json.dumps(self.open) if self.open else ""

    def _window(self, before: int) -> int:
        return math.floor(before / self.window_frames + 1e-10)

    def row(self, reason: str | None) -> dict:
        """The open segment as a row; without a reason it goes on."""
        return {**self.open, "segment": self.emitted + 1, "reason": reason, "final": reason is not None}

    def finish(self, reason: str) -> list[dict]:
        if self.open is None:
            return []
        out = [self.row(reason)]
        self.emitted, self.open = self.emitted + 1, None
        return out

    def take(self, frame: int, cut: bool, detected: bool, interval: int, failed: bool, done: bool) -> list[dict]:
        """The segments that end with this frame or right before it."""
        if self.closed:
            return []
        if frame <= self.last:
            if self.open is None:
                self.late += 1
            else:
                self.open["late"] += 1
            return []
        if failed:
            self.open, self.closed = None, True
            return []
        out = []
        skipped, self.last = frame - self.last - 1, frame
        if cut or not self.scene:
            out += self.finish("scene")
            self.scene, self.detection = self.scene + 1, 0
        win = self._window(frame - 1)
        if self.open is not None and self.open["win"] != win:  # the frame that would have ended it was skipped
            out += self.finish("interval")
        if self.open is None:
            self.open = {"scene": self.scene, "win": win, "frame_start": frame, "n_frames": 0, "n_detected": 0, "n_predicted": 0, "gaps": {}, "intervals": {}, "missing": 0, "late": self.late}
            self.late = 0
        held = self.open
        held["frame_end"], held["n_frames"], held["missing"] = frame, held["n_frames"] + 1, held["missing"] + skipped
        held["intervals"][str(interval)] = held["intervals"].get(str(interval), 0) + 1
        if detected:
            held["n_detected"] += 1
            if self.detection:
                gap = str(frame - self.detection)
                held["gaps"][gap] = held["gaps"].get(gap, 0) + 1
            self.detection = frame
        else:
            held["n_predicted"] += 1
        if self._window(frame) != win:
            out += self.finish("interval")
        if done:
            out += self.finish("end")
            self.closed = True
        return out


def segment_stream(frames: DataFrame, window_frames: float = 60, delay: str = "10 minutes", early: bool = False) -> DataFrame:
    """frames (video, frame, ts: timestamp, cut, detected, interval, failed, done) to segment rows (append mode).

    reason: scene, interval or end for final rows; with `early` each trigger also gives a row, not final and without a reason, for every segment that
    it has left open.  delay: how long after its last frame, by the watermark, a silent video ends.  The first frame of a video opens
    scene 1, whether it is a cut or not.  Null flags are false; frames without a video or a number are dropped.  The state of a
    video is a few numbers and the histograms of one segment.
    """
    names = [c.split()[0] for c in ROW.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        video = Segments(window_frames, state.get if state.exists else None)
        rows: list[dict] = []
        if state.hasTimedOut:
            rows += video.finish("end")
            video.closed = True
            state.update(video.state())  # what comes now is late
        else:
            new = pd.concat(list(batches)).sort_values("frame", kind="stable")
            flags = new[["cut", "detected", "failed", "done"]].astype("boolean").fillna(False)
            for frame, interval, cut, detected, failed, done in zip(new["frame"], new["interval"].fillna(1), *(flags[c] for c in flags), strict=True):
                rows += video.take(int(frame), bool(cut), bool(detected), int(interval), bool(failed), bool(done))
            if early and video.open is not None:
                rows.append(video.row(None))
            state.update(video.state())
            if not video.closed:
                state.setTimeoutTimestamp(max(int(new["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([{"video": key[0], **r} for r in rows], columns=names)

    known = frames.filter("video IS NOT NULL AND frame IS NOT NULL").withWatermark("ts", delay)
    return known.groupBy("video").applyInPandasWithState(step, ROW, STATE, "append", GroupStateTimeout.EventTimeTimeout)
