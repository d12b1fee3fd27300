"""The pose cache as a stream: the same step as over batches, its state kept by video, dropped when a video has been silent beyond the watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pose_cache import Limits, replayed

ROW = "video long, no long, row long, track long, source string, reason string, gap long, mode string"


def pose_stream(frames: DataFrame, limits: Limits, delay: str = "10 minutes") -> DataFrame:
    """frames as for pose_cache.observed, with at (timestamp): a row per person asked for, and one without a row number for frames that ask for nobody.

    Frames of a video are taken in order within a trigger; one that is not beyond the last taken is late and dropped.  The state is a JSON string of at
    most `limits.most` poses a video.
    """
    names = [c.split()[0] for c in ROW.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, held = state.get if state.exists else (0, "")
        new = pd.concat(list(batches)).sort_values("no", kind="stable")
        new = new[new["no"] > last].drop_duplicates("no")
        rows = [json.loads(r) for r in new["row"]]
        after, told = replayed(json.loads(held) if held else None, iter(rows), limits)
        out = [(key[0], row["no"], x["row"], x["track"], x["source"], x["reason"], x["gap"], mode) for row, (mode, found) in zip(rows, told, strict=True) for x in (found or [dict.fromkeys(("row", "track", "source", "reason", "gap"))])]
        if len(new):
            state.update((int(new["no"].max()), json.dumps(after)))
            state.setTimeoutTimestamp(max(int(new["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("row", "track", "gap")})

    whole = F.to_json(F.struct(*[c for c in frames.columns if c not in ("at", "video")]), {"ignoreNullFields": "false"})
    slim = frames.filter("video IS NOT NULL AND no IS NOT NULL").select("video", "no", "at", whole.alias("row")).withWatermark("at", delay)
    return slim.groupBy("video").applyInPandasWithState(step, ROW, "last long, held string", "append", GroupStateTimeout.EventTimeTimeout)
