"""All queries of the library: importing the operators' modules registers theirs."""

from __future__ import annotations

from ..operators import audits, detections, flow, folds, framing, grids, pose_cache, poses, routing, runs, scheduler, settings, shapes, timeline  # noqa: F401
from .catalog import QUERIES, SQL, bound

__all__ = ["QUERIES", "SQL", "bound"]
