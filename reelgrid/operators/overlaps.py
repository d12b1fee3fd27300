"""Overlaps of boxes that are structs (x1, y1, x2, y2), for boxes of one frame in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import let


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs); the union counts as 1 at least."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(a[f"{k}2"], b[f"{k}2"]) - F.greatest(a[f"{k}1"], b[f"{k}1"]))
    size = lambda c: F.greatest(F.lit(0.0), c["x2"] - c["x1"]) * F.greatest(F.lit(0.0), c["y2"] - c["y1"])
    return let(side("x") * side("y"), lambda both: both / F.greatest(F.lit(1.0), size(a) + size(b) - both))


def owner(box: Column, people: Column, least: float = 0.30, apart: float = 0.10) -> Column:
    """The idx of the person (array of idx, box) that a box overlaps most; null under `least`, and where a second is within `apart`."""
    ranked = F.sort_array(F.transform(people, lambda p: F.struct(overlap(box, p["box"]).alias("iou"), p["idx"].alias("idx"))), asc=False)
    return let(ranked, lambda r: F.when((F.get(r, F.lit(0))["iou"] >= least) & ((F.size(r) < 2) | (F.get(r, F.lit(0))["iou"] - F.get(r, F.lit(1))["iou"] >= apart)), F.get(r, F.lit(0))["idx"]))
