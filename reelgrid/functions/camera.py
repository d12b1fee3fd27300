"""Where a crop should stand for bounds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp, crop_size, let


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def camera_target(bounds: tuple[Column, Column, Column, Column], confidence: Column, base: tuple[int, int], frame: tuple[int, int], zooms: tuple[float, float], anchor_y: Column | None = None) -> Column:
    """Middle, zoom and confidence of the crop for left, top, right, bottom: padded, fitted, and kept so far inside that the rounded crop fits.

    anchor_y: a height (eyes, head) that the crop hangs from where it is not null; else the bounds' middle counts.
    """
    w, h = map(float, frame)
    edges = F.struct(clamp(bounds[0], 0.0, w - 1).alias("l"), clamp(bounds[1], 0.0, h - 1).alias("t"), bounds[2].alias("r"), bounds[3].alias("b"))

    def inside(e: Column) -> Column:
        return F.struct(e["l"].alias("l"), e["t"].alias("t"), clamp(e["r"], e["l"] + 1, _num(w)).alias("r"), clamp(e["b"], e["t"] + 1, _num(h)).alias("b"))

    def fitted(e: Column) -> Column:
        wide, high = F.greatest(F.lit(1.0), e["r"] - e["l"]), F.greatest(F.lit(1.0), e["b"] - e["t"])
        fit_w = F.least(F.lit(w), wide + F.greatest(wide * 0.12, F.lit(16.0)) * 2)
        fit_h = F.least(F.lit(h), high + F.greatest(high * 0.16, F.lit(20.0)) * 2)
        zoom = clamp(F.least(base[0] / F.greatest(F.lit(1.0), fit_w), base[1] / F.greatest(F.lit(1.0), fit_h)), *map(float, zooms))
        return let(F.struct(((e["l"] + e["r"]) / 2).alias("x"), ((e["t"] + e["b"]) / 2).alias("y"), zoom.alias("zoom")), placed)

    def placed(p: Column) -> Column:
        cw, ch = crop_size(F.lit(base[0]), F.lit(base[1]), p["zoom"], F.lit(frame[0]).cast("long"), F.lit(frame[1]).cast("long"))
        return let(F.struct(p["x"].alias("x"), p["y"].alias("y"), p["zoom"].alias("zoom"), cw.alias("cw"), ch.alias("ch")), aimed)

    def aimed(p: Column) -> Column:
        middle = p["y"] if anchor_y is None else F.coalesce(anchor_y + p["ch"] * 0.15, p["y"])
        return F.struct(clamp(p["x"], p["cw"] / 2, w - p["cw"] / 2).alias("center_x"), clamp(middle, p["ch"] / 2, h - p["ch"] / 2).alias("center_y"), p["zoom"].alias("zoom"), confidence.alias("confidence"))

    return let(edges, lambda e: let(inside(e), fitted))


def focus_bounds(c: dict[str, Column]) -> Column:
    """What a crop should show of a candidate: left, top, right, bottom.

    c: person, x1, y1, x2, y2, mask_top, and of cues, null where there are none: body (min_x, max_x, top, bottom), bottom_sure, eye_y, head and
    salient (boxes).  People are bounded by their body, else by their head and box, all others by their box; room is left above,
    and a salient part is kept in with some room of its own.
    """
    one = lambda *values: F.struct(*[v.alias(n) for n, v in zip(("l", "t", "r", "b"), values, strict=True)])
    body, head, sure = c["body"], c["head"], c["bottom_sure"]

    def bodied(e: Column) -> Column:
        tall = F.greatest(F.lit(1.0), e["b"] - e["t"])
        above = F.when(c["eye_y"].isNotNull(), F.greatest(tall * 0.12, F.greatest(F.lit(0.0), c["eye_y"] - e["t"]) * 1.35)).otherwise(tall * 0.15)
        return one(e["l"], e["t"] - above, e["r"], e["b"] + tall * F.when(sure, 0.08).otherwise(0.18))

    def boxed(e: Column) -> Column:
        tall, wide = F.greatest(F.lit(1.0), e["b"] - e["t"]), F.greatest(F.lit(1.0), e["r"] - e["l"])
        return one(e["l"] - wide * 0.14, e["t"] - tall * 0.14, e["r"] + wide * 0.14, e["b"] + tall * 0.16)

    hw, hh = F.greatest(F.lit(1.0), head["x2"] - head["x1"]), F.greatest(F.lit(1.0), head["y2"] - head["y1"])
    by_head = one(F.least(c["x1"], head["x1"] - hw * 0.15), F.least(c["y1"], head["y1"] - hh * 0.15), F.greatest(c["x2"], head["x2"] + hw * 0.15), c["y2"] + (c["y2"] - c["y1"]) * 0.08)
    known = body["min_x"].isNotNull() & body["max_x"].isNotNull() & body["top"].isNotNull() & body["bottom"].isNotNull()
    by_body = one(F.least(body["min_x"], c["x1"]), body["top"], F.greatest(body["max_x"], c["x2"]), F.when(sure, body["bottom"]).otherwise(F.greatest(body["bottom"], c["y2"])))
    base = F.when(c["person"] & known, let(by_body, bodied)).when(c["person"] & head["x1"].isNotNull(), by_head).otherwise(let(one(c["x1"], c["mask_top"], c["x2"], c["y2"]), boxed))
    s = c["salient"]
    px, py = F.greatest(F.lit(8.0), (s["x2"] - s["x1"]) * 0.18), F.greatest(F.lit(8.0), (s["y2"] - s["y1"]) * 0.22)
    whole = s["x1"].isNotNull() & s["y1"].isNotNull() & s["x2"].isNotNull() & s["y2"].isNotNull()
    return let(base, lambda e: F.when(whole, one(F.least(e["l"], s["x1"] - px), F.least(e["t"], s["y1"] - py), F.greatest(e["r"], s["x2"] + px), F.greatest(e["b"], s["y2"] + py))).otherwise(e))
