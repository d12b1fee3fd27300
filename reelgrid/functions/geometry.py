"""Boxes, crops and motion as column expressions; nothing here leaves generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used: expressions that use their parts twice double at every step."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def clamp(value: Column, low, high) -> Column:
    """value within low and high; null stays null (greatest and least would skip it)."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(value.isNull(), None).otherwise(F.greatest(low, F.least(value, high)))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def q6(value: Column) -> Column:
    """Millionths, rounded half up to a long: what results are compared by."""
    return F.floor(value * 1e6 + 0.5).cast("long")


def area(p: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{p}x2") - F.col(f"{p}x1")) * F.greatest(F.lit(0.0), F.col(f"{p}y2") - F.col(f"{p}y1"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of boxes with column prefixes a and b; the union counts as 1 at least."""
    wide = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    high = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    both = F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)
    return both / F.greatest(F.lit(1.0), area(a) + area(b) - both)


def base_crop(w: Column, h: Column, aw: float, ah: float) -> tuple[Column, Column]:
    """The largest crop of that aspect within the frame, rounded half to even."""
    r = aw / ah
    wide = w / h >= r
    width = F.least(w, F.when(wide, F.bround(h * r)).otherwise(w).cast("long"))
    height = F.least(h, F.when(wide, h).otherwise(F.bround(w / r)).cast("long"))
    return width, height


def crop_size(bw: Column, bh: Column, zoom: Column, w: Column, h: Column) -> tuple[Column, Column]:
    z = F.greatest(F.lit(0.1), zoom)
    return tuple(clamp(F.bround(b / z).cast("long"), F.lit(64).cast("long"), f) for b, f in ((bw, w), (bh, h)))


def spring(current: Column, target: Column, velocity: Column, dt: float, tau: float, top: float) -> tuple[Column, Column]:
    """One step of a critically damped spring: new value and velocity; it stops at the target and keeps to `top` speed."""
    omega = 2 / max(tau, 1e-4)
    off = current - target
    k = velocity + off * omega
    decay = F.exp(F.lit(-omega * dt))
    step = clamp(target + (off + k * dt) * decay - current, -top * dt, top * dt)
    value = current + step
    over = (target - current) * (target - value) <= 0
    return F.when(over, target).otherwise(value), F.when(over, 0.0).otherwise(clamp((velocity - k * (omega * dt)) * decay, -top, top))
