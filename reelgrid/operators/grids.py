"""Small grids (masks, saliency maps, thumbnails) that stay in one row: moments, regions, connected parts, histograms, tiles.

A grid is an array in rows from top to bottom, and its width.  No cell is a row of
its own and nothing here shuffles cells; a frame is compared with the one before it
by a window over frames.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.camera import camera_target
from ..functions.geometry import clamp, let, q6
from ..plans.catalog import Tables, query
from .folds import fold

WIDTH, HEIGHT = 1920, 1080
Q = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"

#: Grids of 8 x 8 in steps of 1/256 out of embeddings, every eleventh of little contrast; up to three boxes a frame.
MAPS = """WITH RECURSIVE bounds AS (SELECT vec_id, label, embedding, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi, CASE WHEN vec_id % 11 = 0 THEN 0.0625::DOUBLE ELSE 1.0::DOUBLE END AS amp FROM embeddings),
cells AS (SELECT vec_id, label, i - 1 AS pos, (i - 1) // 8 AS r, (i - 1) % 8 AS c, floor((CAST(embedding[i] AS DOUBLE) - lo) / (hi - lo) * 256) AS g, floor((CAST(embedding[i] AS DOUBLE) - lo) / (hi - lo) * 256) / 256 * amp AS v FROM bounds, range(1, 65) AS s(i)),
boxes AS (SELECT vec_id, j, (vec_id * 131 + j * 977) % 1500 AS x1, (vec_id * 71 + j * 463) % 800 AS y1, (vec_id * 131 + j * 977) % 1500 + 200 + (vec_id * 17 + j * 89) % 700 AS x2, (vec_id * 71 + j * 463) % 800 + 150 + (vec_id * 29 + j * 53) % 500 AS y2 FROM embeddings, range(0, 3) AS s(j) WHERE j < vec_id % 4)
"""


def maps(t: Tables) -> DataFrame:
    """The same as DataFrame: vec_id, label, levels (0 to 256), grid (0 to 1), width, boxes, frame_w, frame_h."""
    lo, hi, n = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double"), F.col("vec_id")
    level = F.transform("embedding", lambda x: F.floor((x.cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256))
    amp = F.when(n % 11 == 0, 0.0625).otherwise(1.0)

    def box(j: Column) -> Column:
        x1, y1 = (n * 131 + j * 977) % 1500, (n * 71 + j * 463) % 800
        return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 200 + (n * 17 + j * 89) % 700).cast("double").alias("x2"), (y1 + 150 + (n * 29 + j * 53) % 500).cast("double").alias("y2"), j.cast("long").alias("row"))

    boxes = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda j: j < n % 4), box)
    e = t.read("embeddings").select("vec_id", "label", "embedding", lo.alias("lo"), hi.alias("hi")).withColumn("levels", level)
    grid = F.transform("levels", lambda x: x / 256 * amp)
    return e.select("vec_id", "label", "levels", grid.alias("grid"), F.lit(8).alias("width"), boxes.alias("boxes"), F.lit(WIDTH).alias("frame_w"), F.lit(HEIGHT).alias("frame_h"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


# Connected parts of a mask.


def _labels(masks: pa.ListArray, widths: np.ndarray) -> pa.ListArray:
    """For every cell of all masks at once the number of its part, 0 outside; parts touch by sides or corners, numbered by their first cell."""
    size = np.diff(masks.offsets.to_numpy())
    first = np.cumsum(size) - size
    on = masks.flatten().to_numpy(zero_copy_only=False).astype(bool)
    of = np.repeat(np.arange(len(size)), size)
    at, width = np.arange(len(on)) - first[of], widths[of]
    column, here = at % np.maximum(width, 1), np.arange(len(on))
    a, b = [], []
    for down, right in ((0, 1), (1, -1), (1, 0), (1, 1)):
        to = at + down * width + right
        near = on & (column + right >= 0) & (column + right < width) & (to < size[of])
        near[near] = on[(first[of] + to)[near]]
        a.append(here[near])
        b.append((first[of] + to)[near])
    a, b = np.concatenate(a), np.concatenate(b)
    root = here.copy()
    while True:  # every cell takes the least root that a neighbour has, then its root's root
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b, root[a], root[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    head = on & (root == here)
    number = np.cumsum(head)
    before = np.concatenate([[0], number])[first]  # parts of the masks before
    label = np.where(on, number[root] - before[of], 0).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(label))


def part_labels(df: DataFrame, mask: str, width: str, out: str = "labels") -> DataFrame:
    """df with the array `out`: of each cell of `mask` (array<boolean>) the number of its connected part, 0 where the mask is off or null.

    Parts touch by sides or corners and are numbered from 1 by their first cell in reading order, within the row; rows do
    not meet.  A null mask has a null result; an empty one an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column(mask)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(masks.value_lengths().fill_null(0).to_numpy())]), pa.int32()), masks.flatten().fill_null(False))
            found = _labels(flat, batch.column(width).fill_null(1).to_numpy().astype(np.int64))
            if masks.null_count:
                found = found.take(pa.array(np.where(masks.is_valid().to_numpy(zero_copy_only=False), np.arange(len(masks)), -1), mask=masks.is_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` array<int>"
    return df.mapInArrow(run, schema)


def part_areas(labels: Column) -> Column:
    """Cells of part 1, 2 and so on; empty without parts."""
    most = F.coalesce(F.array_max(labels), F.lit(0))
    return F.when(labels.isNotNull(), F.transform(F.filter(F.sequence(F.lit(0), most), lambda k: k > 0), lambda k: F.size(F.filter(labels, lambda x: x == k)).cast("long")))


def focus(df: DataFrame, share: float = 0.65) -> DataFrame:
    """df (grid, width) with spread (largest less smallest value), labels of the cells bright by `share` of it, areas and the largest part (null without one)."""
    low = F.array_min("grid")
    d = df.withColumn("low", low).withColumn("spread", F.array_max("grid") - F.col("low"))
    d = d.withColumn("bright", F.transform("grid", lambda v: (F.col("spread") > 0) & ((v - F.col("low")) / F.col("spread") >= share)))
    d = part_labels(d, "bright", "width").withColumn("areas", part_areas(F.col("labels"))).drop("bright")
    return d.withColumn("largest", F.when(F.size("areas") > 0, F.array_position("areas", F.array_max("areas")).cast("int")))


def focus_scores(df: DataFrame) -> DataFrame:
    """focus() with scores: of each box the share of the largest part's brightness that lies in it, best first, then by the larger row.

    df: grid, width, boxes (array of x1, y1, x2, y2, row in the frame), frame_w, frame_h.
    """
    d = focus(df).withColumn("rows", (F.size("grid") / F.col("width")).cast("int"))
    lit = F.filter(F.transform("grid", lambda v, i: F.struct((i % F.col("width")).alias("c"), F.floor(i / F.col("width")).alias("r"), (v - F.col("low")).alias("f"), F.get("labels", i).alias("l"))), lambda x: x["l"] == F.col("largest"))
    d = d.withColumn("lit", lit)
    spread = F.nullif(F.col("spread"), F.lit(0.0))  # without contrast there is no largest part, and no score
    whole = F.greatest(total(F.transform("lit", lambda x: x["f"])) / spread, F.lit(1e-6))

    def score(b: Column) -> Column:
        left, right = F.greatest(F.lit(0).cast("long"), F.floor(b["x1"] * F.col("width") / F.col("frame_w"))), F.least(F.col("width").cast("long"), F.ceil(b["x2"] * F.col("width") / F.col("frame_w")))
        top, bottom = F.greatest(F.lit(0).cast("long"), F.floor(b["y1"] * F.col("rows") / F.col("frame_h"))), F.least(F.col("rows").cast("long"), F.ceil(b["y2"] * F.col("rows") / F.col("frame_h")))
        inside = F.filter("lit", lambda x: (x["c"] >= left) & (x["c"] < right) & (x["r"] >= top) & (x["r"] < bottom))
        return F.struct((total(F.transform(inside, lambda x: x["f"])) / spread / F.col("whole")).alias("score"), b["row"].alias("row"))

    scores = F.sort_array(F.transform("boxes", score), asc=False)
    return d.withColumn("whole", whole).withColumn("scores", F.when(F.col("largest").isNotNull(), scores)).drop("lit", "whole", "rows")


BRIGHT = MAPS + """, span AS (SELECT vec_id, min(v) AS low, max(v) - min(v) AS spread FROM cells GROUP BY vec_id),
bright AS (SELECT vec_id, pos, r, c, v - low AS f FROM cells JOIN span USING (vec_id) WHERE spread > 0 AND (v - low) / spread >= 0.65::DOUBLE),
reach AS (SELECT vec_id, pos, pos AS other FROM bright UNION SELECT x.vec_id, x.pos, b.pos FROM reach x JOIN bright a ON a.vec_id = x.vec_id AND a.pos = x.other JOIN bright b ON b.vec_id = x.vec_id AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1),
member AS (SELECT vec_id, pos, min(other) AS head FROM reach GROUP BY vec_id, pos), parts AS (SELECT vec_id, head, count(*) AS area FROM member GROUP BY vec_id, head),
top AS (SELECT vec_id, head, area, total FROM (SELECT *, CAST(sum(area) OVER (PARTITION BY vec_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, head) AS k FROM parts) WHERE k = 1)
"""


@query("agg_components", BRIGHT + "SELECT vec_id, coalesce(n, 0) AS n, coalesce(total, 0) AS cells, area AS largest, head AS first_cell FROM embeddings LEFT JOIN top USING (vec_id) LEFT JOIN (SELECT vec_id, count(*) AS n FROM parts GROUP BY vec_id) USING (vec_id)")
def agg_components(t: Tables) -> DataFrame:
    d = focus(maps(t))
    cells = F.aggregate("areas", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("vec_id", F.size("areas").cast("long").alias("n"), cells.alias("cells"), F.array_max("areas").alias("largest"), (F.array_position("labels", F.col("largest")) - 1).alias("first_cell"))


SCORES = BRIGHT + """, lit AS (SELECT b.vec_id, b.r, b.c, b.f FROM bright b JOIN member m ON m.vec_id = b.vec_id AND m.pos = b.pos JOIN top ON top.vec_id = b.vec_id AND top.head = m.head),
whole AS (SELECT vec_id, greatest(sum(f) / min(spread), 1e-6::DOUBLE) AS whole FROM lit JOIN span USING (vec_id) GROUP BY vec_id),
scores AS (SELECT b.vec_id, b.j, coalesce((SELECT sum(f) FROM lit WHERE lit.vec_id = b.vec_id AND lit.c >= floor(b.x1 * 8 / 1920) AND lit.c < ceil(b.x2 * 8 / 1920) AND lit.r >= floor(b.y1 * 8 / 1080) AND lit.r < ceil(b.y2 * 8 / 1080)), 0) / spread / whole AS score FROM boxes b JOIN span USING (vec_id) JOIN whole USING (vec_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, j DESC) AS rank FROM scores)
"""


@query("rnk_focus_scores", SCORES + f"SELECT vec_id, j AS row, rank, {Q.format('score')} AS score_q FROM ranked")
def rnk_focus_scores(t: Tables) -> DataFrame:
    d = focus_scores(maps(t)).filter("scores IS NOT NULL").select("vec_id", F.posexplode("scores").alias("at", "s"))
    return d.select("vec_id", F.col("s.row").alias("row"), (F.col("at") + 1).cast("long").alias("rank"), q6(F.col("s.score")).alias("score_q"))


def cheap_evidence(df: DataFrame, reason: str = "reason", subjects: str = "subjects") -> Column:
    """Whether a map of focus_scores() alone decides: one compact focus, most of it in one box, and competing boxes clearly behind."""
    occupied = F.aggregate("areas", F.lit(0).cast("long"), lambda a, x: a + x)
    first, second = F.get("scores", F.lit(0)), F.get("scores", F.lit(1))
    compact = (F.col("spread") >= 0.08) & F.col("largest").isNotNull() & (occupied / F.size("grid")).between(0.002, 0.30) & (F.array_max("areas") / occupied >= 0.60)
    open_ = F.col(reason).isin("ambiguous_subjects", "competing_object", "competing_person")
    apart = (F.size("boxes") == 1) | (first["score"] >= 1.5 * F.greatest(second["score"], F.lit(1e-6)))
    known = (F.size(subjects) == 0) | F.array_contains(subjects, first["row"])
    decided = F.when(F.size("boxes") == 0, True).when(first["score"] < 0.65, False).when(open_, apart).otherwise(known)
    return F.when(F.col(reason).isin("overlapping_people", "locked_subject_missing"), False).otherwise(F.coalesce(compact & decided, F.lit(False)))


#: Why the subjects of a frame are not sure, as the router names it.
REASONS = ["overlapping_people", "locked_subject_missing", "competing_person", "competing_object", "ambiguous_subjects", "insufficient_or_stale_pose", "reliable_pose"]
REASON_SQL = "CASE vec_id % 7 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(REASONS)) + " END"


@query(
    "sal_cheap_evidence",
    SCORES
    + f""", why AS (SELECT vec_id, {REASON_SQL} AS reason, vec_id % 4 AS n FROM embeddings),
best AS (SELECT vec_id, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2, max(CASE WHEN rank = 1 THEN j END) AS j1 FROM ranked GROUP BY vec_id)
SELECT vec_id, reason, coalesce(reason NOT IN ('overlapping_people', 'locked_subject_missing') AND spread >= 0.08::DOUBLE AND total / 64 BETWEEN 0.002::DOUBLE AND 0.3::DOUBLE AND area / total >= 0.6::DOUBLE
AND (n = 0 OR (s1 >= 0.65::DOUBLE AND CASE WHEN reason IN ('ambiguous_subjects', 'competing_object', 'competing_person') THEN n = 1 OR s1 >= 1.5 * greatest(s2, 1e-6::DOUBLE) ELSE vec_id % 5 = 0 OR j1 = vec_id % 3 END)), false) AS enough
FROM why JOIN span USING (vec_id) LEFT JOIN top USING (vec_id) LEFT JOIN best USING (vec_id)""",
)
def sal_cheap_evidence(t: Tables) -> DataFrame:
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("vec_id") % 7 + 1).cast("int"))
    subjects = F.when(F.col("vec_id") % 5 == 0, F.array().cast("array<long>")).otherwise(F.array(F.col("vec_id") % 3))
    d = focus_scores(maps(t)).withColumns({"reason": reason, "subjects": subjects})
    return d.select("vec_id", "reason", cheap_evidence(d).alias("enough"))


# Regions of a saliency map.


def saliency_region(df: DataFrame, bounds: tuple[Column, Column, Column, Column], placed: tuple[Column, Column, Column, Column] | None = None, out: str = "region") -> DataFrame:
    """df (grid, width, frame_w, frame_h) with the struct `out`: the bright part of the map within bounds, in the frame's coordinates.

    placed: where in the frame the map lies (left, top, right, bottom; a null left: it covers the whole frame).  Cells count
    from the larger of mean + 0.75 deviations and 0.6 of the largest, else from lower bounds; x, y: their weighted middle;
    confidence: their sum by the cells looked at.  Null for maps that are null, dark within bounds, or lie elsewhere.
    """
    x1, y1, x2, y2 = (b.cast("double") for b in bounds)
    ox = oy = F.lit(0.0)
    fw, fh, elsewhere = F.col("frame_w").cast("double"), F.col("frame_h").cast("double"), F.lit(False)
    if placed is not None:
        own = placed[0].isNotNull()
        ox, oy = (F.when(own, p.cast("double")).otherwise(0.0) for p in placed[:2])
        end_x, end_y = F.when(own, placed[2].cast("double")).otherwise(fw), F.when(own, placed[3].cast("double")).otherwise(fh)
        elsewhere = own & ((x2 <= ox) | (y2 <= oy) | (x1 >= end_x) | (y1 >= end_y))
        x1, y1, x2, y2 = (F.when(own, F.greatest(x1, ox) - ox).otherwise(x1), F.when(own, F.greatest(y1, oy) - oy).otherwise(y1), F.when(own, F.least(x2, end_x) - ox).otherwise(x2), F.when(own, F.least(y2, end_y) - oy).otherwise(y2))
        fw, fh = end_x - ox, end_y - oy
    w, h = F.col("width").cast("double"), F.size("grid") / F.col("width")

    def named(**parts: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    def scaled(b: Column) -> Column:
        return let(named(sx=b["fw"] / w, sy=b["fh"] / h, b=b), first)

    def first(p: Column) -> Column:
        b = p["b"]
        left, top = F.floor(clamp(b["x1"] / p["sx"], F.lit(0.0), w - 1)).cast("double"), F.floor(clamp(b["y1"] / p["sy"], F.lit(0.0), h - 1)).cast("double")
        return let(named(l=left, t=top, r=F.ceil(b["x2"] / p["sx"]).cast("double"), u=F.ceil(b["y2"] / p["sy"]).cast("double"), sx=p["sx"], sy=p["sy"], ox=b["ox"], oy=b["oy"]), looked)

    def looked(p: Column) -> Column:
        return let(named(right=clamp(p["r"], p["l"] + 1, w), bottom=clamp(p["u"], p["t"] + 1, h), p=p), cells)

    def cells(q: Column) -> Column:
        p = q["p"]
        every = F.transform("grid", lambda v, i: named(c=i % F.col("width"), r=F.floor(i / F.col("width")), v=v))
        return let(F.filter(every, lambda x: (x["c"] >= p["l"]) & (x["c"] < q["right"]) & (x["r"] >= p["t"]) & (x["r"] < q["bottom"])), lambda held: sums(p, held))

    def sums(p: Column, held: Column) -> Column:
        values = lambda x: x["v"]
        found = named(n=F.size(held), s=total(F.transform(held, values)), q=total(F.transform(held, lambda x: x["v"] * x["v"])), m=F.array_max(F.transform(held, values)))
        return let(found, lambda k: F.when((k["n"] > 0) & (k["s"] > 1e-6), let(named(dev=F.sqrt(F.greatest(k["n"] * k["q"] - k["s"] * k["s"], F.lit(0.0))) / k["n"], mean=k["s"] / k["n"]), lambda e: bright(p, held, k, e))))

    def bright(p: Column, held: Column, k: Column, e: Column) -> Column:
        high, low = F.greatest(e["mean"] + e["dev"] * 0.75, k["m"] * 0.6), F.greatest(e["mean"] + e["dev"] * 0.25, k["m"] * 0.4)
        return let(F.when(k["m"] >= high, high).otherwise(low), lambda bound: let(F.filter(held, lambda x: x["v"] >= bound), lambda some: let(total(F.transform(some, lambda x: x["v"])), lambda weight: told(p, some, weight, k["n"]))))

    def told(p: Column, some: Column, weight: Column, n: Column) -> Column:
        mid = lambda axis, at: p[at] + total(F.transform(some, lambda x: (x[axis] - p[at]) * x["v"])) / weight
        edge = lambda axis, f: f(F.transform(some, lambda x: x[axis])).cast("double")
        found = named(
            x=mid("c", "l") * p["sx"] + p["ox"],
            y=mid("r", "t") * p["sy"] + p["oy"],
            left=edge("c", F.array_min) * p["sx"] + p["ox"],
            top=edge("r", F.array_min) * p["sy"] + p["oy"],
            right=(edge("c", F.array_max) + 1) * p["sx"] + p["ox"],
            bottom=(edge("r", F.array_max) + 1) * p["sy"] + p["oy"],
            confidence=clamp(weight / n, 0.0, 1.0),
        )
        return F.when(weight > 1e-6, found)

    asked = named(x1=x1, y1=y1, x2=x2, y2=y2, ox=ox, oy=oy, fw=fw, fh=fh)
    return df.withColumn(out, F.when(F.col("grid").isNotNull() & (F.size("grid") > 0) & ~elsewhere, let(asked, scaled)))


#: A third of the maps lie somewhere in the frame, the others cover it; looked at are a box, or the whole frame.
REGIONS = MAPS + """, asked AS (SELECT vec_id, vec_id % 3 = 0 AS own, x1, y1, x2, y2, 240 * (vec_id % 4) AS ox, 90 * (vec_id % 5) AS oy FROM (SELECT vec_id, (vec_id * 131) % 1500 AS x1, (vec_id * 71) % 800 AS y1, (vec_id * 131) % 1500 + 200 + (vec_id * 17) % 700 AS x2, (vec_id * 71) % 800 + 150 + (vec_id * 29) % 500 AS y2 FROM embeddings)),
{0}_in AS (SELECT *, CASE WHEN own THEN {1} ELSE 0 END AS fx, CASE WHEN own THEN {2} ELSE 0 END AS fy, CASE WHEN own THEN 960.0 ELSE 1920.0 END / 8::DOUBLE AS sx, CASE WHEN own THEN 540.0 ELSE 1080.0 END / 8::DOUBLE AS sy FROM ({3})),
{0}_box AS (SELECT *, floor(greatest(0, least(l / sx, 7))) AS cx1, floor(greatest(0, least(t / sy, 7))) AS cy1, ceil(r / sx) AS ex, ceil(b / sy) AS ey FROM (SELECT *, CASE WHEN own THEN greatest(x1, fx) - fx ELSE x1 END AS l, CASE WHEN own THEN greatest(y1, fy) - fy ELSE y1 END AS t, CASE WHEN own THEN least(x2, fx + 960) - fx ELSE x2 END AS r, CASE WHEN own THEN least(y2, fy + 540) - fy ELSE y2 END AS b, own AND (x2 <= fx OR y2 <= fy OR x1 >= fx + 960 OR y1 >= fy + 540) AS gone FROM {0}_in)),
{0}_cells AS (SELECT b.*, k.r AS row, k.c AS col, k.v FROM {0}_box b JOIN cells k USING (vec_id) WHERE NOT gone AND k.c >= cx1 AND k.c < greatest(cx1 + 1, least(ex, 8)) AND k.r >= cy1 AND k.r < greatest(cy1 + 1, least(ey, 8))),
{0}_stat AS (SELECT vec_id, count(*) AS n, sum(v) AS s, sqrt(greatest(count(*) * sum(v * v) - sum(v) * sum(v), 0)) / count(*) AS dev, max(v) AS m FROM {0}_cells GROUP BY vec_id),
{0}_cut AS (SELECT *, CASE WHEN m >= greatest(s / n + dev * 0.75::DOUBLE, m * 0.6::DOUBLE) THEN greatest(s / n + dev * 0.75::DOUBLE, m * 0.6::DOUBLE) ELSE greatest(s / n + dev * 0.25::DOUBLE, m * 0.4::DOUBLE) END AS bound FROM {0}_stat WHERE s > 1e-6),
{0} AS (SELECT vec_id, (min(cx1) + sum((col - cx1) * v) / sum(v)) * min(sx) + min(fx) AS x, (min(cy1) + sum((row - cy1) * v) / sum(v)) * min(sy) + min(fy) AS y, min(col) * min(sx) + min(fx) AS l, min(row) * min(sy) + min(fy) AS t, (max(col) + 1) * min(sx) + min(fx) AS r, (max(row) + 1) * min(sy) + min(fy) AS b, greatest(0, least(sum(v) / min(n), 1)) AS confidence FROM {0}_cells JOIN {0}_cut USING (vec_id) WHERE v >= bound GROUP BY vec_id HAVING sum(v) > 1e-6)
"""


@query("agg_saliency_region", REGIONS.format("region", "ox", "oy", "SELECT * FROM asked") + f"SELECT vec_id, {', '.join(f'{Q.format(c)} AS {c}' for c in ('x', 'y', 'l', 't', 'r', 'b', 'confidence'))} FROM embeddings LEFT JOIN region USING (vec_id)")
def agg_saliency_region(t: Tables) -> DataFrame:
    n = F.col("vec_id")
    x1, y1 = (n * 131) % 1500, (n * 71) % 800
    ox, oy = F.when(n % 3 == 0, 240 * (n % 4)), 90 * (n % 5)
    d = saliency_region(maps(t), (x1, y1, x1 + 200 + (n * 17) % 700, y1 + 150 + (n * 29) % 500), (ox, oy, ox + 960, oy + 540))
    return d.select("vec_id", *[q6(F.col(f"region.{c}")).alias(a) for c, a in (("x", "x"), ("y", "y"), ("left", "l"), ("top", "t"), ("right", "r"), ("bottom", "b"), ("confidence", "confidence"))])


def global_target(df: DataFrame, placed: tuple[Column, Column, Column, Column] | None, base: tuple[int, int], frame: tuple[int, int], zooms: tuple[float, float]) -> DataFrame:
    """df with `target`: the crop for the whole map's bright region, null where that is missing or weak (under 0.02)."""
    whole = F.lit(0), F.lit(0), F.lit(frame[0]), F.lit(frame[1])
    d = saliency_region(df, whole, placed)

    def aimed(r: Column) -> Column:
        return F.when(r["confidence"] >= 0.02, camera_target((r["left"], r["top"], r["right"], r["bottom"]), clamp(r["confidence"], 0.12, 0.55), base, frame, zooms))

    return d.withColumn("target", let(F.col("region"), aimed))


@query(
    "dec_global_saliency",
    REGIONS.format("region", "ox", "oy", "SELECT vec_id, own, 0 AS x1, 0 AS y1, 1920 AS x2, 1080 AS y2, ox, oy FROM asked")
    + f""", inside AS (SELECT *, greatest(l0 + 1, least(r, 1920)) AS r0, greatest(t0 + 1, least(b, 1080)) AS b0 FROM (SELECT *, greatest(0, least(l, 1919)) AS l0, greatest(0, least(t, 1079)) AS t0 FROM region WHERE confidence >= 0.02::DOUBLE)),
zoomed AS (SELECT *, greatest(1.0::DOUBLE, least(least(608 / least(1920, r0 - l0 + 2 * greatest((r0 - l0) * 0.12::DOUBLE, 16)), 1080 / least(1080, b0 - t0 + 2 * greatest((b0 - t0) * 0.16::DOUBLE, 20))), 1.6::DOUBLE)) AS zoom FROM inside),
crop AS (SELECT *, greatest(64, least(round_even(608 / zoom, 0), 1920)) AS cw, greatest(64, least(round_even(1080 / zoom, 0), 1080)) AS ch FROM zoomed)
SELECT vec_id, {Q.format('greatest(cw / 2, least((l0 + r0) / 2, 1920 - cw / 2))')} AS center_x, {Q.format('greatest(ch / 2, least((t0 + b0) / 2, 1080 - ch / 2))')} AS center_y, {Q.format('zoom')} AS zoom, {Q.format('greatest(0.12::DOUBLE, least(confidence, 0.55::DOUBLE))')} AS confidence FROM crop""",
)
def dec_global_saliency(t: Tables) -> DataFrame:
    n = F.col("vec_id")
    ox, oy = F.when(n % 3 == 0, 240 * (n % 4)), 90 * (n % 5)
    d = global_target(maps(t), (ox, oy, ox + 960, oy + 540), (608, 1080), (WIDTH, HEIGHT), (1.0, 1.6)).filter("target IS NOT NULL")
    return d.select("vec_id", *[q6(F.col(f"target.{c}")).alias(c) for c in ("center_x", "center_y", "zoom", "confidence")])


# Moments of masks.


def mask_stats(df: DataFrame, mask: str = "grid", out: str = "stats") -> DataFrame:
    """df (mask values, width, frame_w, frame_h) with the struct `out` of the cells over 0.5: size, middle and top, in the frame's coordinates.

    The mask is the frame letterboxed into its shape; what lies in the padding is left out.  Null without cells.
    """
    w, h, fw, fh = F.col("width"), (F.size(mask) / F.col("width")).cast("int"), F.col("frame_w"), F.col("frame_h")

    def padded(gain: Column) -> Column:
        return let(F.struct(((w - F.bround(fw * gain)) / 2).alias("x"), ((h - F.bround(fh * gain)) / 2).alias("y")), shown)

    def shown(pad: Column) -> Column:
        left, top = (F.bround(pad[k] - 0.1).cast("int") for k in "xy")
        right, bottom = ((size - F.bround(pad[k] + 0.1)).cast("int") for size, k in ((w, "x"), (h, "y")))
        return let(F.struct(left.alias("l"), top.alias("t"), (right - left).alias("w"), (bottom - top).alias("h")), cells)

    def cells(e: Column) -> Column:
        every = F.transform(mask, lambda v, i: F.struct((i % w - e["l"]).alias("c"), (F.floor(i / w) - e["t"]).alias("r"), (v > 0.5).alias("on")))
        return let(F.filter(every, lambda x: x["on"] & (x["c"] >= 0) & (x["c"] < e["w"]) & (x["r"] >= 0) & (x["r"] < e["h"])), lambda on: told(e, on))

    def told(e: Column, on: Column) -> Column:
        n, sx, sy = F.size(on), fw / e["w"], fh / e["h"]
        mean = lambda k: total(F.transform(on, lambda x: x[k].cast("double"))) / n
        found = F.struct((n * sx * sy).alias("area"), ((mean("c") + 0.5) * sx - 0.5).alias("cx"), ((mean("r") + 0.5) * sy - 0.5).alias("cy"), (F.array_min(F.transform(on, lambda x: x["r"])) * sy).alias("top"))
        return F.when(n > 0, found)

    return df.withColumn(out, let(F.least(h / fh, w / fw), padded))


SHAPES = [(1920, 1080), (1080, 1920), (720, 720), (1000, 500)]


@query(
    "agg_mask_stats",
    MAPS
    + """, shape AS (SELECT vec_id, CASE vec_id % 4 """
    + " ".join(f"WHEN {k} THEN {w}" for k, (w, _) in enumerate(SHAPES))
    + " END AS w, CASE vec_id % 4 "
    + " ".join(f"WHEN {k} THEN {h}" for k, (_, h) in enumerate(SHAPES))
    + f""" END AS h FROM embeddings),
pad AS (SELECT *, (8 - round_even(w * g, 0)) / 2 AS pw, (8 - round_even(h * g, 0)) / 2 AS ph FROM (SELECT *, least(8 / h, 8 / w) AS g FROM shape)),
edge AS (SELECT vec_id, w, h, round_even(pw - 0.1::DOUBLE, 0) AS l, round_even(ph - 0.1::DOUBLE, 0) AS t, 8 - round_even(pw + 0.1::DOUBLE, 0) AS r, 8 - round_even(ph + 0.1::DOUBLE, 0) AS b FROM pad),
seen AS (SELECT vec_id, count(*) AS n, sum(k.c - l) AS sc, sum(k.r - t) AS sr, min(k.r - t) AS top, min(w / (e.r - l)) AS sx, min(h / (b - t)) AS sy FROM cells k JOIN edge e USING (vec_id) WHERE v > 0.5::DOUBLE AND k.c >= l AND k.c < e.r AND k.r >= t AND k.r < b GROUP BY vec_id)
SELECT vec_id, {Q.format('n * sx * sy')} AS area, {Q.format('(sc / n + 0.5::DOUBLE) * sx - 0.5::DOUBLE')} AS cx, {Q.format('(sr / n + 0.5::DOUBLE) * sy - 0.5::DOUBLE')} AS cy, {Q.format('top * sy')} AS top FROM seen""",
)
def agg_mask_stats(t: Tables) -> DataFrame:
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in SHAPES]), (F.col("vec_id") % 4 + 1).cast("int"))
    d = mask_stats(maps(t).withColumns({"frame_w": pick(0), "frame_h": pick(1)})).filter("stats IS NOT NULL")
    return d.select("vec_id", *[q6(F.col(f"stats.{c}")).alias(c) for c in ("area", "cx", "cy", "top")])


# Thumbnails: change between frames, and cuts.


def area_tiles(grid: Column, width: Column, height: Column, across: int, down: int) -> Column:
    """The grid resampled to across x down tiles, each the mean of the area it covers; cells on an edge count by their part.

    Sums are of whole multiples of 1 / (across * down) of a cell, so they are exact for whole values; each cell is read once or twice.
    """

    def spans(size: Column, tiles: int, j: Column) -> tuple[Column, Column, Column]:
        first, last = F.floor(size * j / tiles), F.floor((size * (j + 1) - 1) / tiles)
        return first, last, lambda c: F.least(tiles * (c + 1), size * (j + 1)) - F.greatest(tiles * c, size * j)

    def row(r: Column) -> Column:
        def cell(j: Column) -> Column:
            first, last, share = spans(width, across, j)
            return F.aggregate(F.sequence(first, last), F.lit(0.0), lambda a, c: a + F.get(grid, (r * width + c).cast("int")) * share(c))

        return F.transform(F.sequence(F.lit(0), F.lit(across - 1)), cell)

    rows = F.transform(F.sequence(F.lit(0), height - 1), row)

    def column(i: Column) -> Column:
        first, last, share = spans(height, down, i)
        return F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda j: F.aggregate(F.sequence(first, last), F.lit(0.0), lambda a, r: a + F.get(F.get(rows, r.cast("int")), j) * share(r)) / (width * height))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), column))


def frame_change(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """df (gray: whole values 0 to 255, width) with what changed since the frame before of the same shape: mean, and the largest of 8 x 6 tiles, rounded.

    changed: mean over 18 or tile over 35.  Null for a first frame, and where the shape is another.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_old", F.lag(F.struct("gray", "width")).over(w))
    same = (F.col("_old.width") == F.col("width")) & (F.size("_old.gray") == F.size("gray"))
    d = d.withColumn("_delta", F.when(same, F.zip_with("gray", "_old.gray", lambda a, b: F.abs(a - b).cast("double"))))
    tiles = area_tiles(F.col("_delta"), F.col("width"), (F.size("_delta") / F.col("width")).cast("int"), 8, 6)
    d = d.withColumns({"mean": total(F.col("_delta")) / F.nullif(F.size("_delta"), F.lit(0)), "tile": F.when(F.col("_delta").isNotNull(), F.bround(F.array_max(tiles)))})
    return d.withColumn("changed", (F.col("mean") > 18) | (F.col("tile") > 35)).drop("_old", "_delta")


#: Frames of a video (label) in order; grey levels move little within seven frames and jump between.
GRAYS = MAPS + """, grays AS (SELECT label AS video, vec_id, pos, r, c, 40 * ((vec_id // 40) % 3) + floor(g / CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 8 END) AS p FROM cells),
numbered AS (SELECT label AS video, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame FROM embeddings)
"""


def grays(t: Tables) -> DataFrame:
    n = F.col("vec_id")
    gray = F.transform("levels", lambda x: 40 * (F.floor(n / 40) % 3) + F.floor(x / F.when(n % 5 == 0, 2).otherwise(8)))
    return maps(t).select(F.col("label").alias("video"), "vec_id", gray.alias("gray"), "width")


@query(
    "agg_frame_change",
    GRAYS
    + f""", delta AS (SELECT b.vec_id, x.pos, x.r, x.c, abs(x.p - y.p) AS d FROM numbered a JOIN numbered b ON a.video = b.video AND b.frame = a.frame + 1 JOIN grays x ON x.vec_id = b.vec_id JOIN grays y ON y.vec_id = a.vec_id AND y.pos = x.pos),
tiles AS (SELECT vec_id, c, i, sum(d * 8 * (least(6 * (r + 1), 8 * (i + 1)) - greatest(6 * r, 8 * i))) / 64 AS v FROM delta, range(0, 6) AS s(i) WHERE least(6 * (r + 1), 8 * (i + 1)) > greatest(6 * r, 8 * i) GROUP BY vec_id, c, i),
most AS (SELECT vec_id, round_even(max(v), 0) AS tile FROM tiles GROUP BY vec_id), mean AS (SELECT vec_id, sum(d) / 64 AS mean FROM delta GROUP BY vec_id)
SELECT vec_id, {Q.format('mean')} AS mean_q, CAST(tile AS BIGINT) AS tile, mean > 18 OR tile > 35 AS changed FROM mean JOIN most USING (vec_id)""",
)
def agg_frame_change(t: Tables) -> DataFrame:
    d = frame_change(grays(t), ["vec_id"], ["video"]).filter("mean IS NOT NULL")
    return d.select("vec_id", q6(F.col("mean")).alias("mean_q"), F.col("tile").cast("long").alias("tile"), "changed")


def histogram(bins: Column) -> Column:
    """How often each value of an array occurs, as a map sorted by value: ends of runs in the sorted array, no dense table."""
    held = F.array_sort(bins)
    ends = F.filter(F.transform(held, lambda b, i: F.struct(b.alias("bin"), (i + 1).alias("end"), (i + 1 == F.size(held)).alias("last"), F.get(held, i + 1).alias("next"))), lambda x: x["last"] | (x["bin"] != x["next"]))
    counts = F.transform(ends, lambda x, i: F.struct(x["bin"].alias("key"), (x["end"] - F.when(i > 0, F.get(ends, i - 1)["end"]).otherwise(0)).cast("long").alias("value")))
    return F.map_from_entries(counts)


def cut_stats(frames: DataFrame) -> DataFrame:
    """frames (video, frame, pixels: array of b, g, r) with delta (mean change of grey, 0 to 1) and distance (Bhattacharyya, of 8 x 8 x 8 colour histograms) to the frame before.

    Null for a video's first frame.  Histograms hold met bins only; those of two frames meet by bin.
    """
    w = Window.partitionBy("video").orderBy("frame")
    gray = F.transform("pixels", lambda p: F.floor((p["r"] * 4899 + p["g"] * 9617 + p["b"] * 1868 + 8192) / 16384))
    bins = F.transform("pixels", lambda p: (F.floor(p["b"] / 32) * 64 + F.floor(p["g"] / 32) * 8 + F.floor(p["r"] / 32)).cast("int"))
    d = frames.withColumns({"_gray": gray, "_hist": histogram(bins)})
    d = d.withColumns({"_old": F.lag("_gray").over(w), "_before": F.lag("_hist").over(w), "_n": F.size("pixels"), "_m": F.lag(F.size("pixels")).over(w)})
    delta = total(F.zip_with("_gray", "_old", lambda a, b: F.abs(a - b).cast("double"))) / F.nullif(F.size("_gray"), F.lit(0)) / 255
    shared = F.filter(F.map_keys("_hist"), lambda k: F.map_contains_key("_before", k))
    both = total(F.transform(shared, lambda k: F.sqrt((F.element_at("_hist", k) * F.element_at("_before", k)).cast("double"))))
    distance = F.sqrt(F.greatest(1 - both / F.nullif(F.sqrt((F.col("_n") * F.col("_m")).cast("double")), F.lit(0.0)), F.lit(0.0)))
    return d.withColumns({"delta": delta, "distance": F.when(F.col("_before").isNotNull(), distance)}).drop("_gray", "_hist", "_old", "_before", "_n", "_m")


def cuts(stats: DataFrame, least_frames: int = 15, factor: float = 3.0) -> DataFrame:
    """Cuts of cut_stats(): the first frame, and those at least `least_frames` after the last cut whose histogram is far away, or whose change is far
    over the median of up to 30 since then and the histogram apart."""

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        last, history = state
        if row["delta"] is None:
            return (row["frame"], history), (None, None, True)
        usual = max(0.10, (median(history) if history else 0.0) * factor)
        cut = row["frame"] - last >= least_frames and ((row["delta"] > usual and row["distance"] > 0.25) or row["distance"] > 0.72)
        history.append(row["delta"])
        if cut:
            history.clear()
        return (row["frame"] if cut else last, history), (row["delta"], row["distance"], cut)

    return fold(stats.select("video", "frame", "delta", "distance"), ["video"], ["frame"], "delta double, distance double, cut boolean", lambda: (0, deque(maxlen=30)), step)


#: Twenty-one pixels a frame, whose colours move little within forty frames of the table and jump between.
PIXELS = GRAYS + """, pixels AS (SELECT n.video, n.frame, n.vec_id, k, 20 + 60 * ((n.vec_id // 40) % 3) + floor(x.g / 8) AS b, 50 + 40 * ((n.vec_id // 40) % 4) + floor(y.g / 6) AS gr, 30 + 50 * ((n.vec_id // 40) % 3) + floor(z.g / 8) AS rd FROM numbered n, range(0, 21) AS s(k) JOIN cells x ON x.vec_id = n.vec_id AND x.pos = k JOIN cells y ON y.vec_id = n.vec_id AND y.pos = k + 21 JOIN cells z ON z.vec_id = n.vec_id AND z.pos = k + 42),
gray AS (SELECT *, floor((rd * 4899 + gr * 9617 + b * 1868 + 8192) / 16384) AS y, floor(b / 32) * 64 + floor(gr / 32) * 8 + floor(rd / 32) AS bin FROM pixels),
hist AS (SELECT video, frame, bin, count(*) AS n FROM gray GROUP BY ALL),
near AS (SELECT a.video, a.frame, list_reduce(list_prepend(0.0::DOUBLE, list(sqrt(CAST(a.n * b.n AS DOUBLE)) ORDER BY a.bin)), lambda p, q: p + q) AS shared FROM hist a JOIN hist b ON a.video = b.video AND a.frame = b.frame + 1 AND a.bin = b.bin GROUP BY a.video, a.frame),
moved AS (SELECT a.video, a.frame, sum(abs(a.y - b.y)) / 21 / 255 AS delta FROM gray a JOIN gray b ON a.video = b.video AND a.frame = b.frame + 1 AND a.k = b.k GROUP BY a.video, a.frame),
stats AS MATERIALIZED (SELECT video, frame, delta, CASE WHEN delta IS NOT NULL THEN sqrt(greatest(1 - coalesce(shared, 0) / sqrt(441.0::DOUBLE), 0)) END AS distance FROM numbered LEFT JOIN moved USING (video, frame) LEFT JOIN near USING (video, frame)),
run AS (SELECT video, frame, true AS cut, frame AS last, CAST([] AS DOUBLE[]) AS h FROM stats WHERE frame = 1
UNION ALL SELECT video, frame, cut, CASE WHEN cut THEN frame ELSE last END, CASE WHEN cut THEN CAST([] AS DOUBLE[]) ELSE list_append(h, delta)[-30:] END FROM (SELECT s.video, s.frame, s.delta, r.last, r.h, s.frame - r.last >= 5 AND ((s.delta > greatest(0.1::DOUBLE, coalesce(list_aggregate(r.h, 'median'), 0) * 3) AND s.distance > 0.25::DOUBLE) OR s.distance > 0.72::DOUBLE) AS cut FROM run r JOIN stats s ON s.video = r.video AND s.frame = r.frame + 1))
"""


def colours(t: Tables) -> DataFrame:
    scene, level = F.floor(F.col("vec_id") / 40), lambda k: F.get("levels", k)
    pixel = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.struct((20 + 60 * (scene % 3) + F.floor(level(k) / 8)).alias("b"), (50 + 40 * (scene % 4) + F.floor(level(k + 21) / 6)).alias("g"), (30 + 50 * (scene % 3) + F.floor(level(k + 42) / 8)).alias("r")))
    frame = F.row_number().over(Window.partitionBy("video").orderBy("vec_id")).cast("long")
    return maps(t).withColumnRenamed("label", "video").select("video", frame.alias("frame"), pixel.alias("pixels"))


@query("agg_cut_stats", PIXELS + f"SELECT s.video, s.frame, {Q.format('delta')} AS delta_q, {Q.format('distance')} AS distance_q, cut FROM stats s JOIN run USING (video, frame)")
def agg_cut_stats(t: Tables) -> DataFrame:
    cut = cuts(cut_stats(colours(t)), least_frames=5)
    return cut.select("video", "frame", q6(F.col("delta")).alias("delta_q"), q6(F.col("distance")).alias("distance_q"), "cut")
