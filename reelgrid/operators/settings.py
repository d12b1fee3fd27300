"""Settings of runs as rows: what presets and profiles fill in, what follows from that, which rules are broken, and the encoder's options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import finite, q6
from ..plans.catalog import Tables, query

Q = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"

# What each preset sets (classes, least and most zoom, steps), what settings are by default, and the names that some may have.
PRESETS = [
    ("talking_head", ["person"], 1.00, 1.85, 6.0, 4.0),
    ("sports", ["person", "car", "bicycle", "motorcycle"], 1.00, 1.35, 12.0, 8.0),
    ("pets", ["dog", "cat", "person"], 1.00, 1.55, 10.0, 7.0),
    ("cars", ["car", "truck", "bus", "motorcycle", "person"], 1.00, 1.30, 11.0, 7.0),
]
DEFAULTS: dict[str, tuple[str, object]] = {
    "input": ("string", "in.mp4"), "output": ("string", "out.mp4"), "diagnose_env": ("boolean", False), "max_frames": ("long", None), "stats_interval": ("double", 0.0), "precrop": ("string", None),
    "video_decoder": ("string", "torchcodec"), "decode_device": ("string", "cuda:0"), "decode_batch_size": ("long", 4), "frame_processing": ("string", "reference"), "tracking_profile": ("string", "balanced"),
    "seg_max_gap": ("long", 6), "seg_max_age": ("double", 0.1), "seg_thumbnail_mode": ("string", "lazy"), "seg_thumbnail_method": ("string", "gray-area"), "seg_skip_policy": ("string", "primary"), "conf": ("double", 0.3),
    "output_width": ("long", 1080), "output_height": ("long", 1920), "zoom_alpha": ("double", 0.035), "target_alpha": ("double", 0.08), "motion_response": ("double", 0.08), "motion_damping": ("double", 0.92),
    "zoom_response": ("double", 0.05), "zoom_damping": ("double", 0.9), "max_missed_frames": ("long", 40), "min_subject_hold_frames": ("long", 14), "max_step_x": ("double", None), "max_step_y": ("double", None),
    "min_zoom": ("double", None), "max_zoom": ("double", None), "fixed_zoom": ("double", None), "pose_model": ("string", "pose.pt"), "pose_imgsz": ("long", 640), "pose_conf": ("double", 0.25), "keypoint_conf": ("double", 0.35),
    "pose_batch_size": ("long", 4), "crf": ("long", 18), "video_encoder": ("string", "auto"), "lost_hold_seconds": ("double", None), "subject_hold_seconds": ("double", None), "zoom_hold_seconds": ("double", 0.4),
    "dead_zone": ("double", 0.0), "zoom_dead_zone": ("double", 0.04), "cue_interval": ("double", 0.2), "pose_max_age": ("double", 0.35), "cue_top_k": ("long", 0), "saliency_max_failures": ("long", 3), "saliency_interval": ("long", 3),
    "saliency_ema": ("double", 0.65), "scene_downscale": ("long", 4), "pan_time": ("double", None), "zoom_time": ("double", None), "target_time": ("double", None), "pan_speed_x": ("double", None), "pan_speed_y": ("double", None),
    "zoom_speed": ("double", None), "prediction_window": ("double", 0.3), "lookahead_seconds": ("double", 0.12),
}
CHOICES = {
    "precrop": ["middle", "left", "right"],
    "video_decoder": ["opencv", "torchcodec"],
    "frame_processing": ["reference", "tensor"],
    "tracking_profile": ["conservative", "balanced", "fast"],
    "seg_thumbnail_mode": ["lazy", "eager"],
    "seg_thumbnail_method": ["gray-area", "bgr-area"],
    "seg_skip_policy": ["primary", "all"],
    "video_encoder": ["auto", "libx264", "libx265", "h264_nvenc", "hevc_nvenc", "h264_videotoolbox", "hevc_videotoolbox"],
}


def settings(df: DataFrame, given: dict[str, Column]) -> DataFrame:
    """df with a column for each setting: what is given, else the default."""
    return df.withColumns({name: given[name].cast(kind) if name in given else F.lit(value).cast(kind) for name, (kind, value) in DEFAULTS.items()})


def with_preset(df: DataFrame, preset: str = "preset") -> DataFrame:
    """Settings rows with what their preset fills in where they say nothing (classes: array; zooms, steps), and the times and speeds that follow.

    Older ways to say a time (response, damping, alpha, frames at 30 a second) count where the time itself is null.  Unknown presets have no row.
    """
    dim = df.sparkSession.createDataFrame(PRESETS, f"{preset} string, p_classes array<string>, p_min_zoom double, p_max_zoom double, p_max_step_x double, p_max_step_y double")
    d = df.join(F.broadcast(dim), preset)
    filled = ["min_zoom", "max_zoom", "max_step_x", "max_step_y"]
    d = d.withColumns({c: F.coalesce(c, f"p_{c}") for c in filled} | {"classes": F.coalesce("classes", "p_classes") if "classes" in df.columns else F.col("p_classes")}).drop("p_classes", *[f"p_{c}" for c in filled])
    root = lambda scale, part, name: scale * F.sqrt(part / F.col(f"{name}_response"))
    least = lambda name, usual: F.greatest(F.lit(0.2), F.col(f"{name}_damping") / usual)
    follows = {
        "dead_zone": F.lit(0.0),
        "pan_time": root(0.35, F.lit(0.08), "motion") * least("motion", 0.92),
        "zoom_time": root(0.60, F.lit(0.05), "zoom") * least("zoom", 0.90),
        "target_time": -(1 / 30) / F.log1p(-F.least(F.col("target_alpha"), F.lit(0.999))),
        "pan_speed_x": F.col("max_step_x") * 30 / 1920,
        "pan_speed_y": F.col("max_step_y") * 30 / 1080,
        "zoom_speed": F.col("zoom_alpha") * 30,
        "lost_hold_seconds": F.col("max_missed_frames") / 30.0,
        "subject_hold_seconds": F.col("min_subject_hold_frames") / 30.0,
    }
    return d.withColumns({name: F.coalesce(F.col(name), value) for name, value in follows.items()})


PICKED = "CASE run % 4 " + " ".join(f"WHEN {k} THEN {{{k}}}" for k in range(4)) + " END"


@query(
    "prj_preset",
    f"""SELECT run, preset, classes, min_zoom, {Q.format('mz')} AS max_zoom, {Q.format('sx * 30 / 1920')} AS pan_speed_x, {Q.format('sy * 30 / 1080')} AS pan_speed_y, {Q.format('0.35::DOUBLE * sqrt(0.08::DOUBLE / mr) * greatest(0.2::DOUBLE, md / 0.92::DOUBLE)')} AS pan_time, {Q.format('0.6::DOUBLE * sqrt(0.05::DOUBLE / 0.05::DOUBLE) * greatest(0.2::DOUBLE, md / 0.9::DOUBLE)')} AS zoom_time,
{Q.format('-(1 / 30::DOUBLE) / ln(1 - least(ta, 0.999::DOUBLE))')} AS target_time, {Q.format('coalesce(CASE WHEN run % 6 = 0 THEN 0.75 END, 40 / 30::DOUBLE)')} AS lost_hold FROM (SELECT run, {PICKED.format(*[f"'{p[0]}'" for p in PRESETS])} AS preset, {PICKED.format(*[f"'{','.join(p[1])}'" for p in PRESETS])} AS classes, CASE WHEN run % 9 = 0 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS min_zoom, CASE WHEN run % 3 = 0 THEN 1.5::DOUBLE ELSE {PICKED.format(*[f"{p[3]}::DOUBLE" for p in PRESETS])} END AS mz,
CASE WHEN run % 5 = 0 THEN 9.0::DOUBLE ELSE {PICKED.format(*[f"{p[4]}::DOUBLE" for p in PRESETS])} END AS sx, {PICKED.format(*[f"{p[5]}::DOUBLE" for p in PRESETS])} AS sy, 0.0625::DOUBLE + run % 5 / 64 AS mr, run % 8 / 8 AS md, CASE WHEN run % 7 = 0 THEN 1.0::DOUBLE ELSE 0.125::DOUBLE END AS ta FROM (SELECT o_orderkey AS run FROM orders))""",
)
def prj_preset(t: Tables) -> DataFrame:
    run = F.col("run")
    name = F.element_at(F.array(*[F.lit(p[0]) for p in PRESETS]), (run % 4 + 1).cast("int"))
    given = {
        "max_zoom": F.when(run % 3 == 0, 1.5), "min_zoom": F.when(run % 9 == 0, 1.25), "max_step_x": F.when(run % 5 == 0, 9.0), "motion_response": 0.0625 + run % 5 / 64, "motion_damping": run % 8 / 8, "zoom_damping": run % 8 / 8,
        "target_alpha": F.when(run % 7 == 0, 1.0).otherwise(0.125), "lost_hold_seconds": F.when(run % 6 == 0, 0.75),
    }
    d = with_preset(settings(t.read("orders").select(F.col("o_orderkey").alias("run")).withColumn("preset", name), given))
    told = {"max_zoom": "max_zoom", "pan_speed_x": "pan_speed_x", "pan_speed_y": "pan_speed_y", "pan_time": "pan_time", "zoom_time": "zoom_time", "target_time": "target_time", "lost_hold": "lost_hold_seconds"}
    return d.select("run", "preset", F.array_join("classes", ",").alias("classes"), "min_zoom", *[q6(F.col(c)).alias(a) for a, c in told.items()])


def rules() -> dict[str, Column]:
    """What holds for settings that may be run, by name."""
    c = F.col
    is_in = lambda name: c(name).isin(CHOICES[name])
    some = lambda name, ok: c(name).isNull() | (finite(c(name)) & ok(c(name)))
    above = lambda name: some(name, lambda v: v > 0)
    not_below = lambda name, low: some(name, lambda v: v >= low)
    found = {
        "paths": c("diagnose_env") | ((F.length("input") > 0) & (F.length("output") > 0)),
        "pose_imgsz": (c("pose_imgsz") >= 32) & (c("pose_imgsz") % 32 == 0),
        "pose_batch_size": c("pose_batch_size") >= 1,
        "pose_model": c("pose_model").rlike(r"(?i)[^/]\.pt$"),
        "max_frames": c("max_frames").isNull() | (c("max_frames") >= 1),
        "stats_interval": finite(c("stats_interval")) & (c("stats_interval") >= 0),
        "precrop": c("precrop").isNull() | is_in("precrop"),
        "tensor_decoder": (c("frame_processing") != "tensor") | (c("video_decoder") == "torchcodec"),
        "decode_device": c("decode_device").rlike(r"^(cpu|cuda|cuda:[0-9]+)\z"),
        "decode_batch_size": c("decode_batch_size").between(1, 8),
        "seg_max_gap": c("seg_max_gap") >= 1,
        "seg_max_age": finite(c("seg_max_age")) & (c("seg_max_age") > 0),
        "saliency_interval": c("saliency_interval") >= 1,
        "scene_downscale": c("scene_downscale") >= 1,
        "saliency_ema": (c("saliency_ema") > 0) & (c("saliency_ema") <= 1),
        "lookahead_seconds": c("lookahead_seconds").between(0, 1),
        "output_size": (c("output_width") >= 64) & (c("output_height") >= 64) & (c("output_width") % 2 == 0) & (c("output_height") % 2 == 0),
        "conf": c("conf").between(0, 1),
        "crf": c("crf").between(0, 51),
        "hold_frames": (c("max_missed_frames") >= 0) & (c("min_subject_hold_frames") >= 0),
        "cue_top_k": c("cue_top_k") >= 0,
        "saliency_max_failures": c("saliency_max_failures") >= 1,
        "zoom_order": c("min_zoom").isNull() | c("max_zoom").isNull() | (c("min_zoom") <= c("max_zoom")),
        "zoom_within": c("fixed_zoom").isNull() | ((c("min_zoom").isNull() | (c("fixed_zoom") >= c("min_zoom"))) & (c("max_zoom").isNull() | (c("fixed_zoom") <= c("max_zoom")))),
    }
    found |= {name: is_in(name) for name in CHOICES if name != "precrop"}
    found |= {name: finite(c(name)) & (c(name) > 0) & (c(name) <= 1) for name in ("pose_conf", "keypoint_conf", "motion_response", "zoom_response", "zoom_alpha", "target_alpha")}
    found |= {name: c(name).between(0, 1) for name in ("motion_damping", "zoom_damping")}
    found |= {name: c(name).isNotNull() & not_below(name, 0) for name in ("cue_interval", "pose_max_age")}
    found |= {name: above(name) for name in ("pan_time", "zoom_time", "target_time", "pan_speed_x", "pan_speed_y", "zoom_speed", "prediction_window", "max_step_x", "max_step_y")}
    found |= {name: not_below(name, 0) for name in ("lost_hold_seconds", "subject_hold_seconds", "zoom_hold_seconds")}
    found |= {name: not_below(name, 1) for name in ("min_zoom", "max_zoom", "fixed_zoom")}
    return found | {name: c(name).isNull() | c(name).between(0, 0.4) for name in ("dead_zone", "zoom_dead_zone")}


def rule_faults(df: DataFrame, checks: dict[str, Column], keys: list[str]) -> DataFrame:
    """keys and rule: a row for each rule that a row breaks; a rule that comes out as null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


#: A setting that breaks just the rule of that name.
NAN = float("nan")
FAULTS: list[tuple[str, dict[str, object]]] = [
    ("paths", {"input": ""}), ("pose_imgsz", {"pose_imgsz": 100}), ("pose_batch_size", {"pose_batch_size": 0}), ("pose_model", {"pose_model": "pose.onnx"}), ("max_frames", {"max_frames": 0}), ("stats_interval", {"stats_interval": -1.0}),
    ("precrop", {"precrop": "top"}), ("tensor_decoder", {"frame_processing": "tensor", "video_decoder": "opencv"}), ("decode_device", {"decode_device": "cuda:"}), ("decode_batch_size", {"decode_batch_size": 9}), ("seg_max_gap", {"seg_max_gap": 0}),
    ("seg_max_age", {"seg_max_age": NAN}), ("saliency_interval", {"saliency_interval": 0}), ("scene_downscale", {"scene_downscale": 0}), ("saliency_ema", {"saliency_ema": 0.0}), ("lookahead_seconds", {"lookahead_seconds": 1.5}), ("output_size", {"output_width": 1081}),
    ("conf", {"conf": 1.1}), ("crf", {"crf": 52}), ("hold_frames", {"max_missed_frames": -1}), ("cue_top_k", {"cue_top_k": -1}), ("saliency_max_failures", {"saliency_max_failures": 0}), ("zoom_order", {"min_zoom": 2.0, "max_zoom": 1.5}),
    ("zoom_within", {"min_zoom": 1.2, "fixed_zoom": 1.1}), *[(name, {name: "other"}) for name in CHOICES if name != "precrop"], *[(name, {name: 0.0}) for name in ("pose_conf", "keypoint_conf", "motion_response", "zoom_response", "zoom_alpha", "target_alpha")],
    *[(name, {name: 1.5}) for name in ("motion_damping", "zoom_damping")], ("cue_interval", {"cue_interval": -0.1}), ("pose_max_age", {"pose_max_age": float("inf")}), *[(name, {name: 0.0}) for name in ("pan_time", "zoom_time", "target_time", "pan_speed_x", "pan_speed_y", "zoom_speed", "prediction_window", "max_step_x", "max_step_y")],
    *[(name, {name: -1.0}) for name in ("lost_hold_seconds", "subject_hold_seconds", "zoom_hold_seconds")], ("min_zoom", {"min_zoom": 0.5}), ("max_zoom", {"max_zoom": 0.5}), ("fixed_zoom", {"fixed_zoom": NAN}), *[(name, {name: 0.5}) for name in ("dead_zone", "zoom_dead_zone")],
]


@query("flt_config_rules", f"SELECT run, rule FROM (SELECT o_orderkey AS run FROM orders) JOIN (VALUES {', '.join(f'({k}, {chr(39)}{name}{chr(39)})' for k, (name, _) in enumerate(FAULTS))}) f(k, rule) ON run % {len(FAULTS) + 5} = k")
def flt_config_rules(t: Tables) -> DataFrame:
    """Orders as settings, most of them with one fault, chosen by the key."""
    given: dict[str, Column] = {}
    for k, (_, values) in enumerate(FAULTS):
        for name, value in values.items():
            here = F.when(F.col("run") % (len(FAULTS) + 5) == k, F.lit(value).cast(DEFAULTS[name][0]))
            given[name] = F.coalesce(given[name], here) if name in given else here
    kind = lambda name: DEFAULTS[name][0]
    given = {name: F.coalesce(value, F.lit(DEFAULTS[name][1]).cast(kind(name))) for name, value in given.items()}
    return rule_faults(settings(t.read("orders").select(F.col("o_orderkey").alias("run")), given), rules(), ["run"])


def encoder_args(encoder: Column, quality: Column, preset: Column, nvenc_preset: Column, bitrate: Column) -> Column:
    """An encoder's options as one string: a quality for x264, x265 and NVENC (there without a bound on the rate), a rate for all others."""
    q = quality.cast("string")
    plain = F.concat_ws(" ", F.lit("-crf"), q, F.lit("-preset"), preset)
    nvenc = F.concat_ws(" ", F.lit("-cq"), q, F.lit("-preset"), nvenc_preset, F.lit("-rc vbr -b:v 0"))
    return F.when(encoder.isin("libx264", "libx265"), plain).when(encoder.endswith("_nvenc"), nvenc).otherwise(F.concat_ws(" ", F.lit("-b:v"), bitrate))


def video_filters(restore: Column) -> Column:
    """The filters of a restored picture; null for none."""
    return F.when(restore, "hqdn3d=1.2:1.2:6:6,unsharp=5:5:0.6:5:5:0.0")


ENCODERS = ["libx264", "libx265", "h264_nvenc", "hevc_nvenc", "h264_videotoolbox", "hevc_videotoolbox"]


@query(
    "snk_encoder_args",
    "SELECT run, CASE run % 6 WHEN 0 THEN '-crf ' || crf || ' -preset medium' WHEN 1 THEN '-crf ' || crf || ' -preset medium' WHEN 2 THEN '-cq ' || crf || ' -preset p' || p || ' -rc vbr -b:v 0' WHEN 3 THEN '-cq ' || crf || ' -preset p' || p || ' -rc vbr -b:v 0' ELSE '-b:v 8M' END AS options, CASE WHEN run % 4 = 0 THEN 'hqdn3d=1.2:1.2:6:6,unsharp=5:5:0.6:5:5:0.0' END AS filters FROM (SELECT o_orderkey AS run, o_orderkey % 52 AS crf, 1 + o_custkey % 7 AS p FROM orders)",
)
def snk_encoder_args(t: Tables) -> DataFrame:
    run = F.col("run")
    encoder = F.element_at(F.array(*map(F.lit, ENCODERS)), (run % 6 + 1).cast("int"))
    d = t.read("orders").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("p"), (1 + F.col("o_custkey") % 7).cast("string")).alias("p"))
    return d.select("run", encoder_args(encoder, run % 52, F.lit("medium"), F.col("p"), F.lit("8M")).alias("options"), video_filters(run % 4 == 0).alias("filters"))
