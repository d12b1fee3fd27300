"""Records of runs: what their media, timings, devices and settings say, and audits of these (rows are violations).

The functions take DataFrames with the columns that they name; the queries below them
bind these to the driver's tables, with faults put in so that audits find something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import finite, q6
from ..plans.catalog import Tables, query

RUNS = """WITH runs AS (SELECT o_orderkey AS run, o_custkey AS who, o_orderpriority AS case_name, CAST(o_orderkey % 4 AS BIGINT) AS repeat, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status, o_totalprice AS wall FROM orders),
timings AS (SELECT l_orderkey AS run, concat('phase_', l_linenumber) AS phase, sum(CASE WHEN l_orderkey % 23 = 0 THEN -1 ELSE 1 END * l_quantity) AS seconds FROM lineitem GROUP BY ALL),
totals AS (SELECT run, sum(seconds) + CASE WHEN run % 17 = 0 THEN 0.5 ELSE 0 END AS total FROM timings GROUP BY run),
streams AS (SELECT run, side, kind, 100 + run % 50 + CASE WHEN side = 'output' AND run % 13 = 0 THEN 1 ELSE 0 END AS n_frames, CASE WHEN side = 'output' AND run % 19 = 0 THEN '25/1' WHEN run % 3 = 0 THEN '30000/1001' ELSE '30/1' END AS fps,
CASE WHEN kind = 'audio' AND run % 11 = 0 THEN 'N/A' ELSE CAST(CASE WHEN kind = 'audio' THEN run % 7 ELSE 0 END AS VARCHAR) END AS start_time, 3 + CASE WHEN kind = 'audio' THEN run % 4 ELSE 2 END AS duration FROM runs, (VALUES ('source'), ('output')) s(side), (VALUES ('video'), ('audio')) k(kind) WHERE kind = 'video' OR run % 5 <> 0 OR (side = 'output' AND run % 35 = 0)),
calls AS (SELECT run, model, CASE WHEN run % 29 = 0 THEN -1 ELSE (run + n) % 3 END AS calls, CASE WHEN (run + n) % 5 = 0 THEN 'cpu' ELSE 'cuda:0' END AS device FROM runs, (VALUES ('segmentation', 0), ('pose', 1), ('deepgaze', 2)) m(model, n))
"""


def runs(t: Tables) -> DataFrame:
    return t.read("orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("who"), F.col("o_orderpriority").alias("case_name"), (F.col("o_orderkey") % 4).alias("repeat"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), F.col("o_totalprice").alias("wall"))


def timings(t: Tables) -> DataFrame:
    sign = F.when(F.col("l_orderkey") % 23 == 0, -1).otherwise(1)
    return t.read("lineitem").groupBy(F.col("l_orderkey").alias("run"), F.concat(F.lit("phase_"), "l_linenumber").alias("phase")).agg(F.sum(sign * F.col("l_quantity")).alias("seconds"))


def totals(t: Tables) -> DataFrame:
    return timings(t).groupBy("run").agg(F.sum("seconds").alias("total")).withColumn("total", F.col("total") + F.when(F.col("run") % 17 == 0, 0.5).otherwise(0.0))


def _each(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def streams(t: Tables) -> DataFrame:
    run, side, kind = F.col("run"), F.col("side"), F.col("kind")
    s = _each(_each(runs(t).select("run"), "side", ["source", "output"]), "kind", ["video", "audio"]).filter((kind == "video") | (run % 5 != 0) | ((side == "output") & (run % 35 == 0)))
    return s.select(
        "run", "side", "kind", (100 + run % 50 + F.when((side == "output") & (run % 13 == 0), 1).otherwise(0)).alias("n_frames"),
        F.when((side == "output") & (run % 19 == 0), "25/1").when(run % 3 == 0, "30000/1001").otherwise("30/1").alias("fps"),
        F.when((kind == "audio") & (run % 11 == 0), "N/A").otherwise(F.when(kind == "audio", run % 7).otherwise(0).cast("string")).alias("start_time"),
        (3 + F.when(kind == "audio", run % 4).otherwise(2)).alias("duration"),
    )


def calls(t: Tables) -> DataFrame:
    n = F.array_position(F.array(*map(F.lit, ("segmentation", "pose", "deepgaze"))), F.col("model")) - 1
    c = _each(runs(t).select("run"), "model", ["segmentation", "pose", "deepgaze"])
    return c.select("run", "model", F.when(F.col("run") % 29 == 0, -1).otherwise((F.col("run") + n) % 3).alias("calls"), F.when((F.col("run") + n) % 5 == 0, "cpu").otherwise("cuda:0").alias("device"))


def rate(text: Column) -> Column:
    """A fraction "num/den" as a double; null where it is none."""
    parts = F.split(text, "/")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)))


def timing_sums(parts: DataFrame, whole: DataFrame, required: list[str]) -> DataFrame:
    """Runs whose timings lack a required phase, are negative or not finite, or do not sum up to the total."""
    g = parts.groupBy("run").agg(F.sum("seconds").alias("added"), F.min(F.coalesce(finite(F.col("seconds")) & (F.col("seconds") >= 0), F.lit(False))).alias("fine"), F.collect_set("phase").alias("held"))
    j = whole.join(g, "run", "left")
    lacks = F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce("held", F.array().cast("array<string>")))) > 0
    bad = ~F.coalesce(F.col("fine") & finite(F.col("total")) & (F.col("total") >= 0), F.lit(False))
    off = F.abs(F.col("added") - F.col("total")) > 1e-4 + 1e-6 * F.col("total")
    return j.select("run", F.when(lacks, "missing").when(bad, "invalid").when(off, "sum").alias("fault")).filter("fault IS NOT NULL")


@query("aud_timing_sum", RUNS + "SELECT * FROM (SELECT run, CASE WHEN NOT (list_contains(held, 'phase_1') AND list_contains(held, 'phase_2')) THEN 'missing' WHEN low < 0 OR total < 0 THEN 'invalid' WHEN abs(added - total) > 1e-4 + 1e-6 * total THEN 'sum' END AS fault FROM totals JOIN (SELECT run, sum(seconds) AS added, min(seconds) AS low, list(DISTINCT phase) AS held FROM timings GROUP BY run) USING (run)) WHERE fault IS NOT NULL")
def aud_timing_sum(t: Tables) -> DataFrame:
    return timing_sums(timings(t), totals(t), ["phase_1", "phase_2"])


def alias_faults(stages: DataFrame, phases: DataFrame) -> DataFrame:
    """Stages (run, phase, seconds) whose seconds differ from those of the phase of that name, or that have no such phase."""
    return stages.join(phases.withColumnRenamed("seconds", "told"), ["run", "phase"], "left").filter(~F.col("seconds").eqNullSafe(F.col("told"))).select("run", "phase")


@query("aud_stage_alias", RUNS + "SELECT s.run, s.phase FROM timings s LEFT JOIN (SELECT * FROM timings WHERE run % 37 <> 0) p ON s.run = p.run AND s.phase = p.phase WHERE s.phase IN ('phase_1', 'phase_3') AND (CASE WHEN s.run % 31 = 0 THEN s.seconds + 1 ELSE s.seconds END) IS DISTINCT FROM p.seconds")
def aud_stage_alias(t: Tables) -> DataFrame:
    all_ = timings(t)
    told = all_.filter(F.col("phase").isin("phase_1", "phase_3")).withColumn("seconds", F.when(F.col("run") % 31 == 0, F.col("seconds") + 1).otherwise(F.col("seconds")))
    return alias_faults(told, all_.filter("run % 37 <> 0"))


def counter_faults(counters: DataFrame) -> DataFrame:
    """Counters (run, key, value: string as JSON has it) that are no whole number from 0."""
    ok = F.coalesce(F.col("value").rlike("^[0-9]+$"), F.lit(False)) & F.col("key").isNotNull()
    return counters.filter(~ok).select("run", "key")


@query("aud_optional", RUNS + "SELECT run, phase AS key FROM timings WHERE run % 23 = 0 OR run % 41 = 0")
def aud_optional(t: Tables) -> DataFrame:
    value = F.when(F.col("run") % 41 == 0, "true").otherwise(F.col("seconds").cast("long").cast("string"))
    return counter_faults(timings(t).select("run", F.col("phase").alias("key"), value.alias("value")))


def schema_faults(emitted: DataFrame, rows: DataFrame) -> DataFrame:
    """Runs whose summary (run, version, n) is of another version, or counts other segments than there are (run, n_rows), or none."""
    j = emitted.join(rows, "run", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return j.select("run", F.when(F.col("version") != 1, "version").when((F.col("n") != F.col("n_rows")) | (F.col("n_rows") == 0), "count").alias("fault")).filter("fault IS NOT NULL")


@query("aud_seg_schema", RUNS + "SELECT * FROM (SELECT run, CASE WHEN run % 43 = 0 THEN 'version' WHEN coalesce(n, 0) = 0 OR run % 47 = 0 THEN 'count' END AS fault FROM runs LEFT JOIN (SELECT run, count(*) AS n FROM timings GROUP BY run) USING (run)) WHERE fault IS NOT NULL")
def aud_seg_schema(t: Tables) -> DataFrame:
    n = timings(t).groupBy("run").agg(F.count("*").alias("n_rows"))
    told = runs(t).join(n, "run", "left").select("run", F.when(F.col("run") % 43 == 0, 2).otherwise(1).alias("version"), (F.coalesce("n_rows", F.lit(0)) + F.when(F.col("run") % 47 == 0, 1).otherwise(0)).alias("n"))
    return schema_faults(told, n)


def sides(media: DataFrame) -> DataFrame:
    """A row for each run: frames, rate and audio of its source and its output."""
    video, out = F.col("kind") == "video", []
    for side in ("source", "output"):
        here = F.col("side") == side
        out += [F.max(F.when(here & video, F.col("n_frames"))).alias(f"{side}_frames"), F.max(F.when(here & video, F.col("fps"))).alias(f"{side}_fps"), F.bool_or(here & ~video).alias(f"{side}_audio")]
    return media.groupBy("run").agg(*out)


def output_faults(media: DataFrame, limit: int | None = None) -> DataFrame:
    """The first of what is wrong with a run's output: its frames, its rate, its audio."""
    s = sides(media)
    expected = F.col("source_frames") if limit is None else F.least("source_frames", F.lit(limit))
    a, b = rate(F.col("source_fps")), rate(F.col("output_fps"))
    fault = F.when(~expected.eqNullSafe(F.col("output_frames")), "frames").when(F.coalesce((a <= 0) | (F.abs(a - b) > 1e-6), F.lit(True)), "rate").when(F.col("source_audio") != F.col("output_audio"), "audio")
    return s.select("run", fault.alias("fault")).filter("fault IS NOT NULL")


@query("aud_output", RUNS + "SELECT run, CASE WHEN run % 13 = 0 THEN 'frames' WHEN run % 19 = 0 THEN 'rate' ELSE 'audio' END AS fault FROM runs WHERE run % 13 = 0 OR run % 19 = 0 OR run % 35 = 0")
def aud_output(t: Tables) -> DataFrame:
    return output_faults(streams(t))


def device_states(used: DataFrame, asked: str) -> DataFrame:
    """Models (run, model, calls, device) as not exercised, verified on what was asked for, exercised, or at fault."""
    wanted = F.lit(None).cast("string") if asked in ("auto", "cpu", "mps") else F.lit("cuda:" + ("0" if asked == "cuda" else asked.removeprefix("cuda:")))
    state = F.when(F.col("calls").isNull() | (F.col("calls") < 0), "invalid count").when(F.col("calls") == 0, "not exercised").when(wanted.isNull(), "exercised").when(F.col("device") == wanted, "verified").otherwise("other device")
    return used.select("run", "model", state.alias("state"))


@query("aud_devices", RUNS + "SELECT run, model, CASE WHEN calls < 0 THEN 'invalid count' WHEN calls = 0 THEN 'not exercised' WHEN device = 'cuda:0' THEN 'verified' ELSE 'other device' END AS state FROM calls")
def aud_devices(t: Tables) -> DataFrame:
    return device_states(calls(t), "cuda")


@query("aud_models_cpu", RUNS + "SELECT run, model FROM calls WHERE calls > 0 AND device <> 'cpu'")
def aud_models_cpu(t: Tables) -> DataFrame:
    """Models that ran elsewhere although the CPU was asked for."""
    return cpu_faults(calls(t))


def cpu_faults(used: DataFrame) -> DataFrame:
    return used.filter((F.col("calls") > 0) & ~F.col("device").eqNullSafe(F.lit("cpu"))).select("run", "model")


def decoder_states(io: DataFrame, decoder: str, processing: str, asked: str) -> DataFrame:
    """io: run, decoder, processing, fell_back, device, yielded, processed, cpu_fallback (null: not known)."""
    c, wanted = F.col, "cuda:0" if asked == "cuda" else asked
    used = F.when(c("device") == "cuda", "cuda:0").otherwise(c("device"))
    state = F.when(~(c("decoder").eqNullSafe(F.lit(decoder)) & c("processing").eqNullSafe(F.lit(processing))), "other profile").when(c("fell_back"), "fell back")
    if decoder == "opencv":
        state = state.when(~c("device").eqNullSafe(F.lit("cpu")), "no cpu").otherwise("cpu baseline")
    else:
        state = state.when(~c("yielded").eqNullSafe(c("processed")), "frames").when(~used.eqNullSafe(F.lit(wanted)), "other device")
        state = state.when(c("cpu_fallback").isNull() | c("cpu_fallback"), "unverified").otherwise("verified") if wanted.startswith("cuda") else state.otherwise("cpu test")
    return io.select("run", state.alias("state"))


@query("aud_decoder", RUNS + "SELECT run, CASE WHEN run % 3 = 1 THEN 'other profile' WHEN run % 5 = 0 THEN 'fell back' WHEN run % 7 = 0 THEN 'frames' WHEN run % 11 = 0 THEN 'other device' WHEN run % 13 = 0 OR run % 17 = 0 THEN 'unverified' ELSE 'verified' END AS state FROM runs")
def aud_decoder(t: Tables) -> DataFrame:
    r = F.col("run")
    io = runs(t).select(
        "run", F.when(r % 3 == 1, "opencv").otherwise("torchcodec").alias("decoder"), F.lit("gpu").alias("processing"), (r % 5 == 0).alias("fell_back"), F.when(r % 11 == 0, "cpu").otherwise("cuda").alias("device"),
        F.lit(10).alias("yielded"), F.when(r % 7 == 0, 9).otherwise(10).alias("processed"), F.when(r % 13 == 0, True).when(r % 17 == 0, None).otherwise(False).alias("cpu_fallback"),
    )
    return decoder_states(io, "torchcodec", "gpu", "cuda")


def endpoints(media: DataFrame, side: str = "output") -> DataFrame:
    """Where a run's video and audio end (start + duration), and by how much the audio ends later."""
    start = F.col("start_time").try_cast("double")
    end = lambda kind: F.max(F.when(F.col("kind") == kind, start + F.col("duration")))
    rates = F.max(F.when(F.col("kind") == "video", F.col("fps")))
    g = media.filter(F.col("side") == side).groupBy("run").agg(end("video").alias("video_end"), end("audio").alias("audio_end"), rates.alias("fps"), F.bool_or(F.col("kind") == "audio").alias("audio"))
    return g.withColumn("later", F.col("audio_end") - F.col("video_end"))


@query("aud_endpoints", RUNS + f"SELECT run, CAST(floor(max(e) FILTER (kind = 'video') * 1e6 + 0.5) AS BIGINT) AS video_end, CAST(floor(max(e) FILTER (kind = 'audio') * 1e6 + 0.5) AS BIGINT) AS audio_end, CAST(floor((max(e) FILTER (kind = 'audio') - max(e) FILTER (kind = 'video')) * 1e6 + 0.5) AS BIGINT) AS later FROM (SELECT *, TRY_CAST(start_time AS DOUBLE) + duration AS e FROM streams WHERE side = 'output') GROUP BY run")
def aud_endpoints(t: Tables) -> DataFrame:
    return endpoints(streams(t)).select("run", *[q6(F.col(c)).alias(c) for c in ("video_end", "audio_end", "later")])


def audio_tails(media: DataFrame) -> DataFrame:
    """How the audio of a run's output ends: within max(0.1 s, two frames) of the video, or what is wrong with it."""
    had = media.filter("side = 'source'").groupBy("run").agg(F.bool_or(F.col("kind") == "audio").alias("had"))
    e = endpoints(media).join(had, "run", "left")
    near = F.abs("later") <= F.greatest(F.lit(0.1), 2 / rate(F.col("fps"))) + 1e-6
    state = F.when(~F.coalesce("had", F.lit(False)), F.when(F.col("audio"), "gained audio").otherwise("no source audio")).when(~F.col("audio"), "lost audio").when(F.col("later").isNull(), "invalid").when(near, "within").otherwise("too far")
    return e.select("run", state.alias("state"))


@query("aud_audio_tail", RUNS + "SELECT run, CASE WHEN run % 5 = 0 THEN CASE WHEN run % 35 = 0 THEN 'gained audio' ELSE 'no source audio' END WHEN run % 11 = 0 THEN 'invalid' WHEN run % 7 + run % 4 = 2 THEN 'within' ELSE 'too far' END AS state FROM runs")
def aud_audio_tail(t: Tables) -> DataFrame:
    return audio_tails(streams(t))


def canonical(fields: dict[str, Column]) -> Column:
    """A flat object as JSON with sorted keys and no spaces; refuses what is not finite."""
    parts = []
    for name in sorted(fields):
        value = fields[name]
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def text(value: Column) -> Column:
    """A string as JSON has it, control characters escaped; null stays null."""
    return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


IDENTITY = """sha256(concat('{"case":"', case_name, '","max_frames":', CASE WHEN run % 2 = 0 THEN 'null' ELSE '180' END, ',"source":', who, '}'))"""


def identities(r: DataFrame, max_frames: Column) -> Column:
    return F.sha2(canonical({"source": F.col("who").cast("string"), "case": text(F.col("case_name")), "max_frames": max_frames.cast("string")}), 256)


def _asked(t: Tables) -> DataFrame:
    r = runs(t)
    return r.withColumn("max_frames", F.when(F.col("run") % 2 == 1, 180))


@query("aud_identity", RUNS + f"SELECT run, {IDENTITY} AS digest FROM runs")
def aud_identity(t: Tables) -> DataFrame:
    r = _asked(t)
    return r.select("run", identities(r, F.col("max_frames")).alias("digest"))


@query("jn_reuse", RUNS + f", d AS (SELECT *, {IDENTITY} AS digest FROM runs) SELECT a.run, max(b.run) AS reused FROM d a JOIN d b ON a.digest = b.digest AND b.status = 'ok' AND b.run < a.run AND b.run % 6 <> 0 GROUP BY a.run")
def jn_reuse(t: Tables) -> DataFrame:
    """The newest earlier record that succeeded with the same identity and whose output is whole."""
    r = _asked(t)
    d = r.withColumn("digest", identities(r, F.col("max_frames")))
    whole = (F.col("status") == "ok") & (F.col("run") % 6 != 0)
    # Along the runs of one identity, the last whole one before each.
    before = F.last(F.when(whole, F.col("run")), ignorenulls=True).over(Window.partitionBy("digest").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    return d.select("run", before.alias("reused")).filter("reused IS NOT NULL")


def unproved(full: DataFrame, smoke: DataFrame, keys: list[str]) -> DataFrame:
    """Full runs without a successful short one of the same settings."""
    return full.join(smoke.filter("status = 'ok'").select(*keys).distinct(), keys, "left_anti")


@query("aud_full_needs_smoke", RUNS + "SELECT run FROM runs f WHERE run % 2 = 0 AND NOT EXISTS (SELECT 1 FROM runs s WHERE s.run % 2 = 1 AND s.status = 'ok' AND s.who = f.who AND s.case_name = f.case_name)")
def aud_full_needs_smoke(t: Tables) -> DataFrame:
    r = _asked(t)
    return unproved(r.filter("max_frames IS NULL"), r.filter("max_frames = 180"), ["who", "case_name"]).select("run")


def setting_faults(told: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Settings (run, key, value) that differ from what was asked for."""
    want = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    return told.withColumn("wanted", F.try_element_at(want, F.col("key"))).filter("wanted IS NOT NULL AND NOT (value <=> wanted)").select("run", "key", "value", "wanted")


@query("aud_tracking_match", RUNS + "SELECT run, key, value, wanted FROM (SELECT run, 'gap' AS key, CAST(1 + run % 6 AS VARCHAR) AS value, '6' AS wanted FROM runs UNION ALL SELECT run, 'profile', CASE WHEN run % 10 = 0 THEN 'fast' ELSE 'balanced' END, 'balanced' FROM runs) WHERE value <> wanted")
def aud_tracking_match(t: Tables) -> DataFrame:
    r = runs(t).select("run", (1 + F.col("run") % 6).cast("string").alias("gap"), F.when(F.col("run") % 10 == 0, "fast").otherwise("balanced").alias("profile"))
    return setting_faults(r.unpivot("run", ["gap", "profile"], "key", "value"), {"gap": "6", "profile": "balanced"})


def dims_faults(frames: DataFrame) -> DataFrame:
    return frames.filter("width <> context_width OR height <> context_height").select("run", "width", "height")


@query("aud_context_dims", RUNS + "SELECT run, CAST(1920 AS BIGINT) AS width, 1080 + run % 2 AS height FROM runs WHERE run % 2 = 1")
def aud_context_dims(t: Tables) -> DataFrame:
    wide = F.lit(1920).cast("long")
    return dims_faults(runs(t).select("run", wide.alias("width"), (1080 + F.col("run") % 2).alias("height"), wide.alias("context_width"), F.lit(1080).cast("long").alias("context_height")))


# Sources.


def runtime_info(log: DataFrame) -> DataFrame:
    """Versions that a log line names; null where it names none."""
    p = r"PyTorch=(\S+) CUDA build=(\S+) CUDA available=(\S+)"
    got = lambda k: F.nullif(F.regexp_extract("line", p, k), F.lit(""))
    return log.select("run", got(1).alias("torch"), got(2).alias("build"), got(3).alias("available"))


@query("src_runtime_info", RUNS + "SELECT run, CASE WHEN run % 4 > 0 THEN concat('2.', run % 9) END AS torch, CASE WHEN run % 4 > 0 THEN '12.4' END AS build, CASE WHEN run % 4 > 0 THEN CASE WHEN run % 3 = 0 THEN 'True' ELSE 'False' END END AS available FROM runs")
def src_runtime_info(t: Tables) -> DataFrame:
    r = F.col("run")
    line = F.when(r % 4 > 0, F.concat(F.lit("I PyTorch=2."), r % 9, F.lit(" CUDA build=12.4 CUDA available="), F.when(r % 3 == 0, "True").otherwise("False"))).otherwise("I no versions")
    return runtime_info(runs(t).select("run", line.alias("line")))


# Fields of a media stream that are kept.
STREAM_FIELDS = ["index", "codec_type", "codec_name", "width", "height", "r_frame_rate", "avg_frame_rate", "nb_frames", "nb_read_frames", "start_time", "duration", "duration_ts", "time_base", "sample_rate", "channels"]


def probed(found: DataFrame) -> DataFrame:
    """Streams of probe reports (run, report: JSON), a row each, with the fields that are kept, as strings."""
    schema = "streams array<struct<" + ", ".join(f"`{f}`: string" for f in STREAM_FIELDS) + ">>"
    return found.select("run", F.explode(F.from_json("report", schema)["streams"]).alias("s")).select("run", "s.*")


@query("src_probe", RUNS + "SELECT run, kind AS codec_type, fps AS avg_frame_rate, CAST(n_frames AS VARCHAR) AS nb_read_frames FROM streams WHERE side = 'source'")
def src_probe(t: Tables) -> DataFrame:
    one = F.struct(F.col("kind").alias("codec_type"), F.col("fps").alias("avg_frame_rate"), F.col("n_frames").alias("nb_read_frames"), F.lit("x").alias("title"))
    reports = streams(t).filter("side = 'source'").groupBy("run").agg(F.to_json(F.struct(F.collect_list(one).alias("streams"))).alias("report"))
    return probed(reports).select("run", "codec_type", "avg_frame_rate", "nb_read_frames")


def newest(records: DataFrame, schema: str) -> DataFrame:
    """The newest readable record (run, attempt, json) of each run; unreadable ones are skipped."""
    read = records.select("run", "attempt", F.from_json("json", schema).alias("r")).filter("r.status IS NOT NULL")
    return read.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("attempt")))).filter("k = 1").select("run", "attempt", "r.*")


@query("src_records", RUNS + "SELECT run, concat('attempt-', lpad(CAST(CASE WHEN run % 3 = 0 THEN 1 ELSE 2 END AS VARCHAR), 3, '0')) AS attempt, status FROM runs")
def src_records(t: Tables) -> DataFrame:
    r = _each(runs(t), "n", [1, 2]).withColumn("attempt", F.concat(F.lit("attempt-"), F.lpad(F.col("n").cast("string"), 3, "0")))
    return newest(r.select("run", "attempt", F.when((F.col("run") % 3 == 0) & (F.col("n") == 2), '{"status').otherwise(F.to_json(F.struct("status"))).alias("json")), "status string")


def speaker_segments(files: DataFrame) -> DataFrame:
    """Segments of speaker files (run, json): a list, or an object with one under `segments`; anything else gives none."""
    kind = "array<struct<start: double, end: double, track_id: long, scene_index: long>>"
    found = F.when(F.col("json").rlike(r"^\s*\["), F.from_json("json", kind)).otherwise(F.from_json("json", f"segments {kind}")["segments"])
    return files.select("run", F.explode(found).alias("s")).select("run", "s.*").filter("start IS NOT NULL AND end IS NOT NULL")


@query("src_speaker_json", RUNS + "SELECT run, CAST(floor(2e6 + 0.5) AS BIGINT) AS start_q, who AS track_id, repeat AS scene_index FROM runs WHERE run % 3 < 2")
def src_speaker_json(t: Tables) -> DataFrame:
    one = F.to_json(F.array(F.struct(F.lit(2.0).alias("start"), F.lit(3.5).alias("end"), F.col("who").alias("track_id"), F.col("repeat").alias("scene_index"))))
    file = F.when(F.col("run") % 3 == 0, one).when(F.col("run") % 3 == 1, F.concat(F.lit('{"segments":'), one, F.lit("}"))).otherwise("not json")
    return speaker_segments(runs(t).select("run", file.alias("json"))).select("run", q6(F.col("start")).alias("start_q"), "track_id", "scene_index")


@query("src_decoder_choice", RUNS + "SELECT run, CASE WHEN run % 3 = 2 AND run % 7 > 0 THEN 'opencv' WHEN run % 3 < 2 THEN 'torchcodec' END AS decoder, CASE WHEN run % 3 = 2 THEN CASE WHEN run % 7 = 0 THEN 'fatal' ELSE 'unavailable' END END AS fallback_reason FROM runs")
def src_decoder_choice(t: Tables) -> DataFrame:
    """The decoder asked for; the other one where it fails before its first frame, unless the failure is fatal."""
    failed, fatal = F.col("run") % 3 == 2, F.col("run") % 7 == 0
    return runs(t).select("run", F.when(~failed, "torchcodec").when(~fatal, "opencv").alias("decoder"), F.when(failed, F.when(fatal, "fatal").otherwise("unavailable")).alias("fallback_reason"))


@query("src_env")
def src_env(t: Tables) -> DataFrame:
    """What this session runs on, as keys and values."""
    import platform
    import sys

    facts = {"python": sys.version.split()[0], "platform": platform.platform(), "spark": t.spark.version, "master": t.spark.sparkContext.master}
    return t.spark.createDataFrame(sorted(facts.items()), "key string, value string")


# Sinks: what is written, and the ways to write it.


def column_union(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under the sorted union of their columns; what a table lacks is null."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.select(*[F.col(f"`{c}`") for c in sorted(out.columns)])


def write_csv(path: str, *tables: DataFrame) -> None:
    column_union(*tables).write.option("header", True).option("nullValue", "").csv(path)


@query("snk_csv", RUNS + "SELECT case_name, CASE WHEN status = 'failed' THEN 'stopped' END AS error, run, CASE WHEN status = 'ok' THEN wall END AS wall FROM runs")
def snk_csv(t: Tables) -> DataFrame:
    r = runs(t)
    return column_union(r.filter("status = 'ok'").select("run", "case_name", "wall"), r.filter("status <> 'ok'").select("run", F.lit("stopped").alias("error"), "case_name"))


@query("srt_segments_csv", "SELECT name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS place FROM (VALUES ('case_name'), ('error'), ('run'), ('wall')) v(name)")
def srt_segments_csv(t: Tables) -> DataFrame:
    """The header of the table that snk_csv writes."""
    return t.spark.createDataFrame(list(zip(snk_csv(t).columns, range(1, 99))), "name string, place long")


def labelled_segments(segments: DataFrame, r: DataFrame) -> DataFrame:
    """Segments with the four columns that say which run they are of."""
    return segments.join(r.select("run", "case_name", "repeat", (F.col("repeat") == 0).alias("warmup"), "status"), "run")


def write_segments(path: str, segments: DataFrame, r: DataFrame) -> None:
    rows = labelled_segments(segments, r)
    rows.write.json(f"{path}/jsonl")
    write_csv(f"{path}/csv", rows)


@query("snk_run_segments", RUNS + "SELECT run, phase, CAST(floor(seconds * 1e6 + 0.5) AS BIGINT) AS seconds_q, case_name, repeat, repeat = 0 AS warmup, status FROM timings JOIN runs USING (run)")
def snk_run_segments(t: Tables) -> DataFrame:
    s = timings(t).select("run", "phase", q6(F.col("seconds")).alias("seconds_q"))
    return labelled_segments(s, runs(t)).select("run", "phase", "seconds_q", "case_name", "repeat", "warmup", "status")


def aggregates(r: DataFrame, numbers: list[str]) -> DataFrame:
    """Medians of runs that succeeded and are no warm-up, by case; a column counts where all its values are finite."""
    good = r.filter((F.col("status") == "ok") & (F.col("repeat") > 0))
    out = [F.when(F.bool_and(F.coalesce(finite(F.col(c)), F.lit(False))), F.median(c)).alias(f"median_{c}") for c in numbers]
    return good.groupBy("case_name").agg(F.count("*").alias("measured_runs"), *out)


@query("snk_results", RUNS + "SELECT case_name, count(*) AS measured_runs, CAST(floor(median(wall) * 1e6 + 0.5) AS BIGINT) AS median_wall, CAST(floor(median(who) * 1e6 + 0.5) AS BIGINT) AS median_who FROM runs WHERE status = 'ok' AND repeat > 0 GROUP BY case_name")
def snk_results(t: Tables) -> DataFrame:
    a = aggregates(runs(t), ["wall", "who"])
    return a.select("case_name", "measured_runs", q6(F.col("median_wall")).alias("median_wall"), q6(F.col("median_who").cast("double")).alias("median_who"))


def write_results(path: str, r: DataFrame, segments: DataFrame, numbers: list[str]) -> None:
    """results.json and the three tables beside it; each appears whole or not at all, as Spark commits it."""
    r.write.json(f"{path}/results.json")
    write_csv(f"{path}/results.csv", r)
    write_csv(f"{path}/aggregates.csv", aggregates(r, numbers))
    write_csv(f"{path}/segments.csv", labelled_segments(segments, r))


def merged(parts: dict[str, Column]) -> Column:
    """Maps as one, each key behind its part's prefix."""

    def behind(prefix: str):
        return lambda key, _: F.concat(F.lit(prefix), key)

    return F.map_concat(*[F.transform_keys(m, behind(p)) for p, m in parts.items()])


@query("agg_summary_merge", RUNS + "SELECT run, concat('pose_', phase) AS key, CAST(floor(seconds * 1e6 + 0.5) AS BIGINT) AS value_q FROM timings UNION ALL SELECT run, concat('seg_', phase), CAST(floor(2 * seconds * 1e6 + 0.5) AS BIGINT) FROM timings")
def agg_summary_merge(t: Tables) -> DataFrame:
    m = timings(t).groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("phase", "seconds"))).alias("m"))
    both = m.select("run", merged({"pose_": F.col("m"), "seg_": F.transform_values("m", lambda _, v: 2 * v)}).alias("m"))
    return both.select("run", F.explode("m").alias("key", "value")).select("run", "key", q6(F.col("value")).alias("value_q"))


@query("snk_summary_line", RUNS + """SELECT run, concat('Summary: {"case_name":"', case_name, '","run":', run, ',"timing_schema_version":2,"status":"', status, '"}') AS line FROM runs""")
def snk_summary_line(t: Tables) -> DataFrame:
    row = F.struct("case_name", "run", F.lit(2).alias("timing_schema_version"), "status")
    return runs(t).select("run", F.concat(F.lit("Summary: "), F.to_json(row)).alias("line"))


def archived(files: DataFrame) -> DataFrame:
    """Files (name) that an archive takes: logs and tables, no media."""
    return files.filter(F.regexp_extract("name", r"(\.[^.]+)$", 1).isin(".log", ".json", ".csv", ".jsonl"))


@query("snk_archive", RUNS + "SELECT run, concat('run.', CASE run % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'csv' END) AS name FROM runs WHERE run % 3 < 2")
def snk_archive(t: Tables) -> DataFrame:
    name = F.concat(F.lit("run."), F.when(F.col("run") % 3 == 0, "log").when(F.col("run") % 3 == 1, "csv").otherwise("mp4"))
    return archived(runs(t).select("run", name.alias("name")))


def to_copy(here: DataFrame, there: DataFrame) -> DataFrame:
    """Files that the mirror lacks or holds with another size or time."""
    return here.join(there, ["path", "size", "mtime"], "left_anti")


@query("snk_backup", RUNS + "SELECT concat('f', run) AS path, who AS size, repeat AS mtime FROM runs WHERE run % 4 = 0 OR run % 9 = 0")
def snk_backup(t: Tables) -> DataFrame:
    here = runs(t).select(F.concat(F.lit("f"), "run").alias("path"), F.col("who").alias("size"), F.col("repeat").alias("mtime"), "run")
    there = here.filter("run % 4 <> 0").select("path", (F.col("size") + F.when(F.col("run") % 9 == 0, 1).otherwise(0)).alias("size"), "mtime")
    return to_copy(here.drop("run"), there)


# Statistics and schedules.


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns; arrays as JSON."""
    from pyspark.sql import types as T

    def leaves(schema: T.StructType, path: str, name: str):
        for f in schema:
            here, dotted = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}.{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here, dotted)
            else:
                yield (F.to_json(F.col(here)) if isinstance(f.dataType, T.ArrayType) else F.col(here)).alias(dotted)

    return df.select(*leaves(df.schema, "", ""))


@query("agg_flatten", RUNS + """SELECT run, status AS "summary.status", repeat AS "summary.io.repeat", concat('[', repeat, ',', who, ']') AS "summary.io.both" FROM runs""")
def agg_flatten(t: Tables) -> DataFrame:
    nested = F.struct("status", F.struct("repeat", F.array("repeat", "who").alias("both")).alias("io"))
    return flattened(runs(t).select("run", nested.alias("summary")))


def schedule(cases: DataFrame, repeats: int) -> DataFrame:
    """cases (place from 0, name) in the order in which they run: a warm-up each, then repeats that start one case later every second time and go backwards every other."""
    n = cases.count()
    r, at = F.col("repeat") - 1, F.pmod(F.col("place") - F.floor((F.col("repeat") - 1) / 2), F.lit(n))
    order = F.when(F.col("repeat") == 0, F.col("place")).when(r % 2 == 1, n - 1 - at).otherwise(at)
    rows = cases.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats).cast("long"))))
    return rows.select("name", "repeat", (F.col("repeat") == 0).alias("warmup"), (F.col("repeat") * n + order).cast("long").alias("turn"))


@query("agg_schedule", "WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS place, n_name AS name FROM nation), s AS (SELECT *, ((place - (repeat - 1) // 2) % 25 + 25) % 25 AS spot FROM c, range(1, 6) r(repeat)) SELECT name, CAST(0 AS BIGINT) AS repeat, true AS warmup, place AS turn FROM c UNION ALL SELECT name, repeat, false, CAST(repeat * 25 + CASE WHEN repeat % 2 = 0 THEN 24 - spot ELSE spot END AS BIGINT) FROM s")
def agg_schedule(t: Tables) -> DataFrame:
    return schedule(t.read("nation").select(F.col("n_nationkey").cast("long").alias("place"), F.col("n_name").alias("name")), 5)
