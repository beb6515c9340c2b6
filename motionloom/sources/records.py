"""Versioned project records from JSON text: parsed as VARIANT, migrated step by step, broken ones kept apart.

A record is read once as VARIANT and cast to one schema wide enough for all versions. Each step of
`MIGRATIONS` fills what a version lacks, so any version ends as the newest. A record that cannot be
read whole keeps its row with the reason; no row is lost and none fails the job.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import DEFAULT_PIXEL_SIGMA, DEFAULT_RULER_LENGTH_M, OFF_PLANE_WARN_M
from ..functions import calibration as cal_fn
from ..session import stored
from .annotations import FAILURE_REASONS, POINT, XY

Keys = Sequence[str]

RESULT = f"struct<clip_id:string,points:array<{POINT}>,confidence:double,failure_reason:string,model_name:string,model_version:string,elapsed_s:double>"
PROMPT = "struct<frame:int,kind:string,x:double,y:double,x2:double,y2:double>"
LAYER = f"struct<track_id:string,name:string,color:string,visible:boolean,seed_frame:int,prompts:array<{PROMPT}>,result:{RESULT},contours:map<string,array<array<double>>>,status:string>"
READING = "struct<frame:int,z_geom:double,z_model:double,residual_m:double,confidence:double,flag:string>"
PLANE = f"struct<corners:array<{XY}>,width_m:double,height_m:double>"
FRAME = "struct<origin_x:double,origin_y:double,axis_angle_deg:double,y_up:boolean>"
CALIBRATION = f"struct<mode:string,rulers:{cal_fn.RULER_TYPE},frame:{FRAME},plane:{PLANE},camera:{cal_fn.CAMERA_TYPE},camera_moved:boolean,pixel_sigma:double>"
DEPTH = f"struct<enabled:boolean,experimental_correction:boolean,model_name:string,available:boolean,message:string,threshold_m:double,readings:map<string,{READING}>>"
ASSISTANT = "struct<confirmed_type:string,fingerprint:string,stale:boolean,teaching_level:string,pendulum_length_m:double,model_id:string,generated_at:string,report_markdown:string,token_usage:map<string,long>>"
POSE = "struct<frame:int,person_id:int,confidence:double,keypoints:array<struct<name:string,x:double,y:double,visible:boolean,confidence:double>>>"
POSES = f"struct<clip_id:string,frames:array<{POSE}>,confidence:double,failure_reason:string>"
PARTS = {
    "schema": "string", "video_path": "string", "active_track_id": "string", "track_mode": "string",
    "model": "struct<name:string,version:string,license:string>", "display": "struct<contours:boolean,prompts:boolean,calibration:boolean,track_mode:string>",
    "tracks": f"array<{LAYER}>", "track": RESULT, "calibration": CALIBRATION, "depth_audit": DEPTH, "assistant": ASSISTANT,
}

# fixed values
NEWEST = 5
PROMPT_KINDS = ("positive", "negative", "box")
RULER_ROLES = ("single", "near", "far")
MODES = ("none", "uniform", "near_far", "planar")
EXPERIMENTS = ("uniform_linear", "uniform_accel", "free_fall", "projectile", "pendulum", "unknown")
LEVELS = ("junior", "high", "college")
FIRST_COLOR = "#f0c14b"


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _with(struct: Column, **defaults) -> Column:
    """The struct with null fields filled."""
    for name, default in defaults.items():
        struct = struct.withField(name, _or(struct[name], default))
    return struct


def _result(result: Column) -> Column:
    """A result with its defaults; null where the record had none."""
    points = F.transform(F.coalesce(result["points"], F.array().cast(f"array<{POINT}>")), lambda p: _with(p, visible=True, confidence=1.0, manual=False, interpolated=False))
    filled = _with(result, confidence=1.0, failure_reason="none", model_name="", model_version="", elapsed_s=0.0).withField("points", points)
    return F.when(result["clip_id"].isNotNull() | result["points"].isNotNull(), filled)


def _first_of_pairs(pairs: list) -> dict:
    out: dict = {}
    for name, value in pairs:
        out.setdefault(name, value)
    return out


def _no_constant(name: str):
    raise ValueError(name)


def _one_of_each_key(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text, object_pairs_hook=_first_of_pairs, parse_constant=_no_constant))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def one_of_each_key(texts: pd.Series) -> pd.Series:
    """JSON texts whose objects keep the first of equal keys; null for what is not JSON."""
    return texts.map(_one_of_each_key)


def _read(texts: DataFrame, keys: Keys, text: str) -> DataFrame:
    """keys and ``_v``, the text as VARIANT, null for what is not JSON.

    VARIANT refuses objects that repeat a key; of those the first counts. A record costs far more
    than its bytes tell, so a small file is first dealt to all cores.
    """
    dealt = texts.select(*keys, F.col(text).alias("_text")).repartition(*keys, "_text")
    rows = dealt.withColumn("_v", F.try_parse_json("_text"))
    again = F.try_parse_json(one_of_each_key(F.when(F.col("_v").isNull(), F.col("_text"))))
    return rows.withColumn("_v", F.coalesce("_v", again)).drop("_text")


def _raw(rows: DataFrame) -> DataFrame:
    """The parts of each record, cast to the widest schema; `_lost` names those that are there but do not cast."""
    part = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    whole = {name: F.try_variant_get("_v", f"$.{name}", "variant") for name in PARTS}
    lost = [F.when(whole[name].isNotNull() & ~F.is_variant_null(whole[name]) & part(name, kind).isNull(), name) for name, kind in PARTS.items()]
    staged = rows.withColumns({name: part(name, kind) for name, kind in PARTS.items()} | {"_lost": F.array_compact(F.array(*lost))})
    return staged.withColumn("_y_up", _or(F.try_variant_get("_v", "$.calibration.frame.y_up", "boolean"), True))


def layer_of_single_track(rows: DataFrame) -> DataFrame:
    """v1 to v2: a lone track becomes the only layer; layers get their defaults."""
    lone = F.struct(
        F.lit("track-1").alias("track_id"), F.lit("track 1").alias("name"), _none("string").alias("color"), _none("boolean").alias("visible"), _none("int").alias("seed_frame"),
        _none(f"array<{PROMPT}>").alias("prompts"), F.col("track").alias("result"), _none("map<string,array<array<double>>>").alias("contours"), F.lit("done").alias("status"),
    )
    empty = F.array().cast(PARTS["tracks"])
    given = F.coalesce("tracks", empty)
    layers = F.when((F.size(given) == 0) & _result(F.col("track")).isNotNull(), F.array(lone)).otherwise(given)

    def filled(layer: Column) -> Column:
        name = F.when(_or(layer["name"], "") == "", layer["track_id"]).otherwise(layer["name"])
        whole = _with(layer, color=FIRST_COLOR, visible=True, seed_frame=0, status="idle").withField("name", name)
        prompts = F.transform(F.coalesce(layer["prompts"], F.array().cast(f"array<{PROMPT}>")), lambda p: _with(p, kind="positive"))
        return whole.withField("prompts", prompts).withField("result", _result(layer["result"]))

    staged = rows.withColumn("tracks", F.transform(layers, filled)).drop("track")
    return staged.withColumn("active_track_id", F.coalesce("active_track_id", F.get("tracks", F.lit(0))["track_id"]))


def mode_of_display(rows: DataFrame) -> DataFrame:
    """v2 to v3: what is shown, and the tracking mode, which older versions kept there."""
    mode = F.coalesce("track_mode", "display.track_mode")
    shown = [_or(F.col(f"display.{name}"), True).alias(name) for name in ("contours", "prompts", "calibration")]
    model = [_or(F.col(f"model.{name}"), "").alias(name) for name in ("name", "version", "license")]
    return rows.withColumns({"track_mode": F.when(mode.isin("precise", "fast"), mode).otherwise("precise"), "display": F.struct(*shown), "model": F.struct(*model)})


def calibrated(rows: DataFrame) -> DataFrame:
    """v3 to v4: a calibration; an unknown mode is none."""
    c = F.col("calibration")
    spot = lambda p: F.struct(_or(p["x"], 0.0).alias("x"), _or(p["y"], 0.0).alias("y"))
    ruler = lambda r: F.struct(spot(r["a"]).alias("a"), spot(r["b"]).alias("b"), _or(r["length_m"], DEFAULT_RULER_LENGTH_M).alias("length_m"), _or(r["role"], "single").alias("role"))
    rulers = F.transform(F.coalesce(c["rulers"], F.array().cast(cal_fn.RULER_TYPE)), ruler)
    frame = F.struct(c["frame"]["origin_x"].alias("origin_x"), c["frame"]["origin_y"].alias("origin_y"), _or(c["frame"]["axis_angle_deg"], 0.0).alias("axis_angle_deg"), F.col("_y_up").alias("y_up"))
    corners = F.transform(F.coalesce(c["plane"]["corners"], F.array().cast(f"array<{XY}>")), spot)
    plane = F.when(c["plane"].isNotNull(), F.struct(corners.alias("corners"), _or(c["plane"]["width_m"], 1.0).alias("width_m"), _or(c["plane"]["height_m"], 1.0).alias("height_m")))
    camera = F.when(c["camera"].isNotNull(), _with(c["camera"], width=0, height=0, k1=0.0, k2=0.0, p1=0.0, p2=0.0, k3=0.0))
    sigma = F.when(_or(c["pixel_sigma"], 0.0) == 0.0, DEFAULT_PIXEL_SIGMA).otherwise(c["pixel_sigma"])
    mode = F.when(c["mode"].isin(*MODES), c["mode"]).otherwise("none")
    made = F.struct(mode.alias("mode"), rulers.alias("rulers"), frame.alias("frame"), plane.alias("plane"), camera.alias("camera"), _or(c["camera_moved"], False).alias("camera_moved"), sigma.alias("pixel_sigma"))
    return rows.withColumn("calibration", made).drop("_y_up")


def audited(rows: DataFrame) -> DataFrame:
    """v4 to v5: the depth audit and the assistant's state; empty readings go."""
    d, a = F.col("depth_audit"), F.col("assistant")
    some = lambda r: F.coalesce(*[r[f].cast("string") for f in ("frame", "z_geom", "z_model", "residual_m", "confidence", "flag")]).isNotNull()
    readings = F.map_filter(F.coalesce(d["readings"], F.create_map().cast(f"map<string,{READING}>")), lambda k, r: some(r))
    filled = F.transform_values(readings, lambda k, r: _with(r, frame=0, confidence=0.0).withField("flag", F.when(_or(r["flag"], "") == "", "skipped").otherwise(r["flag"])))
    threshold = F.when(_or(d["threshold_m"], 0.0) == 0.0, OFF_PLANE_WARN_M).otherwise(d["threshold_m"])
    audit = F.struct(
        _or(d["enabled"], False).alias("enabled"), _or(d["experimental_correction"], False).alias("experimental_correction"), _or(d["model_name"], "").alias("model_name"),
        _or(d["available"], False).alias("available"), _or(d["message"], "").alias("message"), threshold.alias("threshold_m"), filled.alias("readings"),
    )
    kind, level = a["confirmed_type"], a["teaching_level"]
    state = F.struct(
        F.when(_or(kind, "") != "", F.when(kind.isin(*EXPERIMENTS), kind).otherwise("unknown")).alias("confirmed_type"), _or(a["fingerprint"], "").alias("fingerprint"),
        _or(a["stale"], False).alias("stale"), F.when(level.isin(*LEVELS), level).otherwise("high").alias("teaching_level"), a["pendulum_length_m"].alias("pendulum_length_m"),
        _or(a["model_id"], "").alias("model_id"), _or(a["generated_at"], "").alias("generated_at"), _or(a["report_markdown"], "").alias("report_markdown"),
        F.coalesce(a["token_usage"], F.create_map().cast("map<string,long>")).alias("token_usage"),
    )
    return rows.withColumns({"depth_audit": audit, "assistant": state})


MIGRATIONS = (layer_of_single_track, mode_of_display, calibrated, audited)


def _reason() -> Column:
    """Why a record cannot be taken, the first rule that it breaks; null for a sound one."""
    layers = F.col("tracks")
    results = F.filter(F.transform(layers, lambda t: t["result"]), lambda r: r.isNotNull())
    points, prompts = F.flatten(F.transform(results, lambda r: r["points"])), F.flatten(F.transform(layers, lambda t: t["prompts"]))
    bare = lambda p: p["frame"].isNull() | p["x"].isNull() | p["y"].isNull()
    rules = (
        (F.col("_v").isNull(), "not_json"),
        (~F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), "not_object"),
        (F.col("video_path").isNull(), "no_video_path"),
        (F.size("_lost") > 0, "bad_part"),
        (F.exists(layers, lambda t: t["track_id"].isNull()), "no_track_id"),
        (F.exists(results, lambda r: r["clip_id"].isNull()), "no_clip_id"),
        (F.exists(points, bare), "bad_point"),
        (F.exists(results, lambda r: ~r["failure_reason"].isin(*FAILURE_REASONS)), "bad_failure_reason"),
        (F.exists(prompts, lambda p: bare(p) | ~p["kind"].isin(*PROMPT_KINDS)), "bad_prompt"),
        (F.exists("calibration.rulers", lambda r: ~r["role"].isin(*RULER_ROLES)), "bad_ruler_role"),
        (F.exists(F.map_keys("depth_audit.readings"), lambda k: ~F.rlike(k, F.lit(r"^-?\d+$"))), "bad_reading"),
    )
    out = None
    for broken, code in rules:
        out = F.when(broken, code) if out is None else out.when(broken, code)
    return out


def parse_records(texts: DataFrame, keys: Keys, text: str = "text") -> DataFrame:
    """keys, version, reason and the parts of the newest version of each project record.

    The version is that of `schema` ("....v1" to "....v5"; none is 1, an unknown one null). Where
    `reason` is not null the parts may be incomplete; `quarantined` has those rows.
    """
    rows = _raw(_read(texts, keys, text))
    number = F.regexp_extract(F.col("schema"), r"\.v(\d+)$", 1)
    version = F.when(F.col("schema").isNull(), F.lit(1)).when(number != "", number.cast("int"))
    rows = rows.withColumn("version", F.when(version.between(1, NEWEST), version))
    for step in MIGRATIONS:
        rows = step(rows)
    parts = [name for name in PARTS if name not in ("schema", "track")]
    return rows.select(*keys, "version", _reason().alias("reason"), *parts)


def accepted(records: DataFrame, *columns: str) -> DataFrame:
    """The named columns (all, if none is named) of the records that can be taken.

    They are stored with the reason first: a filter on an unstored reason would be moved below the
    migrations, and there repeat the reading of every part for each of its uses.
    """
    kept = records.select(*columns, "reason") if columns else records
    return stored(kept).filter("reason IS NULL").drop("reason")


def quarantined(records: DataFrame, texts: DataFrame, keys: Keys, text: str = "text") -> DataFrame:
    """keys, reason, text of the records that cannot be taken."""
    return records.filter("reason IS NOT NULL").select(*keys, "reason").join(texts.select(*keys, text), list(keys))


def record_points(records: DataFrame, keys: Keys) -> DataFrame:
    """One row for each point of each layer of accepted records."""
    layers = accepted(records, *keys, "tracks").select(*keys, F.explode("tracks").alias("t"))
    return layers.select(*keys, F.col("t.track_id").alias("track_id"), F.explode("t.result.points").alias("p")).select(*keys, "track_id", "p.*")


def record_calibrations(records: DataFrame, keys: Keys) -> DataFrame:
    """keys, cal of accepted records; one that does not hold has mode none and its warning."""
    return cal_fn.solve(accepted(records, *keys, "calibration").select(*keys, "calibration.*"), list(keys))


def record_readings(records: DataFrame, keys: Keys) -> DataFrame:
    """keys, at (the frame it is filed under), and the depth reading, of accepted records."""
    rows = accepted(records, *keys, "depth_audit").select(*keys, F.explode("depth_audit.readings").alias("at", "r"))
    return rows.select(*keys, F.col("at").cast("int").alias("at"), "r.*")


def parse_poses(texts: DataFrame, keys: Keys, text: str = "text") -> DataFrame:
    """keys, reason, clip_id, frame, person_id, confidence, keypoints: one row per pose frame.

    A pose record that cannot be taken, or has no frames, keeps one row without a frame.
    """
    rows = _read(texts, keys, text).withColumn("_p", F.try_variant_get("_v", "$", POSES))
    point = lambda k: _with(k, visible=True, confidence=1.0)
    frames = F.transform(F.coalesce(F.col("_p.frames"), F.array().cast(f"array<{POSE}>")), lambda f: _with(f, person_id=0, confidence=1.0).withField("keypoints", F.transform(f["keypoints"], point)))
    bare = lambda f: f["frame"].isNull() | f["keypoints"].isNull() | F.exists(f["keypoints"], lambda k: k["name"].isNull() | k["x"].isNull() | k["y"].isNull())
    reason = F.when(F.col("_v").isNull(), "not_json").when(F.col("_p.clip_id").isNull(), "no_clip_id").when(F.exists("_f", bare), "bad_frame").when(~_or(F.col("_p.failure_reason"), "none").isin(*FAILURE_REASONS), "bad_failure_reason")
    staged = rows.withColumn("_f", frames).withColumn("reason", reason)
    sound = F.when(F.col("reason").isNull(), F.col("_f"))
    return staged.select(*keys, "reason", F.col("_p.clip_id").alias("clip_id"), F.explode_outer(sound).alias("f")).select(*keys, "reason", "clip_id", "f.*")
