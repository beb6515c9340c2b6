"""Annotation, manifest, report and project documents, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

XY = "struct<x:double,y:double>"
ANNOTATION_SCHEMA = f"""clip_id string, schema_version string, task string, scene string, difficulty string,
  width int, height int, fps double, frame_count int, notes string,
  track array<struct<frame:int,center:{XY},visible:boolean,bbox:struct<x:double,y:double,w:double,h:double>,occluded:boolean>>,
  pose array<struct<frame:int,person_id:int,keypoints:array<struct<name:string,x:double,y:double,visible:boolean>>>>,
  calibration struct<ruler_a:{XY},ruler_b:{XY},length_m:double,origin:{XY},axis_angle_deg:double,has_reliable_ruler:boolean>,
  physics struct<period_s:double,gravity_ms2:double,velocity_ms:double,acceleration_ms2:double,trajectory_fit_error:double>"""

MANIFEST_SCHEMA = """schema_version string, description string,
  entries array<struct<clip_id:string,relative_path:string,annotation_path:string,sha256:string,task:string,scene:string,
  difficulty:string,width:int,height:int,fps:double,frame_count:int,split:string,license:string,hidden:boolean>>"""

POINT = "struct<frame:int,x:double,y:double,visible:boolean,confidence:double,manual:boolean,interpolated:boolean>"
RESULT = f"struct<clip_id:string,points:array<{POINT}>,confidence:double,failure_reason:string,model_name:string,model_version:string,elapsed_s:double>"
PROJECT_SCHEMA = f"""schema string, video_path string, active_track_id string,
  model struct<name:string,version:string,license:string>,
  display struct<contours:boolean,prompts:boolean,calibration:boolean,track_mode:string>, track_mode string,
  tracks array<struct<id:string,name:string,color:string,visible:boolean,seed_frame:int,result:{RESULT},status:string>>,
  track {RESULT}"""

REPORT_SCHEMA = """created_at double, machine map<string,string>, model_bundle string, split string, seed int, pass_rate double,
  clips array<struct<clip_id:string,task:string,difficulty:string,split:string,model:string,passed:boolean,elapsed_s:double,error:string,
  metrics:array<struct<name:string,value:double,threshold:double,higher_is_better:boolean,passed:boolean>>>>"""

FAILURE_REASONS = (
    "none", "target_lost", "low_confidence", "occluded", "no_ruler", "ambiguous", "cancelled", "model_error", "unsupported",
)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per clip with the documented defaults filled in."""
    raw = read_json(spark, path, ANNOTATION_SCHEMA)
    yes, no = F.lit(True), F.lit(False)
    track = F.transform(
        "track",
        lambda f: f.withField("visible", F.coalesce(f["visible"], yes)).withField("occluded", F.coalesce(f["occluded"], no)),
    )
    pose = F.transform(
        "pose",
        lambda f: f.withField("person_id", F.coalesce(f["person_id"], F.lit(0))).withField(
            "keypoints", F.transform(f["keypoints"], lambda k: k.withField("visible", F.coalesce(k["visible"], yes)))
        ),
    )
    calibration = F.when(
        F.col("calibration").isNotNull(),
        F.col("calibration").withField("has_reliable_ruler", F.coalesce("calibration.has_reliable_ruler", yes)),
    )
    return raw.withColumns(
        {
            "schema_version": F.coalesce("schema_version", F.lit("1.0.0")),
            "notes": F.coalesce("notes", F.lit("")),
            "track": F.coalesce(track, F.array().cast(raw.schema["track"].dataType)),
            "pose": F.coalesce(pose, F.array().cast(raw.schema["pose"].dataType)),
            "calibration": calibration,
        }
    )


def track_points(annotations: DataFrame) -> DataFrame:
    """Ground-truth points, one row per frame."""
    f = F.explode("track").alias("f")
    return annotations.select("clip_id", "fps", f).select(
        "clip_id", F.col("f.frame").alias("frame"), (F.col("f.frame") / F.greatest("fps", F.lit(1e-6))).alias("time_s"),
        F.col("f.center.x").alias("x"), F.col("f.center.y").alias("y"), F.col("f.visible").alias("visible"),
        F.lit(1.0).alias("confidence"), F.lit(False).alias("manual"), F.lit(False).alias("interpolated"),
    )


def pose_frames(annotations: DataFrame) -> DataFrame:
    return annotations.select("clip_id", F.explode("pose").alias("p")).select("clip_id", F.col("p.frame").alias("frame"), F.col("p.keypoints").alias("keypoints"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry, numbered in file order."""
    raw = read_json(spark, path, MANIFEST_SCHEMA)
    rows = raw.select(F.posexplode("entries").alias("entry_no", "e")).select("entry_no", "e.*")
    return rows.withColumns(
        {
            "split": F.coalesce("split", F.lit("dev")),
            "license": F.coalesce("license", F.lit("unknown")),
            "hidden": F.coalesce("hidden", F.lit(False)),
        }
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Clip rows of evaluation reports or baselines."""
    return read_json(spark, path, REPORT_SCHEMA).select(F.explode("clips").alias("c")).select("c.*")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project documents of any version: a single legacy track becomes the only layer."""
    raw = read_json(spark, path, PROJECT_SCHEMA)
    layer = raw.schema["tracks"].dataType.elementType
    legacy = F.struct(
        F.lit("track-1").alias("id"), F.lit("track 1").alias("name"), F.lit(None).cast("string").alias("color"), F.lit(True).alias("visible"),
        F.get("track.points", F.lit(0))["frame"].alias("seed_frame"), F.col("track").alias("result"), F.lit("done").alias("status"),
    ).cast(layer)
    none = F.coalesce(F.size("tracks"), F.lit(0)) == 0
    tracks = F.when(none & F.col("track").isNotNull(), F.array(legacy)).otherwise(F.coalesce("tracks", F.array().cast(raw.schema["tracks"].dataType)))
    mode = F.coalesce("track_mode", "display.track_mode")
    return raw.withColumns({"tracks": tracks, "schema": F.coalesce("schema", F.lit("1"))}).withColumns(
        {
            "active_track_id": F.coalesce("active_track_id", F.get("tracks", F.lit(0))["id"]),
            "track_mode": F.when(mode.isin("precise", "fast"), mode).otherwise("precise"),
        }
    ).drop("track")


def project_points(projects: DataFrame) -> DataFrame:
    """Points of all layers, with the reader's defaults."""
    rows = projects.select("video_path", F.explode("tracks").alias("t")).select("video_path", F.col("t.id").alias("track_id"), F.explode("t.result.points").alias("p"))
    p = F.col("p")
    return rows.select(
        "video_path", "track_id", p["frame"].alias("frame"), p["x"].alias("x"), p["y"].alias("y"), F.coalesce(p["visible"], F.lit(True)).alias("visible"),
        F.coalesce(p["confidence"], F.lit(1.0)).alias("confidence"), F.coalesce(p["manual"], F.lit(False)).alias("manual"), F.coalesce(p["interpolated"], F.lit(False)).alias("interpolated"),
    )
