"""Clip reports: dispatch, pass rates, failure modes, regression against a baseline, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import CORE_METRICS
from .metrics import calibration_metrics, physics_metrics, pose_metrics, track_metrics

Keys = Sequence[str]


def select_split(manifest: DataFrame, split: str, *, include_holdout: bool = False) -> DataFrame:
    """Entries of a split; ``all`` leaves hidden ones out; ``ci`` keeps the first of each clip without slots."""
    chosen = F.col("split") == split
    if split == "all":
        chosen = chosen | F.lit(include_holdout) | ~F.col("hidden")
    rows = manifest.filter(chosen)
    if split != "ci":
        return rows
    w = W.partitionBy("clip_id").orderBy("entry_no")
    plain = rows.filter(~F.contains("clip_id", F.lit("_slot")))
    return plain.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")


def clip_reports(entries: DataFrame, metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per entry: metrics as an array (about a dozen), verdict, elapsed time, error.

    ``runs``: clip_id, model, elapsed_s, error. A clip with an error fails whatever it measured.
    """
    item = F.struct("name", "value", "threshold", "higher_is_better", "passed")
    packed = metrics.groupBy("clip_id").agg(
        F.array_sort(F.collect_list(item)).alias("metrics"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("_ok")
    )
    rows = entries.select("clip_id", "task", "difficulty", "split").join(runs, "clip_id", "left").join(packed, "clip_id", "left")
    return rows.select(
        "clip_id", "task", "difficulty", "split", "model",
        (F.col("error").isNull() & F.coalesce("_ok", F.lit(False))).alias("passed"),
        "elapsed_s", "error",
        F.when(F.col("error").isNull(), F.col("metrics")).alias("metrics"),
    )


def evaluate(
    manifest: DataFrame, truth: DataFrame, guesses: DataFrame, runs: DataFrame, *, split: str = "dev", include_holdout: bool = False,
    poses: tuple[DataFrame, DataFrame] | None = None, calibrations: tuple[DataFrame, DataFrame] | None = None, physics: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Clip reports of a split, each clip measured by the task its manifest entry names.

    ``manifest``: clip_id, task, difficulty, split, hidden, entry_no; ``runs`` as in clip_reports.
    ``truth`` and ``guesses`` are points of track clips, and of physics clips, which must also track
    well; the other tasks have (truth, found) pairs as their metrics take them. An entry of a task
    without tables stays in the report as failed, with an error. Rows of clips outside the split, or
    of another task, are dropped before they are matched.
    """
    entries = select_split(manifest, split, include_holdout=include_holdout)
    given = {"track": True, "pose": poses is not None, "calibration": calibrations is not None, "physics": physics is not None}

    def of(*tasks: str) -> DataFrame:
        return entries.filter(F.col("task").isin(*tasks)).select("clip_id", "difficulty").distinct()

    def mine(pair: tuple[DataFrame, DataFrame], clips: DataFrame) -> list[DataFrame]:
        return [rows.join(clips.select("clip_id"), "clip_id", "left_semi") for rows in pair]

    tracked = of("track", "physics") if physics is not None else of("track")
    metrics = track_metrics(*mine((truth, guesses), tracked), tracked, ["clip_id"])
    if poses is not None:
        metrics = metrics.unionByName(pose_metrics(*mine(poses, of("pose")), of("pose"), ["clip_id"]))
    if calibrations is not None:
        known, found = mine(calibrations, of("calibration"))
        metrics = metrics.unionByName(calibration_metrics(known.drop("difficulty").join(of("calibration"), "clip_id"), found, ["clip_id"]))
    if physics is not None:
        metrics = metrics.unionByName(physics_metrics(*mine(physics, of("physics")), ["clip_id"]))
    served = F.col("task").isin(*[task for task, there in given.items() if there])
    untold = entries.select("clip_id", F.when(~served, F.concat(F.lit("no results for task "), "task")).alias("_untold")).filter("_untold IS NOT NULL").distinct()
    missing = entries.select("clip_id").distinct().join(runs.select("clip_id"), "clip_id", "left_anti")
    told = runs.unionByName(missing, allowMissingColumns=True).join(untold, "clip_id", "left")
    return clip_reports(entries, metrics, told.withColumn("error", F.coalesce("error", "_untold")).drop("_untold"))


def pass_rate(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.coalesce(F.sum(F.col("passed").cast("int")), F.lit(0)).alias("n_passed"),
        F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("pass_rate"),
    )


def failure_modes(reports: DataFrame) -> DataFrame:
    """How often each reason failed a clip: crash, each failed metric, or unknown."""
    failed = F.transform(F.filter(F.coalesce("metrics", F.array().cast(reports.schema["metrics"].dataType)), lambda m: m["passed"] == F.lit(False)), lambda m: m["name"])
    reasons = (
        F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.array(F.lit("crash")))
        .when(F.size(failed) == 0, F.array(F.lit("unknown_fail")))
        .otherwise(failed)
    )
    return reports.filter("not passed").select(F.explode(reasons).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def compare_to_baseline(current: DataFrame, baseline: DataFrame, *, metric_tol: float = 0.02, perf_tol: float = 0.10) -> DataFrame:
    """Regression items: clip_id, metric, reason, old, new. Both sides are clip reports."""
    prev = baseline.select(
        "clip_id", F.col("passed").alias("b_passed"), F.col("elapsed_s").alias("b_elapsed"), F.col("metrics").alias("b_metrics")
    )
    both = current.join(prev, "clip_id")
    broke = F.col("b_passed") & ~F.col("passed")
    none = F.lit(None).cast("double")
    failures = both.filter(broke).select("clip_id", F.lit(None).cast("string").alias("metric"), F.lit("new_failure").alias("reason"), none.alias("old"), none.alias("new"))
    steady = both.filter(~F.coalesce(broke, F.lit(False)))
    old_by_name = F.map_from_entries(F.transform("b_metrics", lambda m: F.struct(m["name"], m)))
    pairs = steady.withColumn("_old", old_by_name).select("clip_id", "_old", F.explode("metrics").alias("m"))
    pairs = pairs.filter(F.col("m.name").isin(*CORE_METRICS)).withColumn("o", F.try_element_at("_old", "m.name"))
    old, new = F.col("o.value"), F.col("m.value")
    settled = F.coalesce(F.col("m.passed") & F.col("o.passed"), F.lit(False))
    higher = F.coalesce("m.higher_is_better", F.lit(True))
    worse = F.when(higher, old - new).otherwise(new - old) / F.greatest(F.abs(old), F.lit(1e-3))
    drops = pairs.filter(~settled & (worse > metric_tol)).select(
        "clip_id", F.col("m.name").alias("metric"), F.when(higher, "metric_drop").otherwise("metric_worsen").alias("reason"), old.alias("old"), new.alias("new")
    )
    slow = steady.filter((F.col("b_elapsed") >= 0.5) & (F.col("elapsed_s") > F.col("b_elapsed") * (1.0 + perf_tol))).select(
        "clip_id", F.lit(None).cast("string").alias("metric"), F.lit("perf_regression").alias("reason"), F.col("b_elapsed").alias("old"), F.col("elapsed_s").alias("new")
    )
    return failures.unionByName(drops).unionByName(slow)


def regression_summary(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) > 0).alias("blocking")).withColumn("status", F.lit("compared"))


def validate_annotations(clips: DataFrame) -> DataFrame:
    """clip_id, error: every broken rule of an annotation table (schema: sources.annotations)."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    out_of_range = lambda frames, kind: F.transform(
        F.filter(F.coalesce(F.transform(frames, lambda f: f["frame"]), F.array().cast("array<int>")), lambda f: (f < 0) | (f >= F.col("frame_count"))),
        lambda f: F.concat(F.lit(f"{kind} frame "), f.cast("string"), F.lit(" out of range")),
    )
    task = F.col("task")
    rules = F.array_compact(
        F.array(
            F.when(F.col("frame_count") <= 0, "frame_count must be positive"),
            F.when((F.col("width") <= 0) | (F.col("height") <= 0), "width/height must be positive"),
            F.when((task == "track") & (size("track") == 0), "track annotation missing"),
            F.when((task == "pose") & (size("pose") == 0), "pose annotation missing"),
            F.when((task == "calibration") & F.col("calibration").isNull(), "calibration annotation missing"),
            F.when((task == "physics") & ((size("track") == 0) | F.col("physics").isNull()), "physics annotation missing track or quantities"),
        )
    )
    found = F.concat(rules, out_of_range("track", "track"), out_of_range("pose", "pose"))
    return clips.select("clip_id", F.explode(found).alias("error"))


def duplicate_clips(manifest: DataFrame) -> DataFrame:
    """clip_id, error: one row for every repetition of a clip id."""
    counts = manifest.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts.select("clip_id", "n", F.concat(F.lit("duplicate clip_id "), F.col("clip_id").cast("string")).alias("error"))


def missing_annotations(manifest: DataFrame, annotations: DataFrame) -> DataFrame:
    """Manifest entries whose annotation is not there."""
    return manifest.join(annotations.select("clip_id").distinct(), "clip_id", "left_anti").select("clip_id", F.lit("cannot load annotation").alias("error"))
