"""Occlusion-aware kinematics of tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import DEFAULT_VELOCITY_STEP, MAX_VELOCITY_STEP
from ..functions import calibration as cal_fn
from ..functions import quality
from .joins import attach
from .sequence import drop_halo, run_ids, with_halo
from .tiling import parts

Keys = Sequence[str]
NO_FPS = 30.0


def attach_time(points: DataFrame, frame_time: DataFrame, keys: Keys, fps: Column | float = NO_FPS) -> DataFrame:
    """``time_s`` from the frame index; frames outside it fall back to frame / fps."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    index = frame_time.select(*keys, "frame", (F.col("pts_ms") / 1000.0).alias("_t"))
    return (
        points.join(index, [*keys, "frame"], "left")
        .withColumn("time_s", F.coalesce("_t", F.col("frame") / F.greatest(rate, F.lit(1e-6))))
        .drop("_t")
    )


def display_points(points: DataFrame, keys: Keys, calibration: DataFrame | None) -> DataFrame:
    """Add ``px``/``py`` (image) and replace ``x``/``y`` by analysis coordinates; null when hidden."""
    if calibration is None:
        mapped = points.withColumns({"px": F.col("x"), "py": F.col("y"), "y": -F.col("y")})
    else:
        joined = attach(points, calibration, keys).withColumns({"px": F.col("x"), "py": F.col("y")})
        mapped = cal_fn.display_xy(joined, "px", "py", ("x", "y"), planar=cal_fn.has_planar(calibration))
    shown = F.col("visible")
    return mapped.withColumns({"x": F.when(shown, F.col("x")), "y": F.when(shown, F.col("y"))})


def velocities(samples: DataFrame, keys: Keys, step: int = DEFAULT_VELOCITY_STEP) -> DataFrame:
    """Add vx, vy, speed by step-N central differences that never leave a run.

    Only the ``step`` neighbours on each side are read, through lag/lead, so a run may be as long
    as it likes. Near a run end the step shrinks; at an end the difference is one-sided.
    """
    step = max(1, min(int(step), MAX_VELOCITY_STEP))
    haloed = with_halo(samples, keys, "frame", before=step, after=step)
    w = W.partitionBy(*parts(samples, keys)).orderBy("frame")
    usable = F.col("visible") & F.col("x").isNotNull() & F.col("y").isNotNull()
    here = F.struct(F.col("time_s").alias("t"), "x", "y", usable.alias("ok"))
    rows = haloed.withColumn("_p", here)
    rows = rows.withColumns(
        {
            **{f"_b{k}": F.lag("_p", k).over(w) for k in range(1, step + 1)},
            **{f"_f{k}": F.lead("_p", k).over(w) for k in range(1, step + 1)},
        }
    )

    def reach(prefix: str) -> Column:
        out = F.lit(step)
        for k in range(step, 0, -1):
            out = F.when(F.coalesce(F.col(f"{prefix}{k}.ok"), F.lit(False)), out).otherwise(F.lit(k - 1))
        return out

    rows = drop_halo(rows).withColumns({"_l": reach("_b"), "_r": reach("_f")})
    both = F.least("_l", "_r")
    back = F.when(both >= 1, both).when(F.col("_r") >= 1, F.lit(0)).otherwise(F.col("_l"))
    ahead = F.when(both >= 1, both).otherwise(F.col("_r"))
    rows = rows.withColumns({"_back": back, "_ahead": ahead})

    def pick(prefix: str, offset: str) -> Column:
        out = F.col("_p")
        for k in range(1, step + 1):
            out = F.when(F.col(offset) == k, F.col(f"{prefix}{k}")).otherwise(out)
        return out

    rows = rows.withColumns({"_lo": pick("_b", "_back"), "_hi": pick("_f", "_ahead")})
    dt = F.col("_hi.t") - F.col("_lo.t")
    valid = F.col("_p.ok") & (dt > 0)
    rows = rows.withColumns(
        {
            "vx": F.when(valid, (F.col("_hi.x") - F.col("_lo.x")) / dt),
            "vy": F.when(valid, (F.col("_hi.y") - F.col("_lo.y")) / dt),
        }
    )
    scratch = [c for c in rows.columns if c.startswith("_")]
    return rows.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).drop(*scratch)


def series(
    points: DataFrame,
    keys: Keys = ("clip_id",),
    *,
    calibration: DataFrame | None = None,
    depth: DataFrame | None = None,
    experimental_correction: bool = False,
    step: int = DEFAULT_VELOCITY_STEP,
) -> DataFrame:
    """Kinematic samples of shake-compensated points that already carry ``time_s``.

    ``calibration``: keys + ``cal`` (see functions.calibration.solve).
    ``depth``: keys, frame, residual_m, flag.
    """
    keys = list(keys)
    shown = display_points(points, keys, calibration)
    moved = velocities(shown, keys, step)
    visible = F.col("visible")
    if depth is not None:
        reading = depth.select(*keys, "frame", F.col("residual_m").alias("_res"), F.col("flag").alias("_flag"))
        moved = moved.join(reading, [*keys, "frame"], "left")
    else:
        moved = moved.withColumns({"_res": F.lit(None).cast("double"), "_flag": F.lit(None).cast("string")})
    off = F.coalesce(F.col("_flag") == "off_plane", F.lit(False))
    if calibration is not None:
        cal, px, py = F.col("cal"), F.col("px"), F.col("py")
        planar = cal_fn.is_mode(cal, "planar")
        sx = sy = F.lit(None).cast("double")
        with_plane = cal_fn.has_planar(calibration)
        if with_plane:
            sx, sy = cal_fn.position_sigma(cal, px, py, uv=(F.col("pu"), F.col("pv")))
        moved = moved.withColumn("_extra", cal_fn.extrapolated(cal, px, py, with_plane))
        extra = {
            "sigma_x": F.when(visible & planar, sx),
            "sigma_y": F.when(visible & planar, sy),
            "position_unit": cal_fn.position_unit(cal),
            "speed_unit": cal_fn.speed_unit(cal),
            "source": F.when(visible, cal_fn.measurement_source(cal, F.col("_extra"))).otherwise("pixel"),
        }
    else:
        extra = {
            "_extra": F.lit(False),
            "sigma_x": F.lit(None).cast("double"),
            "sigma_y": F.lit(None).cast("double"),
            "position_unit": F.lit("px"),
            "speed_unit": F.lit("px/s"),
            "source": F.lit("pixel"),
        }
    out = moved.withColumns(extra).withColumns(
        {
            "quality_flags": quality.flags(visible, F.col("_extra"), off, F.lit(experimental_correction)),
            "off_plane_m": F.when(visible, F.col("_res")),
        }
    )
    tile = ["tile"] if "tile" in points.columns else []
    return out.select(
        *keys, *tile, "frame", "time_s", "x", "y", "vx", "vy", "speed", "visible", "confidence", "manual",
        "position_unit", "speed_unit", "sigma_x", "sigma_y", "quality_flags", "off_plane_m", "source",
    )


def runs(samples: DataFrame, keys: Keys, usable: Column | None = None) -> DataFrame:
    """Usable rows with the id of their contiguous run."""
    test = (F.col("visible") & F.col("x").isNotNull() & F.col("y").isNotNull()) if usable is None else usable
    return run_ids(samples, keys, test).filter(test)


def run_bounds(samples: DataFrame, keys: Keys, usable: Column | None = None) -> DataFrame:
    """One row per run: first and last frame and time, and its length."""
    return runs(samples, keys, usable).groupBy(*keys, "run_id").agg(
        F.min("frame").alias("frame_start"),
        F.max("frame").alias("frame_end"),
        F.min_by("time_s", "frame").alias("time_start_s"),
        F.max_by("time_s", "frame").alias("time_end_s"),
        F.count(F.lit(1)).alias("n"),
    )


def longest_run(bounds: DataFrame, keys: Keys) -> DataFrame:
    """The longest run of each track; the first one wins ties."""
    rest = [c for c in bounds.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("n", -F.col("frame_start")))
    return bounds.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def track_summary(points: DataFrame, keys: Keys) -> DataFrame:
    """Coverage, mean confidences and visible count per track."""
    seen = F.col("visible").cast("int")
    n_seen = F.sum(seen)
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        n_seen.alias("n_visible"),
        (n_seen / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("coverage"),
        F.coalesce(F.avg(F.when(F.col("visible"), F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("result_confidence"),
    )
