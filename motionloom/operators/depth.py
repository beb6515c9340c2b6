"""Off-plane audit of planar tracks against sampled model depths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import calibration as cal_fn
from ..functions import plane as P
from .joins import attach
from .sequence import per_key

Keys = Sequence[str]


def with_pose(solved: DataFrame, keys: Keys) -> DataFrame:
    """Add ``pose`` to planar records; a calibration-table step."""
    pose = lambda c: F.when(cal_fn.is_mode(c["cal"], "planar"), P.plane_pose(c["cal"]["hi"], c["cal"]["camera"]))
    return solved.withColumn("pose", P.let({"cal": F.col("cal")}, pose))


def expected_depth(points: DataFrame, posed: DataFrame, keys: Keys) -> DataFrame:
    """Add ``z_geom``: camera depth of each point on its plane, null where it cannot be computed."""
    rows = attach(points, posed, keys)
    mapped = cal_fn.pixel_to_world(rows, "x", "y", ("_wx", "_wy"))
    return mapped.withColumn("z_geom", P.camera_depth(F.col("pose"), F.col("_wx"), F.col("_wy"))).drop("_wx", "_wy", "pu", "pv")


def select_audit_frames(points: DataFrame, keys: Keys, stride: int = C.AUDIT_STRIDE) -> DataFrame:
    """Visible first and last points, weak points, and every stride-th frame."""
    rows = per_key(points.filter("visible"), keys, {"_a": F.min("frame"), "_z": F.max("frame")})
    chosen = (
        (F.col("frame") == F.col("_a"))
        | (F.col("frame") == F.col("_z"))
        | (F.col("confidence") < 0.6)
        | (F.col("frame") % max(stride, 1) == 0)
    )
    return rows.filter(chosen).drop("_a", "_z")


def robust_center_depth(df: DataFrame, depth: str, width: int, height: int, x: Column, y: Column, out: str, radius: int = 4) -> DataFrame:
    """Add the median of the middle 60 % of valid depths around a pixel of a row-major map.

    The patch has at most (2 radius + 1)^2 values. Null outside the map or with under three valid
    ones. The steps are separate projections, so the patch is built once.
    """
    rows = df.withColumns({"_cx": F.rint(x).cast("int"), "_cy": F.rint(y).cast("int")})
    cx, cy = F.col("_cx"), F.col("_cy")
    inside = (cx >= 0) & (cx < width) & (cy >= 0) & (cy < height)
    columns = F.sequence(F.greatest(cx - radius, F.lit(0)), F.least(cx + radius, F.lit(width - 1)))
    lines = F.sequence(F.greatest(cy - radius, F.lit(0)), F.least(cy + radius, F.lit(height - 1)))
    cells = F.flatten(F.transform(lines, lambda r: F.transform(columns, lambda c: F.get(depth, r * width + c).cast("double"))))
    rows = rows.withColumn("_p", F.when(inside, cells))
    valid = F.array_sort(F.filter("_p", lambda z: z.isNotNull() & ~F.isnan(z) & (z > 1e-4) & (z < float("inf"))))
    rows = rows.withColumn("_p", valid)
    rows = rows.withColumn("_p", F.when(F.size("_p") >= 3, F.col("_p")))
    top = F.size("_p") - 1
    rows = rows.withColumns({"_lo": _at(F.col("_p"), top * 0.2), "_hi": _at(F.col("_p"), top * 0.8)})
    rows = rows.withColumn("_q", F.filter("_p", lambda z: (z >= F.col("_lo")) & (z <= F.col("_hi"))))
    rows = rows.withColumn("_q", F.when(F.size("_q") > 0, F.col("_q")).otherwise(F.col("_p")))
    return rows.withColumn(out, _at(F.col("_q"), (F.size("_q") - 1) * 0.5)).drop("_cx", "_cy", "_p", "_lo", "_hi", "_q")


def _at(ordered: Column, position: Column) -> Column:
    """Linear interpolation at a fractional position of a sorted array."""
    low = F.floor(position).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (position - low)


def audit_track(
    points: DataFrame,
    posed: DataFrame,
    model_depth: DataFrame,
    keys: Keys,
    *,
    threshold_m: float = C.OFF_PLANE_WARN_M,
    stride: int = C.AUDIT_STRIDE,
) -> DataFrame:
    """Readings of the audited frames of planar tracks. ``model_depth``: keys, frame, z_model."""
    keys = list(keys)
    chosen = select_audit_frames(points, keys, stride)
    rows = expected_depth(chosen, posed, keys).filter(cal_fn.is_mode(F.col("cal"), "planar"))
    rows = rows.join(model_depth.select(*keys, "frame", "z_model"), [*keys, "frame"], "left")
    size = F.greatest(F.col("cal.width_m"), F.col("cal.height_m"), F.lit(1e-6))
    limit = F.greatest(F.lit(threshold_m), size * C.OFF_PLANE_RATIO)
    residual = F.abs(F.col("z_model") - F.col("z_geom"))
    rows = rows.withColumns({"limit_m": limit, "residual_m": residual})
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("residual_m") / F.greatest(F.col("limit_m") * 3.0, F.lit(1e-6))))
    flag = F.when(F.col("residual_m").isNull(), "skipped").when(F.col("residual_m") > F.col("limit_m"), "off_plane").otherwise("ok")
    return rows.select(*keys, "frame", "z_geom", "z_model", "residual_m", F.coalesce(trust, F.lit(0.0)).alias("confidence"), flag.alias("flag"), "limit_m")


def audit_summary(readings: DataFrame, keys: Keys) -> DataFrame:
    """Number of audited and off-plane frames per track with the outcome."""
    off = F.sum((F.col("flag") == "off_plane").cast("int"))
    return readings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_readings"), off.alias("n_off_plane"), F.max("limit_m").alias("limit_m")).withColumn(
        "outcome", F.when(F.col("n_off_plane") > 0, "may_leave_plane").otherwise("no_off_plane_found")
    )
