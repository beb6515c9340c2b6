"""Stateless per-point functions and running coverage on a stream of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calibration as cal_fn


def mapped_stream(points: DataFrame, solved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Analysis coordinates of arriving points: a stream joined with stored calibration records."""
    joined = points.join(solved, list(keys), "left").withColumns({"px": F.col("x"), "py": F.col("y")})
    return cal_fn.display_xy(joined, "px", "py", ("x", "y"), planar=cal_fn.has_planar(solved)).drop("cal", "pu", "pv")


def running_coverage(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Visible share and mean confidence per track so far; use with update mode."""
    seen = F.col("visible").cast("int")
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.avg(seen).alias("coverage"),
        F.coalesce(F.avg(F.when(F.col("visible"), F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
    )
