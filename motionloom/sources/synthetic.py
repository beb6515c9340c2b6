"""Closed-form clips with known answers, for tests: each is a formula over a frame range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def frames(spark: SparkSession, clip_id: str, n: int, fps: float) -> DataFrame:
    """Frame times as a frame index gives them (whole milliseconds); ``t`` is exact."""
    exact = F.col("id") / F.lit(float(fps))
    return spark.range(n).select(
        F.lit(clip_id).alias("clip_id"), F.col("id").cast("int").alias("frame"), (F.bround(exact * 1000.0) / 1000.0).alias("time_s"), exact.alias("t")
    )


def clip(spark: SparkSession, clip_id: str, n: int, fps: float, x, y, hidden: Column | None = None) -> DataFrame:
    """Track whose position is given by functions of time (seconds)."""
    rows = frames(spark, clip_id, n, fps)
    t = F.col("t")
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return rows.select(
        "clip_id", "frame", "time_s", as_col(x(t)).alias("x"), as_col(y(t)).alias("y"),
        (F.lit(True) if hidden is None else ~hidden).alias("visible"), F.lit(1.0).alias("confidence"), F.lit(False).alias("manual"), F.lit(False).alias("interpolated"),
    )


def slider(spark: SparkSession, n: int = 40) -> DataFrame:
    return clip(spark, "slider", n, 30.0, lambda t: t * 180.0 + 30.0, lambda t: 106.0)


def free_fall(spark: SparkSession, n: int = 20) -> DataFrame:
    return clip(spark, "free_fall", n, 30.0, lambda t: 160.0, lambda t: t * t * 490.5 + 10.0)


def acceleration(spark: SparkSession, n: int = 40) -> DataFrame:
    return clip(spark, "acceleration", n, 30.0, lambda t: t * 30.0 + t * t * 60.0 + 20.0, lambda t: 100.0)


def projectile(spark: SparkSession, n: int = 18) -> DataFrame:
    return clip(spark, "projectile", n, 30.0, lambda t: t * 80.0 + 20.0, lambda t: t * 20.0 + t * t * 490.5 + 20.0)


def pendulum(spark: SparkSession, n: int = 75, period_s: float = 1.1, length_px: float = 80.0, swing_deg: float = 20.0) -> DataFrame:
    angle = lambda t: F.cos(t * (2 * math.pi / period_s)) * math.radians(swing_deg)
    return clip(spark, "pendulum", n, 30.0, lambda t: F.sin(angle(t)) * length_px + 160.0, lambda t: F.cos(angle(t)) * length_px + 20.0)


def turntable(spark: SparkSession, n: int = 48) -> DataFrame:
    return clip(spark, "turntable", n, 30.0, lambda t: F.cos(t * 4.0) * 50.0 + 160.0, lambda t: F.sin(t * 4.0) * 50.0 + 90.0)
