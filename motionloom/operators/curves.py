"""Fitted curves for charts and the axis extents that hold data and curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import poly

Keys = Sequence[str]
CURVE_STEPS = 80
EXTENT_STEPS = 20


def _spans(samples: DataFrame, keys: Keys, attrs: Sequence[str]) -> DataFrame:
    """keys, t0, t1, low, high: extents of time and of the attributes; a single time gets a second."""
    lows, highs = ([F.coalesce(fn(F.col(a).cast("double")), F.lit(rest)) for a in attrs] for fn, rest in ((F.min, float("inf")), (F.max, float("-inf"))))
    least = F.least(*lows) if len(attrs) > 1 else lows[0]
    greatest = F.greatest(*highs) if len(attrs) > 1 else highs[0]
    found = samples.groupBy(*keys).agg(F.min("time_s").alias("t0"), F.max("time_s").alias("_t1"), least.alias("low"), greatest.alias("high"))
    return found.filter("t0 IS NOT NULL").withColumn("t1", F.when(F.col("_t1") > F.col("t0"), F.col("_t1")).otherwise(F.col("t0") + 1.0)).drop("_t1")


def fit_curve(samples: DataFrame, fits: DataFrame, keys: Keys, steps: int = CURVE_STEPS) -> DataFrame:
    """keys, step, time_s, value: the fitted polynomial at even times over a track's samples; tracks without a fit have none."""
    keys = list(keys)
    spans = _spans(samples, keys, ["time_s"]).join(fits.select(*keys, "coeffs"), keys)
    rows = spans.select(*keys, "t0", "t1", "coeffs", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    timed = rows.withColumn("time_s", F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("step") / steps)
    return timed.select(*keys, "step", "time_s", poly.evaluate(F.col("coeffs"), F.col("time_s")).alias("value"))


def curve_extent(coeffs: Column, t0: Column, t1: Column, steps: int = EXTENT_STEPS) -> tuple[Column, Column]:
    """Least and greatest value of a line or parabola at steps + 1 even times.

    They lie at the ends, or at the grid times beside the vertex, so four values are enough.
    """
    bend = F.coalesce(F.get(coeffs, F.lit(2)), F.lit(0.0))
    vertex = F.when(bend != 0, -F.get(coeffs, F.lit(1)) / F.when(bend != 0, bend * 2.0))
    at = F.coalesce((vertex - t0) / (t1 - t0) * steps, F.lit(0.0))
    inside = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(float(steps)), k.cast("double")))
    places = F.array(F.lit(0.0), F.lit(float(steps)), inside(F.floor(at)), inside(F.ceil(at)))
    values = F.transform(places, lambda k: poly.evaluate(coeffs, t0 + (t1 - t0) * k / steps))
    return F.array_min(values), F.array_max(values)


def fit_axes(samples: DataFrame, fits: DataFrame, keys: Keys, attrs: Sequence[str]) -> DataFrame:
    """keys, t0, t1, low, high of a chart of ``attrs`` and of the fitted curve where there is one.

    Equal extents are opened by one on both sides; a chart without any value shows -1 to 1. Samples
    are reduced to one row a track before the fit joins.
    """
    keys = list(keys)
    rows = _spans(samples, keys, list(attrs)).join(fits.select(*keys, "coeffs"), keys, "left")
    low, high = curve_extent(F.col("coeffs"), F.col("t0"), F.col("t1"))
    rows = rows.withColumns({"_a": F.least("low", F.coalesce(low, F.col("low"))), "_z": F.greatest("high", F.coalesce(high, F.col("high")))})
    bare, flat = F.col("_a") > F.col("_z"), F.col("_a") == F.col("_z")
    a = F.when(bare, F.lit(-1.0)).when(flat, F.col("_a") - 1.0).otherwise(F.col("_a"))
    z = F.when(bare, F.lit(1.0)).when(flat, F.col("_z") + 1.0).otherwise(F.col("_z"))
    return rows.select(*keys, "t0", "t1", a.alias("low"), z.alias("high"))
