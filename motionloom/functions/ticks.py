"""Axis ticks, zoom windows and frame-range helpers for charts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nice(span: Column) -> Column:
    """Nearest step of 1, 2, 5 or 10 times a power of ten."""
    size = F.greatest(F.abs(span), F.lit(1e-18))
    power = F.pow(F.lit(10.0), F.floor(F.log10(size)))
    lead = size / power
    return F.when(lead < 1.5, power).when(lead < 3.0, power * 2).when(lead < 7.0, power * 5).otherwise(power * 10)


def _range(lo: Column, hi: Column) -> tuple[Column, Column]:
    bad = lo.isNull() | hi.isNull() | F.isnan(lo) | F.isnan(hi) | (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
    a = F.when(bad, F.lit(0.0)).otherwise(F.least(lo, hi))
    b = F.when(bad, F.lit(1.0)).otherwise(F.greatest(lo, hi))
    return a, b


def tick_interval(lo: Column, hi: Column, target: int = 5) -> Column:
    a, b = _range(lo, hi)
    width = F.when(b - a < 1e-15, F.lit(1.0)).otherwise(b - a)
    return _nice(width / (max(2, min(int(target), 12)) - 1))


def label_decimals(step: Column) -> Column:
    """Digits after the point that tell neighbouring ticks apart, 0 to 6."""
    digits = F.greatest(F.lit(0), F.least(F.lit(6), -F.floor(F.log10(step) + 1e-12))).cast("int")
    return F.when(step >= 1.0 - 1e-12, F.lit(0)).otherwise(digits)


def axis(lo: Column, hi: Column, step: Column) -> Column:
    """Range snapped outward to the tick grid: struct start, end."""
    a, b = _range(lo, hi)
    first = F.floor(a / step)
    last = F.ceil(b / step)
    end = F.when(last * step <= first * step, first + 1).otherwise(last)
    return F.struct((first * step).alias("start"), (end * step).alias("end"))


def zoom(old: Column, factor: Column) -> Column:
    return F.greatest(F.lit(0.8), F.least(F.lit(40.0), old * factor))


def zoom_center(at: Column, view_lo: Column, view_hi: Column, full_lo: Column, full_hi: Column, zoomed: Column) -> Column:
    """Centre that keeps ``at`` under the cursor after zooming."""
    wide = view_hi > view_lo
    rel = F.when(wide, (at - view_lo) / F.when(wide, view_hi - view_lo)).otherwise(F.lit(0.5))
    return at - (rel - 0.5) * (full_hi - full_lo) / zoomed
