"""Small per-frame pixel computations on arrays: masks, centroids, sub-pixel peaks, row runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_of(logits: Column) -> Column:
    return F.transform(logits, lambda v: v > 0)


def mask_centroid(mask: Column, width: int) -> Column:
    """Centroid, confidence and bounding box of a row-major boolean mask; hidden when empty."""
    spots = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    xs = F.transform(spots, lambda i: (i % width).cast("double"))
    ys = F.transform(spots, lambda i: F.floor(i / width).cast("double"))
    n = F.size(spots)
    mean = lambda a: F.coalesce(F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.when(n > 0, n), F.lit(0.0))
    return F.struct(
        mean(xs).alias("x"), mean(ys).alias("y"), F.least(F.lit(1.0), n / 64.0).alias("confidence"), (n > 0).alias("visible"),
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"),
    )


def weighted_centroid(weights: Column, width: int) -> Column:
    """Centre of mass of non-negative weights; null when there is no mass."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, v: s + v)
    pos = F.transform(weights, lambda v, i: F.struct((v * (i % width)).alias("x"), (v * F.floor(i / width)).alias("y")))
    sums = F.aggregate(pos, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
    mass = F.when(total > 0, total)
    return F.struct((sums["x"] / mass).alias("x"), (sums["y"] / mass).alias("y"))


def parabolic_offset(left: Column, center: Column, right: Column) -> Column:
    """Sub-pixel shift of a minimum from its neighbours, and the width of the dip (null = flat)."""
    bend = (left + right) * 0.5 - center
    curved = bend > 1e-9
    raw = (left - right) * 0.25 / F.when(curved, bend)
    # greatest and least pass over a null, so what is not curved is left out before them
    return F.struct(
        F.when(curved, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0)).alias("offset"),
        F.when(curved, F.sqrt(F.greatest(center * 2.0 / F.when(curved, bend), F.lit(0.0)))).alias("width"),
    )


def match_confidence(peak: Column, good: float = 4.0) -> Column:
    """Share of the match quality; an infinite peak is certain."""
    return F.when(peak == float("inf"), F.lit(1.0)).otherwise(peak / (peak + good))
