"""Point-level joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiling import SPLIT, is_tiled, parts

def attach(df: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-track record onto its points.

    Untiled points have no hot track and are grouped by the same key later, so a plain join on it
    adds no exchange; the planner broadcasts ``dim`` where its measured size allows. For tiled
    points the record is first copied to each tile of its track (a few rows per hot track), so a
    hot track stays spread over its tiles.
    """
    keys = list(keys)
    if not is_tiled(df):
        return df.join(dim, keys, how)
    tiles = df.select(*keys, "tile").distinct()
    return df.join(tiles.join(dim, keys), [*keys, "tile"], how)


def last_per_frame(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Keep the row with the highest ``position`` for each frame (a later duplicate wins)."""
    rest = [c for c in df.columns if c not in (*keys, "frame")]
    return (
        df.groupBy(*keys, "frame")
        .agg(F.max_by(F.struct(*rest), F.col(position)).alias("_r"))
        .select(*keys, "frame", *[F.col("_r")[c].alias(c) for c in rest])
    )


def merge_points(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], from_frame: Column, position: str) -> DataFrame:
    """Confirmed points before ``from_frame``, re-tracked points from it onward.

    Neither side reads the other: the frame ranges are disjoint, and only duplicates inside the
    new range have to be resolved.
    """
    kept = last_per_frame(existing.filter(F.col("frame") < from_frame), keys, position)
    fresh = last_per_frame(incoming.filter(F.col("frame") >= from_frame), keys, position)
    return kept.unionByName(fresh)


def override_points(points: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manual corrections replace the point of their frame, or are added to the track."""
    fixed = corrections.select(
        *keys,
        "frame",
        "x",
        "y",
        F.lit(True).alias("visible"),
        F.lit(1.0).alias("confidence"),
        F.lit(True).alias("manual"),
        F.lit(False).alias("interpolated"),
    )
    kept = points.join(fixed.select(*keys, "frame"), [*keys, "frame"], "left_anti")
    return kept.select(*fixed.columns).unionByName(fixed)


def compensate(points: DataFrame, shake: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Subtract the shake offset of the frame, clamped to the last measured one.

    ``shake`` has one row per frame 0..n-1 of a clip. Tracks without any offsets pass through.
    The ``interpolated`` mark of compensated points is cleared.
    """
    keys = list(keys)
    span = shake.groupBy(*keys).agg(F.max("frame").alias("_last"))
    bounded = attach(points, span, keys, "left")
    clamped = bounded.withColumn(
        "_f", F.greatest(F.lit(0), F.least(F.col("frame"), F.col("_last")))
    )
    beyond = F.col("frame") >= F.col("_last")
    offsets = shake.select(*keys, F.col("frame").alias("_f"), "dx", "dy")
    # rows past the last offset all clamp to one key, so they take it from the per-clip record
    tail = shake.groupBy(*keys).agg(
        F.max_by(F.struct("dx", "dy"), "frame").alias("_end")
    )
    inside = clamped.withColumn("_f", F.when(beyond, F.lit(None)).otherwise(F.col("_f")))
    joined = attach(inside.join(offsets, [*keys, "_f"], "left"), tail, keys, "left")
    dx = F.when(beyond, F.col("_end.dx")).otherwise(F.col("dx"))
    dy = F.when(beyond, F.col("_end.dy")).otherwise(F.col("dy"))
    out = joined.withColumns({"x": F.col("x") - F.coalesce(dx, F.lit(0.0)), "y": F.col("y") - F.coalesce(dy, F.lit(0.0))})
    if "interpolated" in points.columns:
        out = out.withColumn(
            "interpolated", F.when(F.col("_last").isNull(), F.col("interpolated")).otherwise(F.lit(False))
        )
    return out.select(*points.columns)


def nearest_in_time(samples: DataFrame, cursors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample nearest to each cursor time of its track; the earlier one wins ties.

    ``cursors`` has (keys, cursor_id, at_s). Samples and cursors are one ordered stream: the last
    sample at or before a cursor and the first one after it are the only candidates.
    """
    from .sequence import carry, file_marks, with_marks

    keys = list(keys)
    tile = ["tile"] if is_tiled(samples) else []
    point = F.struct(F.col("time_s").alias("t"), F.col("frame").alias("frame"))
    rows = samples.select(*keys, *tile, F.col("time_s").alias("_at"), F.col("frame").cast("long").alias("_k"), point.alias("_s"), F.lit(None).cast("long").alias("cursor_id"))
    marks = cursors.select(*keys, F.col("at_s").alias("_at"), F.lit(None).cast("long").alias("_k"), F.lit(None).cast(rows.schema["_s"].dataType).alias("_s"), F.col("cursor_id").cast("long"))
    if tile:
        starts = samples.filter(SPLIT).groupBy(*keys, "tile").agg(F.min("time_s").alias("_at"))
        marks = file_marks(marks, keys, starts)
    stream = with_marks(rows, marks, parts(rows, keys)).withColumn("_ord", F.struct("_at", F.col("cursor_id").isNotNull(), F.coalesce("cursor_id", "_k")))
    prev = carry(stream, keys, "_ord", {"_prev": F.col("_s")}, forward=True)
    both = carry(prev, keys, "_ord", {"_next": F.col("_s")}, forward=False)
    gap_prev = F.col("_at") - F.col("_prev.t")
    gap_next = F.col("_next.t") - F.col("_at")
    take_prev = F.col("_next").isNull() | (F.col("_prev").isNotNull() & (gap_prev <= gap_next))
    best = F.when(take_prev, F.col("_prev")).otherwise(F.col("_next"))
    return both.filter("cursor_id is not null").select(*keys, "cursor_id", F.col("_at").alias("at_s"), best["frame"].alias("frame"), best["t"].alias("time_s"))
