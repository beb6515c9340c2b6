"""Lookups at asked frames: positions between samples, anchors, and the way back from stable coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import lerp
from .joins import compensate
from .sequence import carry, file_marks, with_marks
from .tiling import SPLIT, is_tiled, parts

Keys = Sequence[str]


def position_at(points: DataFrame, cursors: DataFrame, keys: Keys) -> DataFrame:
    """keys, cursor_id, asked, x, y: where a track is at the asked frame.

    Between two points the position is interpolated; before the first and after the last it is
    theirs; a track without points gives nulls. ``points`` have unique frames, ``cursors`` have
    keys, cursor_id, asked. Points and cursors are one ordered stream, so a hot track stays tiled.
    """
    keys = list(keys)
    tile = ["tile"] if is_tiled(points) else []
    point = F.struct("frame", "x", "y")
    rows = points.select(*keys, *tile, F.col("frame").cast("long").alias("_at"), point.alias("_s"), F.lit(None).cast("long").alias("cursor_id"))
    marks = cursors.select(*keys, F.col("asked").cast("long").alias("_at"), F.lit(None).cast(rows.schema["_s"].dataType).alias("_s"), F.col("cursor_id").cast("long"))
    if tile:
        marks = file_marks(marks, keys, rows.filter(SPLIT).groupBy(*keys, "tile").agg(F.min("_at").alias("_at")))
    stream = with_marks(rows, marks, parts(rows, keys)).withColumn("_ord", F.struct("_at", F.col("cursor_id").isNotNull(), F.coalesce("cursor_id", F.lit(0).cast("long"))))
    both = carry(carry(stream, keys, "_ord", {"_prev": F.col("_s")}, forward=True), keys, "_ord", {"_next": F.col("_s")}, forward=False)
    value = lambda axis: (
        F.when(F.col("_prev").isNull(), F.col("_next")[axis])
        .when(F.col("_next").isNull(), F.col("_prev")[axis])
        .otherwise(lerp(F.col("_prev")[axis], F.col("_next")[axis], F.col("_prev.frame"), F.col("_next.frame"), F.col("_at")))
    )
    return both.filter("cursor_id is not null").select(*keys, "cursor_id", F.col("_at").alias("asked"), value("x").alias("x"), value("y").alias("y"))


def to_video(points: DataFrame, shake: DataFrame, keys: Keys) -> DataFrame:
    """Stable coordinates back to those of the video: the inverse of ``compensate``."""
    return compensate(points, shake.withColumns({"dx": -F.col("dx"), "dy": -F.col("dy")}), keys)


def anchors_at(anchors: DataFrame, cursors: DataFrame, keys: Keys) -> DataFrame:
    """keys, cursor_id, anchors: those of the asked frame, clamped to the measured ones, without lost ones.

    ``anchors`` has keys, frame (0..n-1), k, x, y, a bounded number per frame; a lost one has null x
    or y. Clips without anchors give empty arrays.
    """
    keys = list(keys)
    seen = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("k", "x", "y"))
    frames = anchors.groupBy(*keys, "frame").agg(F.sort_array(F.collect_list(seen)).alias("anchors"))
    ends = frames.groupBy(*keys).agg(F.max("frame").alias("_last"), F.max_by("anchors", "frame").alias("_end"))
    placed = cursors.join(ends, keys, "left")
    beyond = F.col("asked") >= F.col("_last")
    at = placed.withColumn("frame", F.when(~beyond, F.greatest(F.lit(0), F.col("asked")).cast("int")))
    found = at.join(frames, [*keys, "frame"], "left")
    empty = F.slice("anchors", 1, 0)
    return found.select(*keys, "cursor_id", F.coalesce(F.when(beyond, F.col("_end")).otherwise(F.col("anchors")), empty, F.array().cast(frames.schema["anchors"].dataType)).alias("anchors"))


def layers(tracks: DataFrame, keys: Keys, *, color: str = "#e4572e", status: str = "done") -> DataFrame:
    """keys, track_id, name, color, status: one layer per track; ids follow from the key, so a rerun gives the same."""
    keys = list(keys)
    label = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    return tracks.select(*keys, F.substring(F.sha2(label, 256), 1, 10).alias("track_id"), F.concat(F.lit("track "), label).alias("name"), F.lit(color).alias("color"), F.lit(status).alias("status"))
