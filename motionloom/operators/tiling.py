"""Splitting of hot tracks, so no window or group ever holds an unbounded track.

A track that holds more than ``HOT_ROWS`` rows gets a ``tile`` column: ``frame`` (an INT,
unique within a track) divided by ``TILE_FRAMES``. A tile therefore holds at most
``TILE_FRAMES`` rows, and a track has at most 2**32 / TILE_FRAMES tiles, negative ones for
negative frames. All other tracks have ``tile = COLD_TILE``. When a table has no hot track the column is not added at all and the
sequence operators plan as plain windows on the track key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOT_ROWS = 1_000_000
TILE_FRAMES = 1 << 18
BROADCAST_KEYS = 1_000_000  # hot keys up to which their list is broadcast; a longer one is joined by shuffle
COLD_TILE = -(1 << 31)  # no INT frame divided by two frames or more gets there
SPLIT = f"tile > {COLD_TILE}"

Keys = Sequence[str]


def hot_keys(df: DataFrame, keys: Keys, limit: int | None = None, *, count: str = "_n", counted: bool = False) -> DataFrame | None:
    """Keys with more than ``limit`` rows, with their ``count`` if ``counted``, or None. One key-only pass, combined map-side.

    There are at most rows / limit such keys; the list carries a broadcast hint where its counted
    length allows it.
    """
    limit = HOT_ROWS if limit is None else limit
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    hot = counts.filter(F.col(count) > limit).select(*keys, *([count] if counted else []))
    n_hot = hot.limit(BROADCAST_KEYS + 1).count()
    if n_hot == 0:
        return None
    return F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot


def mark_hot(df: DataFrame, keys: Keys, hot: DataFrame | None) -> DataFrame:
    """Add ``_hot``; the list was sized, and hinted if short, by :func:`hot_keys`."""
    if hot is None:
        return df.withColumn("_hot", F.lit(False))
    return df.join(hot.withColumn("_hot", F.lit(True)), list(keys), "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def tile_tracks(
    df: DataFrame,
    keys: Keys = ("clip_id",),
    order: str = "frame",
    *,
    hot: DataFrame | None | str = "detect",
    limit: int | None = None,
    tile_frames: int | None = None,
) -> DataFrame:
    """Add ``tile`` where some track is hot; otherwise return ``df`` as it is."""
    if isinstance(hot, str):
        hot = hot_keys(df, keys, limit)
    if hot is None:
        return df
    width = TILE_FRAMES if tile_frames is None else tile_frames
    cell = F.floor(F.col(order) / F.lit(width)).cast("int")
    return (
        mark_hot(df, keys, hot)
        .withColumn("tile", F.when(F.col("_hot"), cell).otherwise(F.lit(COLD_TILE)))
        .drop("_hot")
    )


def number_rows(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    cell: Column,
    out: str,
    *,
    hot: DataFrame | None = None,
) -> DataFrame:
    """0-based position of each row in its key, ordered by ``order``.

    ``cell`` must not decrease along ``order``. Hot keys are numbered cell by cell: counts per
    cell are combined map-side, their running sum is taken over the cells of a key only, and a
    row adds its position inside the cell.
    """
    keys = list(keys)
    if hot is None:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("int"))
    marked = mark_hot(df, keys, hot).withColumn(
        "_cell", F.when(F.col("_hot"), cell.cast("long")).otherwise(F.lit(-1).cast("long"))
    )
    before = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marked.filter("_hot")
        .groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy(*keys, "_cell").orderBy(*order)
    return (
        marked.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_cell"], "left")
        .withColumn(out, (F.col("_pos") + F.coalesce("_before", F.lit(0))).cast("int"))
        .drop("_pos", "_before", "_cell", "_hot")
    )


def parts(df: DataFrame, keys: Keys) -> list[str]:
    """Columns that bound a group: the key, and the tile where the table is tiled."""
    return [*keys, "tile"] if "tile" in df.columns else list(keys)


def is_tiled(df: DataFrame) -> bool:
    return "tile" in df.columns
