"""Tokens of everything an analysis was made from, and which saved analyses are out of date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]


def fixed(value: Column, digits: int) -> Column:
    """A number as text with so many decimals moved before the point, half to even; '-' for null."""
    return F.coalesce(F.bround(value * 10**digits).cast("decimal(38,0)").cast("string"), F.lit("-"))


def _sums(text: Column) -> list[Column]:
    """Order-free digest of the non-null texts of a group: their number and three sums of hash parts."""
    digest = F.sha2(text, 256)
    parts = [F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)")) for at in (1, 13, 25)]
    return [F.count(text).cast("string"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]]


def source_tokens(points: DataFrame, keys: Keys, *, clip: Keys | None = None, settings: DataFrame | None = None, frames: DataFrame | None = None, calibrations: DataFrame | None = None, offsets: DataFrame | None = None) -> DataFrame:
    """keys, fingerprint: 24 hexadecimal digits that change when any source of a track's analysis does.

    * ``points``: keys, frame, x, y, visible, confidence, manual; four decimals count
    * ``settings``: keys, path, shake_enabled, confirmed_type, length_m (six decimals)
    * ``frames``: clip keys, pts_ms; the first, the last and their number count
    * ``calibrations``: clip keys, record (its text)
    * ``offsets``: clip keys, frame, dx, dy; three decimals count

    Tables keyed by clip meet in one exchange, all digests are sums that combine map-side, so
    neither a hot track nor a hot clip is gathered. A track needs a row in points or settings.
    """
    keys, clip = list(keys), list(clip or keys)
    spot = F.concat_ws("|", "frame", fixed(F.col("x"), 4), fixed(F.col("y"), 4), F.col("visible").cast("string"), fixed(F.col("confidence"), 4), F.col("manual").cast("string"))
    tokens = points.select(*keys, spot.alias("_t")).groupBy(*keys).agg(F.concat_ws("|", *_sums(F.col("_t"))).alias("_points"))
    if settings is not None:
        text = F.concat_ws("|", F.coalesce("path", F.lit("")), F.coalesce("shake_enabled", F.lit(False)).cast("string"), F.coalesce("confirmed_type", F.lit("-")), fixed(F.col("length_m"), 6))
        tokens = tokens.join(settings.select(*keys, text.alias("_settings")), keys, "full")
    null = lambda kind: F.lit(None).cast(kind)
    sides = []
    if frames is not None:
        sides.append(frames.select(*clip, F.col("pts_ms").cast("long").alias("_ms"), null("string").alias("_record"), null("string").alias("_move")))
    if calibrations is not None:
        sides.append(calibrations.select(*clip, null("long").alias("_ms"), F.col("record").alias("_record"), null("string").alias("_move")))
    if offsets is not None:
        move = F.concat_ws("|", "frame", fixed(F.col("dx"), 3), fixed(F.col("dy"), 3))
        sides.append(offsets.select(*clip, null("long").alias("_ms"), null("string").alias("_record"), move.alias("_move")))
    if sides:
        rows = sides[0]
        for side in sides[1:]:
            rows = rows.unionByName(side)
        bounds = [F.coalesce(c.cast("string"), F.lit("-")) for c in (F.min("_ms"), F.max("_ms"), F.count("_ms"))]
        shared = rows.groupBy(*clip).agg(F.concat_ws("|", *bounds, F.coalesce(F.max("_record"), F.lit("-")), *_sums(F.col("_move"))).alias("_clip"))
        tokens = tokens.join(shared, clip, "left")
    found = [F.coalesce(c, F.lit("-")) for c in ("_points", "_settings", "_clip") if c in tokens.columns]
    return tokens.select(*keys, F.substring(F.sha2(F.concat_ws("#", *found), 256), 1, 24).alias("fingerprint"))


def stale(saved: DataFrame, tokens: DataFrame, keys: Keys) -> DataFrame:
    """keys, fingerprint, stale of every saved analysis (keys, fingerprint, stale).

    It is stale once marked so, or when its token is not that of the sources now; one that never
    had a token is not. Sources that are gone have a null token and differ.
    """
    keys = list(keys)
    now = tokens.withColumnRenamed("fingerprint", "_now")
    had = F.coalesce(F.col("fingerprint"), F.lit("")) != ""
    out = F.coalesce("stale", F.lit(False)) | (had & ~F.col("fingerprint").eqNullSafe(F.col("_now")))
    return saved.join(now, keys, "left").select(*keys, F.col("_now").alias("fingerprint"), out.alias("stale"))
