"""Measurement quality of samples: flags, labels, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LOW_CONFIDENCE

DOUBTFUL = ("extrapolated", "off_plane", "ai_estimate")


def flags(visible: Column, extrapolated: Column, off_plane: Column, corrected: Column) -> Column:
    """Quality flags of a visible point, in fixed order; empty for hidden points."""
    raw = F.array(
        F.when(visible & extrapolated, "extrapolated"),
        F.when(visible & off_plane, "off_plane"),
        F.when(visible & off_plane & corrected, "ai_estimate"),
    )
    return F.array_compact(raw)


def low_confidence(visible: Column, confidence: Column, quality_flags: Column) -> Column:
    weak = visible & (confidence < LOW_CONFIDENCE)
    return weak | F.arrays_overlap(quality_flags, F.array(*[F.lit(f) for f in DOUBTFUL]))


def label(quality_flags: Column, source: Column) -> Column:
    has = lambda flag: F.array_contains(quality_flags, flag)
    return (
        F.when(has("ai_estimate"), "ai estimate")
        .when(has("off_plane"), "off plane")
        .when(has("extrapolated"), "extrapolated")
        .when(source == "geometric", "geometric")
        .when(source == "scaled", "ruler")
        .otherwise("pixel")
    )


def tooltip(sample: dict[str, Column]) -> Column:
    """One-line summary; parts without a value are left out."""
    s = sample
    source_named = ~F.coalesce(s["source"], F.lit("")).isin("", "pixel", "scaled", "geometric")
    in_metres = s["sigma_x"].isNotNull() & s["sigma_y"].isNotNull() & (s["position_unit"] == "m")
    return F.concat_ws(
        " / ",
        label(s["quality_flags"], s["source"]),
        F.when(source_named, s["source"]),
        F.when(in_metres, F.format_string("sx=%.4f m  sy=%.4f m", s["sigma_x"], s["sigma_y"])),
        F.when(s["off_plane_m"].isNotNull(), F.format_string("off plane by %.3f m", s["off_plane_m"])),
        F.when(s["visible"] & (s["confidence"] < LOW_CONFIDENCE), F.format_string("track confidence %.2f", s["confidence"])),
    )
