"""Track export as CSV text: fixed decimals, empty cells for missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..session import stored


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals without a negative zero; empty when null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.round(value, digits) + F.lit(0.0))).otherwise("")


def csv_rows(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Export cells of kinematic samples; ``unit`` says which header the clip gets."""
    c = F.col
    return samples.select(
        *keys,
        c("position_unit").alias("unit"),
        "frame",
        fixed(c("time_s"), 6).alias("time_s"),
        *[fixed(c(n), 4).alias(n) for n in ("x", "y", "vx", "vy", "speed")],
        c("visible").cast("int").alias("visible"),
        fixed(c("confidence"), 4).alias("confidence"),
        *[fixed(c(n), 6).alias(n) for n in ("sigma_x", "sigma_y")],
        quality.label(c("quality_flags"), c("source")).alias("quality"),
        fixed(c("off_plane_m"), 6).alias("off_plane_m"),
        "source",
    )


def headers(unit: str) -> dict[str, str]:
    """Column names of the export; positions and speeds carry their unit."""
    speed = "m_s" if unit == "m" else "px_s"
    return {"x": f"x_{unit}", "y": f"y_{unit}", "vx": f"vx_{speed}", "vy": f"vy_{speed}", "speed": f"v_{speed}"}


def write_track_csv(samples: DataFrame, path: str, keys: Sequence[str] = ("clip_id",), files_per_clip: bool = False) -> None:
    """One folder per unit, partitioned by clip, rows in frame order inside a file.

    Export stays distributed: clips are spread by key and frame range and never pulled together.
    The cells are worked out once and stored, as each unit has its own header and write.
    """
    rows = stored(csv_rows(samples, keys))
    for unit in ("px", "m"):
        part = rows.filter(F.col("unit") == unit).drop("unit").withColumnsRenamed(headers(unit))
        ordered = part.repartitionByRange(*keys, "frame").sortWithinPartitions(*keys, "frame")
        writer = ordered.write.mode("overwrite").option("header", True).option("emptyValue", "")
        if files_per_clip:
            writer = writer.partitionBy(*keys)
        writer.csv(f"{path}/unit={unit}")
