"""JSON and Markdown documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, path: str) -> None:
    """Clip reports as JSON lines; the same layout serves as baseline."""
    reports.write.mode("overwrite").json(path)


def write_track_json(points: DataFrame, path: str, buckets: int = 64) -> None:
    """Points as JSON lines in frame order, in a bounded number of folders by hash of the clip.

    Ranges of (bucket, clip, frame) are dealt to the tasks, so a long track is never gathered.
    """
    placed = points.withColumn("bucket", F.pmod(F.xxhash64("clip_id"), F.lit(buckets)).cast("int"))
    order = ("bucket", "clip_id", "frame")
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").json(path)


def project_documents(projects: DataFrame) -> DataFrame:
    """One project document per row, schema version 5."""
    return projects.select("video_path", F.to_json(F.struct(F.lit("5").alias("schema"), *[c for c in projects.columns if c != "schema"])).alias("document"))


def write_markdown(reports: DataFrame, path: str) -> None:
    reports.select("markdown").write.mode("overwrite").option("lineSep", "\n\f\n").text(path)
