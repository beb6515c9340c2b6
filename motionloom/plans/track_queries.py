"""Queries on tracks: kinematics, runs, joins, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kinematics as K
from . import views as V
from .registry import r, register, rounded
from .sql_views import FLIPPED, run_ctes, velocity_ctes, with_ctes

KEY = V.KEY


def _series_sql(step: int) -> str:
    return with_ctes(
        "SELECT clip_id, frame, round(time_s, 6) + 0.0 AS time_s, x, y + 0.0 AS y, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy, "
        "round(speed, 6) + 0.0 AS speed, visible, confidence, manual FROM samples",
        "pt",
        ("disp", FLIPPED.format(src="pt")),
        *velocity_ctes("disp", step),
    )


def _series(spark, sf_dir, step):
    samples = K.series(V.event_points(spark, sf_dir), KEY, step=step)
    return samples.select(
        "clip_id", "frame", r("time_s").alias("time_s"), "x", (F.col("y") + 0.0).alias("y"),
        r("vx").alias("vx"), r("vy").alias("vy"), r("speed").alias("speed"), "visible", "confidence", "manual",
    )


@register("kinematic_series", _series_sql(3))
def kinematic_series(spark, sf_dir):
    return _series(spark, sf_dir, 3)


@register("kinematic_series_step1", _series_sql(1))
def kinematic_series_step1(spark, sf_dir):
    return _series(spark, sf_dir, 1)


@register("kinematic_series_step10", _series_sql(10))
def kinematic_series_step10(spark, sf_dir):
    return _series(spark, sf_dir, 25)  # steps are clamped to 1..10


RUNS_SQL = with_ctes(
    "SELECT clip_id, CAST(run_id AS BIGINT) AS run_id, min(frame) AS frame_start, max(frame) AS frame_end, "
    "round(min(time_s), 6) AS time_start_s, round(max(time_s), 6) AS time_end_s, count(*) AS n FROM runs GROUP BY clip_id, run_id",
    "pt", *run_ctes("pt"),
)


@register("run_segments", RUNS_SQL)
def run_segments(spark, sf_dir):
    return rounded(K.run_bounds(V.event_points(spark, sf_dir), KEY), "time_start_s", "time_end_s")


@register(
    "longest_run",
    with_ctes(
        "SELECT clip_id, frame_start, frame_end, n FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, frame_start) AS rk "
        "FROM (SELECT clip_id, run_id, min(frame) AS frame_start, max(frame) AS frame_end, count(*) AS n FROM runs GROUP BY clip_id, run_id)) WHERE rk = 1",
        "pt", *run_ctes("pt"),
    ),
)
def longest_run(spark, sf_dir):
    bounds = K.run_bounds(V.event_points(spark, sf_dir), KEY)
    return K.longest_run(bounds, KEY).select("clip_id", "frame_start", "frame_end", "n")


@register(
    "track_summary",
    with_ctes(
        "SELECT clip_id, count(*) AS n_points, CAST(sum(CAST(visible AS INT)) AS BIGINT) AS n_visible, round(sum(CAST(visible AS INT)) / greatest(count(*), 1), 6) AS coverage, "
        "round(coalesce(avg(confidence) FILTER (visible), 0), 6) AS mean_confidence, round(coalesce(avg(confidence), 0), 6) AS result_confidence FROM pt GROUP BY clip_id",
        "pt",
    ),
)
def track_summary(spark, sf_dir):
    out = K.track_summary(V.event_points(spark, sf_dir), KEY)
    return rounded(out, "coverage", "mean_confidence", "result_confidence")
