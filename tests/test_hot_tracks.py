"""Splitting hot tracks into tiles must not change any result."""

import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motionloom.operators import fitting, joins, kinematics, lookup, metrics, periods, quantiles, sequence, stabilize, tiling, timeline, video
from motionloom.plans import analysis, catalog
from motionloom.plans import views as V
from motionloom.sources import synthetic

KEY = ["clip_id"]


def rows_of(df):
    cols = sorted(c for c in df.columns if c != "tile")

    def canon(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(str(canon(r[c])) for c in cols) for r in df.select(*cols).collect()))


def asked(points):
    return points.select("clip_id", F.col("event_id").alias("cursor_id"), (F.col("frame") + F.col("event_id") % 41 - 20).alias("asked"))


OPERATORS = {
    "series":lambda p: kinematics.series(p, KEY).drop("quality_flags"),
    "series_step10": lambda p: kinematics.series(p, KEY, step=10).drop("quality_flags"),
    "run_bounds": lambda p: kinematics.run_bounds(p, KEY).drop("run_id"),
    "cumulative": lambda p: V.cumulative_points(p).select("clip_id", "frame", "x"),
    "densify": lambda p: timeline.densify(V.sparse_points(p), V.clip_bounds(p), KEY),
    "visible_neighbours": lambda p: timeline.visible_neighbours(p, KEY).select("clip_id", "frame", "prev_visible", "next_visible"),
    "predict": lambda p: timeline.predict_next(p, KEY, (F.lit(-1.0), F.lit(-1.0))).select("clip_id", "frame", "pred_x", "pred_y"),
    "representatives": lambda p: timeline.representative_points(p, KEY).select("clip_id", "frame"),
    "trailing_hidden": lambda p: timeline.trailing_hidden(p, KEY),
    "track_metrics": lambda p: metrics.track_metrics(p, V.repeated_predictions(p), V.clip_difficulty(p), KEY),
    "compensate": lambda p: joins.compensate(p, V.shake_offsets(p), KEY).select("clip_id", "frame", "x", "y"),
    "position_at": lambda p: lookup.position_at(V.sparse_points(p), asked(p), KEY),
    "to_video": lambda p: lookup.to_video(p, V.shake_offsets(p), KEY).select("clip_id", "frame", "x", "y"),
    "anchors_at": lambda p: lookup.anchors_at(V.shake_anchors(p), asked(p), KEY),
    "shake": lambda p: stabilize.estimate_shake(V.shake_anchors(p), KEY),
    "repair": lambda p: video.repair_pts(V.decoded_frames(p), KEY, 40),
    "fit": lambda p: fitting.fit_quantity(V.cumulative_points(p), KEY, "x", 1).select("clip_id", "n", F.round("r2", 5).alias("r2")),
    "zero_crossing": lambda p: fitting.zero_crossing_period(p, KEY, "x"),
    "fingerprint": lambda p: catalog.fingerprint_points(p, KEY),
    "nearest": lambda p: joins.nearest_in_time(
        p, p.filter("event_id % 7 = 0").select("clip_id", F.col("event_id").alias("cursor_id"), (F.col("time_s") + 700.0).alias("at_s")), KEY
    ),
    "scores": lambda p: analysis.score_models(V.cumulative_points(p), KEY).select("clip_id", "experiment_type", F.round("confidence", 4).alias("c")),
}


@pytest.fixture(scope="module")
def point_sets(spark, sf):
    """The same points plain, and with every larger track cut into small tiles."""
    plain = V.event_points(spark, sf).cache()
    tiled = tiling.tile_tracks(plain, KEY, limit=20, tile_frames=7).cache()
    assert "tile" in tiled.columns and "tile" not in plain.columns
    assert tiled.filter(tiling.SPLIT).count() > 0
    return plain, tiled


@pytest.mark.parametrize("name", list(OPERATORS))
def test_tiles_change_nothing(point_sets, name):
    plain, tiled = point_sets
    assert rows_of(OPERATORS[name](tiled)) == rows_of(OPERATORS[name](plain))


def wanted_pts(points):
    rows = points.select("clip_id", F.row_number().over(W.partitionBy("clip_id").orderBy("frame")).cast("int").alias("frame"), (F.col("frame") * 33).cast("long").alias("pts"), *[c for c in points.columns if c == "tile"])
    asked_pts = points.select("clip_id", F.col("event_id").alias("query_id"), (F.col("frame") * 33 + F.col("event_id") % 90 - 45).alias("value"))
    return video.index_of_pts(rows, asked_pts, KEY)


@pytest.mark.parametrize("name", ["nearest", "position_at", "index_of_pts"])
def test_dealt_cursors_change_nothing(point_sets, monkeypatch, name):
    ask = OPERATORS.get(name, wanted_pts)
    plain, tiled = point_sets
    want = rows_of(ask(plain))
    monkeypatch.setattr(sequence, "CROWD", 3)
    assert rows_of(ask(plain)) == want
    assert rows_of(ask(tiled)) == want


@pytest.mark.parametrize("k", [0, 1])
def test_crowded_cursors_meet_their_rows_in_bounded_parts(point_sets, monkeypatch, k):
    rows = point_sets[k].filter("clip_id = 1").select("clip_id", "frame", *(["tile"] if k else []))
    group = tiling.parts(rows, KEY)
    target = rows.groupBy(*group).agg(F.count("*").alias("n")).orderBy(F.desc("n")).drop("n").limit(1)
    marks = target.crossJoin(rows.sparkSession.range(4000).withColumnRenamed("id", "cursor_id"))
    monkeypatch.setattr(sequence, "CROWD", 500)
    both = sequence.with_marks(rows, marks, group)
    sizes = both.join(target, group).groupBy("part").agg(F.count("cursor_id").alias("marks"), F.count("frame").alias("rows")).collect()
    assert len(sizes) == 8 and sum(r.marks for r in sizes) == 4000
    assert max(r.marks for r in sizes) < 2 * 500
    assert {r.rows for r in sizes} == {rows.join(target, group).count()}


def test_numbering_by_cells(spark, sf, monkeypatch):
    plain = rows_of(V.event_points(spark, sf))
    monkeypatch.setattr(tiling, "HOT_ROWS", 20)
    monkeypatch.setattr(tiling, "TILE_FRAMES", 7)
    split = V.event_points(spark, sf)
    assert "tile" in split.columns
    assert rows_of(split) == plain


def test_median_by_rank_selection(spark, sf):
    points = V.event_points(spark, sf)
    plain = points.groupBy("clip_id").agg(F.median("x").alias("median"))
    assert rows_of(quantiles.exact_median(points, KEY, F.col("x"), limit=10)) == rows_of(plain)


def test_periods_of_split_runs(spark, monkeypatch):
    clip = synthetic.pendulum(spark, n=120)
    want = periods.periods(clip, KEY).first()["period_s"]
    assert want == pytest.approx(1.1, rel=0.02)
    monkeypatch.setattr(periods, "GRID_TILE", 16)  # the first peak lies beyond the neighbouring tile
    tiled = tiling.tile_tracks(clip, KEY, limit=10, tile_frames=16)
    assert periods.periods(tiled, KEY).first()["period_s"] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("tiles", [0.6, 1.8, 2.5])
def test_periods_of_untiled_runs_of_many_grid_tiles(spark, monkeypatch, tiles):
    width, n = 32, 400
    monkeypatch.setattr(periods, "GRID_TILE", width)
    turn = 2 * math.pi / (tiles * width)
    x = np.array([math.sin(turn * f) + 0.4 * math.sin(3 * turn * f + 1) + 0.002 * f for f in range(n)])
    y = np.array([math.cos(turn * f / 1.3) for f in range(n)])
    clip = spark.createDataFrame([(1, f, f / 8, float(x[f]), float(y[f])) for f in range(n)], "clip_id int, frame int, time_s double, x double, y double")
    want = {}
    for axis, line in (("x", x), ("y", y)):
        c = np.correlate(line - line.mean(), line - line.mean(), "full")[n - 1 :]
        want[axis] = next(k / 8 for k in range(2, n - 1) if c[k] >= max(c[k - 1], c[k + 1]) and c[k] > periods.CLEAR_SHARE * c[0])
    got = {r.axis: r.period_s for r in periods.correlation_periods(clip, KEY).collect()}
    assert got == pytest.approx(want)


def test_runs_that_stand_still_or_pause(spark, monkeypatch):
    monkeypatch.setattr(periods, "GRID_TILE", 64)
    monkeypatch.setattr(timeline, "CHUNK", 100)
    swing = lambda t: math.sin(2 * math.pi * t / 0.5)
    rows = [(1, f, f / 30, 5.0, 7.0) for f in range(200)]
    rows += [(2, f, t, swing(t), 0.0) for f in range(200) for t in [f / 30 + (300.0 if f >= 100 else 0.0)]]
    clips = spark.createDataFrame(rows, "clip_id int, frame int, time_s double, x double, y double")
    plain = {r.clip_id: r.period_s for r in periods.periods(clips, KEY).collect()}
    split = {r.clip_id: r.period_s for r in periods.periods(tiling.tile_tracks(clips, KEY, limit=50, tile_frames=32), KEY).collect()}
    assert 1 not in plain and 1 not in split
    assert plain[2] == pytest.approx(0.5, rel=0.05) and split[2] == pytest.approx(plain[2], rel=1e-9)


def test_negative_frames_are_split_too(spark):
    rows = [(1, f, f / 10, float(f % 7), 1.0, f % 11 != 0, 1.0, False) for f in range(-40, 60)]
    clips = spark.createDataFrame(rows, "clip_id int, frame int, time_s double, x double, y double, visible boolean, confidence double, manual boolean")
    tiled = tiling.tile_tracks(clips, KEY, limit=10, tile_frames=8)
    assert tiled.filter("tile < 0").count() == 40
    for run in (lambda p: kinematics.run_bounds(p, KEY).drop("run_id"), lambda p: kinematics.series(p, KEY).drop("quality_flags")):
        assert rows_of(run(tiled)) == rows_of(run(clips))


def test_more_hot_keys_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tiling, "BROADCAST_KEYS", 3)
    clips = spark.createDataFrame([(k, f) for k in range(8) for f in range(20)], "clip_id int, frame int")
    tiled = tiling.tile_tracks(clips, KEY, limit=10, tile_frames=4)
    assert tiled.select("clip_id", "tile").distinct().count() == 8 * 5


@pytest.mark.parametrize("odd", [[], [float("nan")], [float("inf")] * 3, [float("-inf")] * 30, [float("nan")] * 30, [1e308, -1e308, 5e-324, 0.0]])
def test_medians_of_odd_values(spark, odd):
    rows = [(1, v) for v in [*odd, *(float(k % 9) for k in range(21))]] + [(2, 3.5)] * 40
    values = spark.createDataFrame(rows, "clip_id int, x double")
    want = rows_of(values.groupBy("clip_id").agg(F.median("x").alias("median")))
    assert rows_of(quantiles.exact_median(values, KEY, F.col("x"), limit=10)) == want


def test_cursors_beyond_both_ends_of_a_split_track(spark):
    clips = spark.createDataFrame([(1, f, float(f)) for f in range(30)], "clip_id int, frame int, time_s double")
    cursors = spark.createDataFrame([(1, 1, -9.0), (1, 2, 12.4), (1, 3, 12.5), (1, 4, 99.0)], "clip_id int, cursor_id long, at_s double")
    tiled = tiling.tile_tracks(clips, KEY, limit=10, tile_frames=4)
    for table in (clips, tiled):
        assert {r.cursor_id: r.frame for r in joins.nearest_in_time(table, cursors, KEY).collect()} == {1: 0, 2: 12, 3: 12, 4: 29}
    frames = clips.select("clip_id", "frame", (F.col("frame") * 10).cast("long").alias("pts"))
    asked = spark.createDataFrame([(1, 1, -5), (1, 2, 120), (1, 3, 121), (1, 4, 999)], "clip_id int, query_id long, value long")
    for table in (frames, tiling.tile_tracks(frames, KEY, limit=10, tile_frames=4)):
        assert {r.query_id: r.frame for r in video.index_of_pts(table, asked, KEY).collect()} == {1: 0, 2: 12, 3: 13, 4: 29}


def test_long_ranges_are_chunked(spark, monkeypatch):
    monkeypatch.setattr(timeline, "CHUNK", 5)
    bounds = spark.createDataFrame([(1, 0, 23), (2, 4, 4), (3, 5, 2)], "clip_id long, start int, last int")
    got = timeline.sample_grid(bounds, KEY, 3)
    want = [(1, f) for f in (0, 3, 6, 9, 12, 15, 18, 21, 23)] + [(2, 4)]
    assert sorted((r.clip_id, r.frame) for r in got.collect()) == want


@pytest.mark.parametrize("n", [33, 64, 100, 1000])
def test_lag_products_of_blocks_equal_the_plain_sums(spark, monkeypatch, n):
    monkeypatch.setattr(periods, "GRID_TILE", 8)
    rng = np.random.default_rng(n)
    runs = {k: rng.normal(size=(2, n + k)) for k in (1, 2)}
    rows = [(k, g, float(v[0, g]), float(v[1, g]), n + k) for k, v in runs.items() for g in range(n + k)]
    got = periods.lag_products(spark.createDataFrame(rows, "clip_id int, g long, x double, y double, size long"), KEY).toPandas()
    for k, v in runs.items():
        mine = got[got["clip_id"] == k].sort_values("lag")
        assert mine["lag"].tolist() == list(range(n + k))
        for axis, line in zip(("cx", "cy"), v, strict=True):
            assert mine[axis].to_numpy() == pytest.approx(np.correlate(line, line, "full")[n + k - 1 :], abs=1e-9)


def test_blocks_of_a_long_run_stay_bounded():
    for size in (1 << 15, 1 << 20, 1 << 27):
        rows, columns, deep, wide = periods.layout(size, 1 << 16)
        assert 2 * size <= rows * columns < 8 * size
        assert rows * wide <= 1 << 16 and deep * columns <= 1 << 16
