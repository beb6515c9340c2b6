"""Closed-form clips, hand-made inputs and brute-force checks of what SQL cannot express."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.functions import calibration as cal_fn
from motionloom.functions import text
from motionloom.operators import depth, kinematics, metrics, stabilize
from motionloom.plans import analysis
from motionloom.plans import views as V
from motionloom.sources import annotations, synthetic

KEY = ["clip_id"]


def test_velocity_on_hand_data(spark):
    rows = [(1, f, f * 0.1, 10.0 * f, 0.0, f != 2, 1.0, False) for f in range(5)]
    pts = spark.createDataFrame(rows, "clip_id int, frame int, time_s double, x double, y double, visible boolean, confidence double, manual boolean")
    vx = [r.vx for r in kinematics.series(pts, KEY).orderBy("frame").collect()]
    assert vx[2] is None and all(v == pytest.approx(100.0) for i, v in enumerate(vx) if i != 2)


def test_experiments_are_recognised(spark):
    clips = [synthetic.slider(spark), synthetic.free_fall(spark), synthetic.acceleration(spark), synthetic.projectile(spark), synthetic.pendulum(spark)]
    points = clips[0]
    for c in clips[1:]:
        points = points.unionByName(c)
    xy = lambda v: F.struct(F.lit(float(v)).alias("x"), F.lit(0.0).alias("y"))
    cal = cal_fn.solve(points.select("clip_id").distinct().withColumns(cal_fn.uniform_record(xy(0), xy(100), F.lit(1.0))), KEY, planar=False)
    lengths = points.select("clip_id").distinct().withColumn("length_m", F.lit(0.3007))
    found = {r.clip_id: r for r in analysis.analyze(points, KEY, calibration=cal, pendulum_length=lengths, period_hint=True).collect()}
    kinds = {"slider": "uniform_linear", "free_fall": "free_fall", "acceleration": "uniform_accel", "projectile": "projectile", "pendulum": "pendulum"}
    assert {k: found[k].candidates[0].experiment_type for k in kinds} == kinds
    assert found["free_fall"].candidates[0].parameters["g"] == pytest.approx(9.81, rel=0.01)
    assert found["acceleration"].candidates[0].parameters["a"] == pytest.approx(1.2, rel=0.01)
    assert found["pendulum"].candidates[0].parameters["T"] == pytest.approx(1.1, rel=0.02)


def shake_of(spark, frames):
    """Shift per frame of one clip; ``frames``: per frame a dict anchor -> (x, y) or None."""
    rows = [(1, f, k, *(p or (None, None))) for f, seen in enumerate(frames) for k, p in seen.items()]
    anchors = spark.createDataFrame(rows, "clip_id int, frame int, k int, x double, y double")
    return {r.frame: (r.dx, r.dy) for r in stabilize.estimate_shake(anchors, KEY).collect()}


START = {0: (10.0, 10.0), 1: (110.0, 10.0), 2: (10.0, 110.0), 3: (110.0, 110.0)}


def moved(dx, dy, **other):
    return {k: (x + dx, y + dy) for k, (x, y) in START.items()} | {int(k[1:]): p for k, p in other.items()}


def test_shake_of_hand_worked_frames(spark):
    frames = [
        START,
        moved(3, -2),  # all agree
        moved(5, 1, a3=(300.0, 300.0)),  # a clear majority of three, one lost to something else
        {k: None for k in START},  # nothing seen: the last shift stays
        moved(7, 0, a2=(97.0, 110.0), a3=(197.0, 110.0)),  # two against two: the pair nearer to (5, 1) wins
        {0: (16.0, 14.0), 1: None, 2: None, 3: None},  # a single anchor speaks alone
    ]
    assert shake_of(spark, frames) == {0: (0.0, 0.0), 1: (3.0, -2.0), 2: (5.0, 1.0), 3: (5.0, 1.0), 4: (7.0, 0.0), 5: (6.0, 4.0)}


def test_shake_follows_the_frame_not_the_names_of_anchors(spark, sf):
    anchors = V.shake_anchors(V.event_points(spark, sf))
    rows = lambda df: {(r.clip_id, r.frame): (round(r.dx, 6), round(r.dy, 6)) for r in stabilize.estimate_shake(df, KEY).collect()}
    base = rows(anchors)
    assert rows(anchors.withColumns({"x": F.col("x") + 40, "y": F.col("y") - 15})) == base
    assert all(v == (0.0, 0.0) for (_, frame), v in base.items() if frame == 0)


def test_plane_depth_against_pinhole(spark):
    k = np.array([[800.0, 0, 320], [0, 800.0, 240], [0, 0, 1]])
    a = np.radians(25)
    rot = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    shift = np.array([-0.5, -0.3, 3.0])

    def see(x, y):
        cam = rot @ np.array([x, y, 0.0]) + shift
        u = k @ cam
        return u[0] / u[2], u[1] / u[2], cam[2]

    quad = [see(*p)[:2] for p in ((0, 0), (1, 0), (1, 0.8), (0, 0.8))]
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in quad])
    record = cal_fn.planar_record(corners, F.lit(1.0), F.lit(0.8))
    record["camera"] = F.struct(*[F.lit(v).alias(n) for n, v in dict(width=640, height=480, fx=800.0, fy=800.0, cx=320.0, cy=240.0, k1=0.0, k2=0.0, p1=0.0, p2=0.0, k3=0.0).items()])
    posed = depth.with_pose(cal_fn.solve(spark.createDataFrame([(1,)], "clip_id int").withColumns(record), KEY), KEY)
    u, v, z = see(0.4, 0.3)
    pts = spark.createDataFrame([(1, 0, float(u), float(v))], "clip_id int, frame int, x double, y double")
    row = cal_fn.pixel_to_world(depth.expected_depth(pts, posed, KEY), "x", "y", ("wx", "wy")).first()
    assert (row.wx, row.wy) == pytest.approx((0.4, 0.3), abs=1e-6)
    assert row.z_geom == pytest.approx(z, abs=1e-6)


def test_annotation_and_manifest_reader(spark, tmp_path):
    clip = {"clip_id": "a", "task": "track", "scene": "ball", "difficulty": "normal", "width": 320, "height": 180, "fps": 30, "frame_count": 2,
            "track": [{"frame": 0, "center": {"x": 1, "y": 2}}, {"frame": 1, "center": {"x": 2.5, "y": 2}, "visible": False}]}
    (tmp_path / "a.json").write_text(json.dumps(clip, indent=2))
    read = annotations.read_annotations(spark, str(tmp_path / "a.json"))
    assert [(r.frame, r.x, r.visible) for r in annotations.track_points(read).orderBy("frame").collect()] == [(0, 1.0, True), (1, 2.5, False)]
    entry = {k: "" for k in ("relative_path", "annotation_path", "sha256", "task", "scene", "difficulty")} | {"clip_id": "a", "width": 1, "height": 1, "fps": 1.0, "frame_count": 1}
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "1.0.0", "entries": [entry]}, indent=2))
    row = annotations.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (row.split, row.license, row.hidden) == ("dev", "unknown", False)


def test_version_rules(spark):
    tags = spark.createDataFrame([("v1.10.0", "1.9.9"), ("1.2", "1.0.0"), ("V2.0.0", "2.0.0")], "a string, b string")
    assert [r[0] for r in tags.select(text.is_newer(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_last_row_of_a_frame_and_last_keypoint_of_a_name_win(spark):
    cols = "clip_id int, frame int, x double, y double, visible boolean, position int"
    gt = spark.createDataFrame([(1, 0, 0.0, 0.0, True, 0), (1, 1, 0.0, 0.0, True, 0)], cols)
    pred = spark.createDataFrame([(1, 0, 3.0, 4.0, True, 1), (1, 0, 9.0, 9.0, True, 0), (1, 1, 0.0, 1.0, True, 0)], cols)
    assert sorted((r.frame, r.err) for r in metrics.match_frames(gt, pred, KEY).collect()) == [(0, 5.0), (1, 1.0)]
    point = "array<struct<name:string,x:double,y:double,visible:boolean>>"
    rows = spark.createDataFrame([([("a", 1.0, 0.0, True), ("b", 2.0, 0.0, True), ("a", 3.0, 0.0, True)],)], f"k {point}")
    found = rows.select(metrics.by_name(F.col("k")).alias("m")).first().m
    assert {name: p.x for name, p in found.items()} == {"a": 3.0, "b": 2.0}
