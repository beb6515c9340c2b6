"""Composed scans against plain walks, with blocks of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from motionloom.operators import scan, stabilize, video


@pytest.mark.parametrize("block", [1024, 3, 2])
def test_late_timestamps_are_raised_as_by_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    draw = random.Random(block)
    rows, want = [], {}
    for clip in [None, *range(12)]:
        last = None
        for frame in range(draw.randint(1, 60)):
            pts = None if draw.random() < 0.1 else frame * 40 + draw.randint(-400, 400) - (3000 if draw.random() < 0.05 else 0)
            rows.append((clip, frame, pts))
            value = frame * 40 if pts is None else pts
            last = value if last is None or value > last else last + 40
            want[clip, frame] = last
    frames = spark.createDataFrame(rows, "clip int, frame int, pts long").repartition(5)
    whole = frames.select("clip", F.lit(0).alias("run_id"), "frame", F.coalesce("pts", F.col("frame") * 40).cast("long").alias("_v"))
    scanned = scan.composed_scan(whole, ["clip", "run_id"], "_v", F.lit(-(2**62)).cast("long"), scan.raised(40))
    assert {(r.clip, r.frame): r.state for r in scanned.collect()} == want
    known = frames.filter("clip IS NOT NULL")
    got = {(r.clip, r.frame): r.pts for r in video.repair_pts(known, ["clip"], 40).collect()}
    assert got == {k: v for k, v in want.items() if k[0] is not None}


@pytest.mark.parametrize("block", [1024, 3])
def test_ties_take_the_nearest_option_as_by_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    draw = random.Random(7)
    rows, want = [], {}
    for clip in range(8):
        last = (0.0, 0.0)
        for frame in range(draw.randint(1, 50)):
            options = [(float(draw.randint(-4, 4)), float(draw.randint(-4, 4))) for _ in range(draw.choice([0, 1, 2, 2, 3, 5]))]
            if options:
                last = min(options, key=lambda o: (o[0] - last[0]) ** 2 + (o[1] - last[1]) ** 2)
            rows.append((clip, frame, options))
            want[clip, frame] = last
    frames = spark.createDataFrame(rows, "clip int, frame int, c array<struct<dx:double,dy:double>>").repartition(5)
    start = F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    scanned = scan.composed_scan(frames, ["clip"], "c", start, scan.nearest())
    assert {(r.clip, r.frame): tuple(r.state) for r in scanned.collect()} == want


def test_frames_without_anchors_keep_the_last_shift(spark):
    pairs = [(0, [(0.0, 0.0)]), (1, [(50.0, 0.0), (0.0, 0.0)]), (2, []), (3, [(60.0, 1.0), (-1.0, -1.0)]), (4, [(55.0, 0.0)]), (5, [(50.0, 0.0), (0.0, 0.0)])]
    frames = spark.createDataFrame([("a", f, p) for f, p in pairs], "clip string, frame int, pairs array<struct<x:double,y:double>>")
    got = {r.frame: (r.dx, r.dy) for r in stabilize.robust_shift(frames, ["clip"]).collect()}
    assert got == {0: (0.0, 0.0), 1: (0.0, 0.0), 2: (0.0, 0.0), 3: (-1.0, -1.0), 4: (55.0, 0.0), 5: (50.0, 0.0)}
