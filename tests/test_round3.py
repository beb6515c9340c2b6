"""Large tables: last bits of depths as in the SQL, list helpers that work each part out once."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from motionloom.functions import calibration as cal_fn
from motionloom.functions import pixels, text
from motionloom.operators import fitting, kinematics, stabilize, tiling
from motionloom.plans import views


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_depths_past_a_power_of_two_get_the_flags_of_the_sql(spark, tmp_path):
    """Residuals equal to the limit: the last bit of the depth decides the flag."""
    copies = " UNION ALL ".join(
        f"SELECT * REPLACE (user_id + {1500 * i} AS user_id, event_id + {100000 * i} AS event_id) FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = {u}"
        for u, i in ((903, 2), (43, 3), (1487, 4), (443, 5))
    )
    con = duckdb.connect()
    con.execute(f"COPY ({copies}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    names = ["clip_id", "frame", "z_geom", "residual_m", "flag"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()['depth_audit']})").fetchall()
    got = entry.queries()["depth_audit"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(want) == sorted(tuple(r) for r in got) and len(want) > 20


def test_checksum_lines_are_split_once_and_the_last_of_a_name_wins(spark):
    lines = [f"{i:064x}  dist/file{i % 3}" for i in range(1, 3001)] + ["# no", "x  y"]
    rows = spark.createDataFrame([(1, "\n".join(lines)), (2, "# no"), (3, None)], "k int, body string")
    found = rows.select("k", text.checksums(F.col("body")).alias("m"))
    assert optimized(found).count("split(body") == 1
    assert {r.k: r.m for r in found.collect()} == {1: {f"file{k}": f"{i:064x}" for k, i in ((0, 3000), (1, 2998), (2, 2999))}, 2: {}, 3: None}


def test_consensus_measures_its_groups_once(spark):
    pairs = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 2.0}, {"x": 100.0, "y": 0.0}, {"x": 104.0, "y": 6.0}]
    rows = spark.createDataFrame([(pairs,), ([],)], "pairs array<struct<x:double,y:double>>")
    found = rows.select(stabilize.consensus(F.col("pairs")).alias("c"))
    assert optimized(found).lower().count("power(") == 2
    assert [[(c.dx, c.dy) for c in r.c] for r in found.collect()] == [[(2.0, 1.0), (102.0, 3.0)], []]


def test_near_far_points_are_found_in_batches(spark):
    xy = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ruler = lambda a, b, role: F.struct(a.alias("a"), b.alias("b"), F.lit(1.0).alias("length_m"), F.lit(role).alias("role"))
    record = cal_fn.near_far_record(ruler(xy(0, 0), xy(60, 0), "near"), ruler(xy(10, 80), xy(40, 80), "far"))
    solved = cal_fn.solve(spark.range(1).withColumns(record), ["id"])
    points = spark.createDataFrame([(0, float(x), float(y)) for x in range(0, 60, 7) for y in range(1, 90, 11)] + [(0, 0.0, 0.0), (0, None, 1.0)], "id long, x double, y double")
    mapped = cal_fn.pixel_to_world(points.join(solved, "id"), "x", "y", ("wx", "wy"))
    back = cal_fn.world_to_pixel(mapped, "wx", "wy", ("bx", "by"))
    assert "_along(" in optimized(back)
    rows = [r for r in back.collect() if r.x is not None]
    assert np.allclose([(r.x, r.y) for r in rows], [(r.bx, r.by) for r in rows], atol=1e-6)


def test_a_dip_that_is_not_curved_has_no_offset_and_no_width(spark):
    rows = spark.createDataFrame([(1, 0.023, 0.019, 0.0001), (2, 1.0, 1.0, 1.0), (3, 2.0, 1.0, 3.0), (4, None, 1.0, 3.0)], "k int, l double, c double, r double")
    found = rows.select("k", pixels.parabolic_offset(F.col("l"), F.col("c"), F.col("r")).alias("p")).select("k", "p.*").collect()
    assert {r.k: (r.offset, r.width) for r in found} == {1: (0.0, None), 2: (0.0, None), 3: (-1 / 6, np.sqrt(2 / 1.5)), 4: (0.0, None)}


def test_values_equal_to_the_mean_cross_alike_in_any_row_order(spark):
    values = {c: [round(0.1 * ((7 * f * c + f) % (3 + c % 5)) + 0.1, 2) for f in range(24)] for c in range(60)}
    rows = [(c, f, f * 0.5, v) for c, vs in values.items() for f, v in enumerate(vs)]
    found = []
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1] * 7 % 24)):
        points = spark.createDataFrame(order, "clip_id int, frame int, time_s double, x double")
        found.append({r.clip_id: r.period_s for r in fitting.zero_crossing_period(points, ["clip_id"], "x").collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 30


def test_motions_are_dealt_before_their_points_are_made(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    want = sorted(map(tuple, views.motion_points(spark, sf).collect()))
    monkeypatch.setattr(views, "DEALT_ROWS", 10_000)
    points = views.motion_points(spark, sf)
    assert points.rdd.getNumPartitions() == 6
    assert optimized(points).count("pmod(clip_id") == 5  # kind, pace, period, size of the noise and visible
    runs = fitting.run_sums(fitting.with_run_frame(kinematics.runs(points, ["clip_id"]), ["clip_id"]), ["clip_id"])
    assert runs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, points.collect())) == want and len(want) == 60_000
    monkeypatch.setattr(tiling, "HOT_ROWS", 59)
    tiled = views.motion_points(spark, sf)
    assert "tile" in tiled.columns and "RoundRobinPartitioning" in tiled._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, tiled.drop("tile").collect())) == want


def test_runs_are_summed_once_for_models_and_swings(spark):
    """The sums of the longest runs, which models and swings both read, are stored."""
    report = entry.queries()["report_markdown"](spark, "/root/testdata/sf0.1")
    assert "var_pop" not in optimized(report)
