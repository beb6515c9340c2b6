"""Domain tables derived from the analytics tables the queries are given."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calibration as cal_fn
from ..operators import tiling
from ..operators.sequence import per_key, running_sum
from ..operators.tiling import hot_keys, number_rows, tile_tracks

KEY = ["clip_id"]
MOTION_FRAMES = 60
DEALT_ROWS = 1 << 17  # points of made motions that one task gets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Epoch microseconds of a zone-less timestamp, whatever the session zone is."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks: one per user, one point per event in time order.

    x = value, y = the number in props, hidden for error events, manual for signups.
    """
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("user_id").alias("clip_id"),
        "event_id",
        micros(F.col("ts")).alias("pts"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_type",
    )
    hot = hot_keys(rows, KEY)
    numbered = number_rows(rows, KEY, ["pts", "event_id"], F.floor(F.col("pts") / 1_000_000), "frame", hot=hot)
    tiled = tile_tracks(numbered, KEY, hot=hot)
    timed = per_key(tiled, KEY, {"first_pts": F.min("pts")})
    tile = ["tile"] if "tile" in tiled.columns else []
    return timed.select(
        "clip_id",
        *tile,
        "frame",
        ((F.col("pts") - F.col("first_pts")) / 1e6).alias("time_s"),
        "x",
        F.col("k").cast("double").alias("y"),
        (F.col("event_type") != "error").alias("visible"),
        ((F.col("k") + 1) / 100.0).alias("confidence"),
        (F.col("event_type") == "signup").alias("manual"),
        F.lit(False).alias("interpolated"),
        "event_id",
        "pts",
    )


def cumulative_points(points: DataFrame, *, all_visible: bool = False) -> DataFrame:
    """The same tracks with x replaced by its running sum: near-uniform motion."""
    cents = F.round(F.col("x") * 100).cast("long")
    summed = running_sum(points, KEY, "frame", {"_x": cents}).withColumn("x", F.col("_x") / 100.0).drop("_x")
    return summed.withColumn("visible", F.lit(True)) if all_visible else summed


def predictions(points: DataFrame) -> DataFrame:
    """Predicted tracks: points moved by a fixed rule, some hidden, some missing."""
    shift = (F.pmod(F.col("event_id") * 37, F.lit(11)) - 5) * 0.5
    jump = F.when(F.pmod(F.col("event_id"), F.lit(29)) == 0, F.lit(60.0)).otherwise(F.lit(0.0))
    return points.filter(F.col("event_id") % 17 != 0).withColumns(
        {
            "x": F.col("x") + shift + jump,
            "y": F.col("y") - shift,
            "visible": F.col("event_id") % 13 != 0,
        }
    )


def repeated_predictions(points: DataFrame) -> DataFrame:
    """The same, with some frames given twice; the later row has the higher ``position``."""
    copies = F.when(F.col("event_id") % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    given = predictions(points).withColumn("position", F.explode(copies))
    return given.withColumn("x", F.col("x") + F.when(F.col("position") == 0, 25.0).otherwise(0.0))


def calibration_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw record per user; the mode and all numbers follow from the user id."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id")).distinct()
    u = F.col("clip_id")
    mode = F.pmod(u, F.lit(4))
    xy = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))
    ruler = lambda a, b, role: F.struct(a.alias("a"), b.alias("b"), F.lit(1.0).alias("length_m"), F.lit(role).alias("role"))
    single = F.array(ruler(xy(0, 0), xy(50 + u % 50, u % 7), "single"))
    pair = F.array(ruler(xy(0, 0), xy(60 + u % 20, 0), "near"), ruler(xy(10, 80), xy(40 + u % 15, 80 + u % 5), "far"))
    quad = F.array(xy(0, 0), xy(100 + u % 20, 5), xy(95 + u % 10, 110), xy(5, 100 + u % 9))
    placed = u % 3 == 0
    lens = F.struct(
        F.lit(320).alias("width"), F.lit(240).alias("height"), F.lit(400.0).alias("fx"), F.lit(410.0).alias("fy"),
        F.lit(None).cast("double").alias("cx"), F.lit(120.0).alias("cy"), F.lit(-0.1).alias("k1"), F.lit(0.01).alias("k2"),
        F.lit(0.001).alias("p1"), F.lit(-0.002).alias("p2"), F.lit(0.0).alias("k3"),
    )
    return users.select(
        "clip_id",
        F.when(mode == 1, "uniform").when(mode == 2, "near_far").when(mode == 3, "planar").otherwise("none").alias("mode"),
        F.when(mode == 1, single).when(mode == 2, pair).otherwise(F.slice(single, 1, 0)).cast(cal_fn.RULER_TYPE).alias("rulers"),
        F.struct(
            F.when(placed, F.lit(10.0)).alias("origin_x"),
            F.when(placed, F.lit(20.0)).alias("origin_y"),
            (u % 90).cast("double").alias("axis_angle_deg"),
            F.lit(True).alias("y_up"),
        ).alias("frame"),
        F.when(mode == 3, F.struct(quad.alias("corners"), F.lit(2.0).alias("width_m"), F.lit(1.5).alias("height_m"))).cast(cal_fn.PLANE_TYPE).alias("plane"),
        F.when(u % 8 == 7, lens).cast(cal_fn.CAMERA_TYPE).alias("camera"),
        (u % 16 == 3).alias("camera_moved"),
        F.lit(0.5).alias("pixel_sigma"),
    )


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal_fn.solve(calibration_records(spark, sf_dir), KEY)


def motion_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form motions, one clip per supplier: line, acceleration, fall, throw, swing, circle.

    The suppliers lie in few and small files. They are dealt by key before their points are made, so
    the points are made in many tasks and later steps by clip need no exchange of them. What a clip's
    points share is worked out once per clip: inlined at each use, the generated method is too long
    for the JIT compiler.
    """
    k = F.col("clip_id")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip_id"))
    hot = hot_keys(suppliers, KEY, tiling.HOT_ROWS // MOTION_FRAMES)
    tasks = max(1, math.ceil(suppliers.count() * MOTION_FRAMES / DEALT_ROWS))
    # dealt by key, a hot clip would stay in one task
    dealt = suppliers.repartition(tasks, *KEY) if hot is None else suppliers.repartition(tasks)
    of_clip = {"_kind": F.pmod(k, F.lit(6)), "_p": F.lit(1.0) + F.pmod(k, F.lit(7)) * 0.1, "_s": F.lit(0.5) + F.pmod(k, F.lit(5)) * 0.1}
    rows = dealt.withColumns(of_clip).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(MOTION_FRAMES - 1))))
    t, p, turn, noise, kind = (F.col(name) for name in ("time_s", "_p", "_turn", "_noise", "_kind"))
    rows = rows.withColumn("time_s", F.col("frame") / 30.0).withColumns(
        {
            "_turn": F.lit(2.0 * math.pi) * t / F.col("_s"),
            "_noise": (F.pmod(F.col("frame") * 7919 + k * 104729, F.lit(13)) - 6) * 0.01 * F.pmod(k, F.lit(3)),
        }
    )
    x = (
        F.when(kind == 0, F.lit(40.0) + p * 90.0 * t)
        .when(kind == 1, F.lit(40.0) + t * 30.0 + p * 60.0 * t * t)
        .when(kind == 2, F.lit(160.0))
        .when(kind == 3, F.lit(20.0) + p * 80.0 * t)
        .when(kind == 4, F.lit(160.0) + p * 40.0 * F.sin(turn))
        .otherwise(F.lit(160.0) + F.cos(turn) * 50.0)
    )
    y = (
        F.when(kind == 0, F.lit(100.0) + t * 10.0)
        .when(kind == 1, F.lit(100.0))
        .when(kind == 2, F.lit(20.0) + p * 490.5 * t * t)
        .when(kind == 3, F.lit(100.0) - t * 120.0 + t * t * 90.0)
        .when(kind == 4, F.lit(100.0) + F.cos(turn * 2.0) * 3.0)
        .otherwise(F.lit(90.0) + F.sin(turn) * 50.0)
    )
    tiled = tile_tracks(rows, KEY, hot=hot)
    tile = ["tile"] if "tile" in tiled.columns else []
    return tiled.select(
        "clip_id", *tile, "frame", "time_s", (x + noise).alias("x"), (y - noise).alias("y"),
        (~((F.pmod(k, F.lit(4)) == 1) & (F.pmod(F.col("frame") + k, F.lit(23)) == 0))).alias("visible"),
        (F.lit(0.7) + F.pmod(F.col("frame") * 31 + k, F.lit(30)) / 100.0).alias("confidence"),
        F.lit(False).alias("manual"), F.lit(False).alias("interpolated"),
    )


def motion_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with an even key have a one-metre ruler of 100 pixels."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip_id")).filter("clip_id % 2 = 0")
    xy = lambda v: F.struct(F.lit(float(v)).alias("x"), F.lit(0.0).alias("y"))
    return cal_fn.solve(suppliers.withColumns(cal_fn.uniform_record(xy(0), xy(100), F.lit(1.0))), KEY, planar=False)


def motion_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pendulum length of every third supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(F.pmod(k, F.lit(3)) != 0).select(k.alias("clip_id"), (F.lit(0.1) + F.pmod(k, F.lit(5)) * 0.05).alias("length_m"))


# --- inputs of the timeline, scoring and report queries --------------------------------------


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets: microsecond pts, some missing, some empty."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("clip_id"), "event_id",
        F.when(i % 23 != 0, micros(F.col("ts"))).alias("pts"), (i % 19).alias("size"),
    )


def decoded_frames(points: DataFrame) -> DataFrame:
    """Decoder timestamps with gaps and steps back."""
    i = F.col("event_id")
    return points.withColumn("pts", F.when(i % 5 != 0, F.col("frame") * 100 + (i % 7 - 3) * 60).cast("long"))


def sparse_points(points: DataFrame) -> DataFrame:
    """What a tracker leaves that gives no row for a frame without its target, and the manual points."""
    return points.filter("visible or manual")


def clip_bounds(points: DataFrame) -> DataFrame:
    last = points.groupBy("clip_id").agg(F.max("frame").alias("_m"))
    c = F.col("clip_id")
    return last.select("clip_id", (c % 3).cast("int").alias("start"), (F.col("_m") + c % 4).cast("int").alias("last"))


def shake_offsets(points: DataFrame) -> DataFrame:
    f, c = F.col("frame"), F.col("clip_id")
    return points.filter(f < 20 + c % 40).select(
        "clip_id", "frame", (((f * 7 + c) % 9 - 4) * 0.5).alias("dx"), (((f * 5 + c) % 7 - 3) * 0.25).alias("dy")
    )


def shake_anchors(points: DataFrame) -> DataFrame:
    """Five anchors per frame that mostly move together; some are lost, some jump."""
    i, k = F.col("event_id"), F.col("k")
    tile = ["tile"] if "tile" in points.columns else []
    rows = points.select("clip_id", *tile, "frame", "event_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    sx = F.when(F.col("frame") == 0, F.lit(0)).otherwise(i * 13 % 41 - 20)
    sy = F.when(F.col("frame") == 0, F.lit(0)).otherwise(i * 7 % 23 - 11)
    jump = F.when((F.col("frame") > 0) & (k >= 2 + i % 2) & (i % 3 == 0), F.lit(60)).otherwise(F.lit(0))
    lost = ((i + k) % 6 == 0) & (F.col("frame") > 0) | ((F.col("frame") > 0) & (i % 31 == 0))
    return rows.select(
        "clip_id", *tile, "frame", "k",
        F.when(~lost, (100 + k * 50 + sx + jump).cast("double")).alias("x"),
        F.when(~lost, (80 + k * 30 + sy - jump).cast("double")).alias("y"),
    )


def pose_frames(spark: SparkSession, sf_dir: str, *, predicted: bool = False) -> DataFrame:
    """Poses: one clip per label, one frame per vector, 17 keypoints placed by the vector."""
    from ..constants import POSE_KEYPOINTS

    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("clip_id"), v.cast("int").alias("frame"), "vec_id", "embedding")
    if predicted:
        rows = rows.filter(v % 13 != 0)
    e = lambda j: F.get("embedding", F.lit(j)).cast("double")
    points = []
    for i, name in enumerate(POSE_KEYPOINTS):
        x, y = F.lit(20.0 * i) + e(2 * i), F.lit(7.0 * (i % 4)) + e(2 * i + 1)
        seen = ((v + i) % 9 != 0) & (v % 7 != 0)
        if predicted:
            off = ((v * 31 + i) % 7 - 3) * 0.5 + F.when((v + i) % 17 == 0, F.lit(9.0)).otherwise(F.lit(0.0))
            x, y, seen = x + off, y - off, (v * 3 + i) % 11 != 0
        points.append(F.struct(F.lit(name).alias("name"), x.alias("x"), y.alias("y"), seen.alias("visible")))
    tiled = tile_tracks(rows.withColumn("keypoints", F.array(*points)), KEY)
    return tiled.drop("embedding", "vec_id")


def clip_difficulty(points: DataFrame) -> DataFrame:
    c = F.col("clip_id")
    return points.select("clip_id").distinct().withColumn("difficulty", F.when(c % 2 == 1, "hard").otherwise("normal"))


def calibration_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ground truth, automatic result) of one calibration clip per customer."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    xy = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    truth = rows.select(
        k.alias("clip_id"),
        F.when(k % 2 == 1, "hard").otherwise("normal").alias("difficulty"),
        xy(F.lit(40), F.lit(140)).alias("ruler_a"), xy(200 + k % 10, F.lit(140)).alias("ruler_b"),
        F.lit(0.8).alias("length_m"), xy(F.lit(40), F.lit(140)).alias("gt_origin"),
        (k % 360).cast("double").alias("gt_axis_angle_deg"), (k % 11 != 0).alias("has_reliable_ruler"),
    )
    found = rows.select(
        k.alias("clip_id"),
        F.when(k % 13 != 0, (200.0 + k % 10) * (1.0 + (k % 7 - 3) * 0.004)).alias("pixels_per_meter"),
        F.when(k % 17 != 0, 40.0 + (k % 9) * 0.5).alias("origin_x"), F.lit(141.0).alias("origin_y"),
        F.when(k % 19 != 0, (k % 360) * 1.0 + (k % 5 - 2) * 0.75 + F.when(k % 3 == 0, F.lit(360.0)).otherwise(F.lit(0.0))).alias("axis_angle"),
        (k % 22 == 0).alias("rejected"),
        F.when(k % 33 == 0, "no_ruler").when(k % 44 == 0, "low_confidence").otherwise("none").alias("failure_reason"),
    )
    return truth, found


def physics_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ground truth, derived quantities) of one physics clip per customer."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    d = lambda v: v.cast("double")
    truth = rows.select(
        k.alias("clip_id"),
        F.when(k % 3 == 0, F.lit(1.2)).alias("period_s"), F.when(k % 2 == 0, F.lit(9.81)).alias("gravity_ms2"),
        F.when(k % 5 != 0, d(k % 4)).alias("velocity_ms"), F.when(k % 5 == 0, F.lit(1.2)).alias("acceleration_ms2"),
    )
    found = rows.select(
        k.alias("clip_id"),
        F.when(k % 7 != 0, 1.2 + (k % 9 - 4) * 0.01).alias("period_s"),
        F.when(k % 4 != 1, 9.81 + (k % 13 - 6) * 0.11).alias("gravity_ms2"),
        (d(k % 4) + (k % 11 - 5) * 0.02).alias("velocity_ms"), F.lit(1.25).alias("acceleration_ms2"),
        F.when(k % 8 != 0, (k % 12) * 0.006).alias("trajectory_fit_error"),
    )
    return truth, found


def doc_reports(spark: SparkSession, sf_dir: str, *, baseline: bool = False) -> DataFrame:
    """Clip reports derived from document sizes; the baseline differs by a fixed rule."""
    i, n = F.col("doc_id"), F.col("n_chars")
    docs = table(spark, sf_dir, "documents")
    shift = (i % 7 - 3) * 0.05 if baseline else F.lit(0.0)
    rows = docs.filter(i % 10 != 9) if baseline else docs
    value = {
        "center_median_px": ((n % 50) / 10.0 + shift, 3.0, False),
        "success_at_10px": (F.least(F.lit(1.0), (n % 20) / 19.0 + shift), 0.95, True),
        "drift_tail_mean_px": (F.when(i % 4 != 0, (n % 30) / 7.0), None, False),
        "identity_swaps": ((n % 3) * 1.0, 1.0, False),
    }
    items = []
    for name, (v, limit, up) in value.items():
        lim = F.lit(limit).cast("double")
        ok = F.when(v.isNotNull() & lim.isNotNull(), (v >= lim) if up else (v <= lim))
        items.append(F.struct(F.lit(name).alias("name"), v.cast("double").alias("value"), lim.alias("threshold"), F.lit(up).alias("higher_is_better"), ok.alias("passed")))
    error = F.when(i % 37 == 0, "decode failed") if not baseline else F.when(i % 41 == 0, "decode failed")
    out = rows.select(F.col("doc_id").alias("clip_id"), F.array(*items).alias("metrics"), error.alias("error"), (0.2 + (i % 11) * 0.1 + (F.lit(0.0) if baseline else (i % 5) * 0.06)).alias("elapsed_s"))
    passed = F.col("error").isNull() & F.forall("metrics", lambda m: F.coalesce(m["passed"], F.lit(True)))
    return out.withColumn("passed", passed).withColumn("metrics", F.when(F.col("error").isNull(), F.col("metrics")))


def depth_readings(points: DataFrame) -> DataFrame:
    i = F.col("event_id")
    res = (i % 50) / 1000.0
    return points.filter(i % 8 == 0).select("clip_id", "frame", res.alias("residual_m"), F.when(res > 0.03, "off_plane").otherwise("ok").alias("flag"))
