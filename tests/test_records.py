"""Staleness tokens, their stream, versioned records and mixed frame indexes."""

import json

import pytest
from pyspark.sql import functions as F

from motionloom.operators import reports, staleness, video
from motionloom.sources import records
from motionloom.streaming.tokens import token_changes

POINTS = "clip int, track int, frame int, x double, y double, visible boolean, confidence double, manual boolean"
ROWS = [(c, t, f, f * 1.5, float(t), True, 0.5, False) for c in (1, 2) for t in (0, 1) for f in range(5)]


def tables(spark, **change):
    given = {
        "points": (ROWS, POINTS), "settings": ([(c, t, "a.mp4", False, None, 0.5) for c in (1, 2) for t in (0, 1)] + [(9, 9, None, None, None, None)], "clip int, track int, path string, shake_enabled boolean, confirmed_type string, length_m double"),
        "frames": ([(1, 0), (1, 40), (1, 80), (2, 5)], "clip int, pts_ms int"), "calibrations": ([(1, "r")], "clip int, record string"),
        "offsets": ([(1, f, 0.25, 0.5) for f in range(5)], "clip int, frame int, dx double, dy double"),
    }
    given |= {name: (rows, given[name][1]) for name, rows in change.items()}
    return {name: spark.createDataFrame(rows, schema).repartition(3) for name, (rows, schema) in given.items()}


def tokens(spark, **change):
    found = staleness.source_tokens(**tables(spark, **change), keys=["clip", "track"], clip=["clip"])
    return {(r.clip, r.track): r.fingerprint for r in found.collect()}


def test_every_source_changes_the_tokens_of_its_tracks(spark):
    base = tokens(spark)
    assert set(base) == {(1, 0), (1, 1), (2, 0), (2, 1), (9, 9)} and len(set(base.values())) == 5
    assert tokens(spark, points=ROWS[::-1]) == base
    changes = {
        "a point": ({"points": [*ROWS[:-1], (2, 1, 4, 6.0002, 1.0, True, 0.5, False)]}, {(2, 1)}),
        "below its decimals": ({"points": [*ROWS[:-1], (2, 1, 4, 6.00004, 1.0, True, 0.5, False)]}, set()),
        "a point twice": ({"points": [*ROWS, ROWS[0]]}, {(1, 0)}),
        "a frame time": ({"frames": [(1, 0), (1, 40), (1, 81), (2, 5)]}, {(1, 0), (1, 1)}),
        "a frame time inside": ({"frames": [(1, 0), (1, 41), (1, 80), (2, 5)]}, set()),
        "a calibration": ({"calibrations": [(1, "r"), (2, "new")]}, {(2, 0), (2, 1)}),
        "an offset": ({"offsets": [(1, f, 0.25 + 0.001 * (f == 3), 0.5) for f in range(5)]}, {(1, 0), (1, 1)}),
        "an offset below its decimals": ({"offsets": [(1, f, 0.25 + 0.0004 * (f == 3), 0.5) for f in range(5)]}, set()),
    }
    for name, (change, want) in changes.items():
        now = tokens(spark, **change)
        assert {k for k in base if now[k] != base[k]} == want, name
    none = tokens(spark, points=[], settings=[])
    assert none == {}


def test_saved_analyses_go_stale(spark):
    saved = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, None, False), (4, "", None), (5, "e", True), (6, "gone", False)], "clip int, fingerprint string, stale boolean")
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "clip int, fingerprint string")
    assert {r.clip: r.stale for r in staleness.stale(saved, now, ["clip"]).collect()} == {1: False, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_stream_emits_changes_only_and_goes_on_after_a_restart(spark, tmp_path):
    schema = "clip int, at int, fingerprint string"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = token_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), ["clip"])
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("a", [(1, 1, "p"), (2, 1, "q"), (1, 2, "p"), (1, 3, "r")])
    assert run() == [(1, 3, "p", "r")]
    put("b", [(1, 4, "r"), (2, 2, None), (3, 1, "s"), (1, 2, "late")])
    assert run() == [(1, 3, "p", "r"), (2, 2, "q", None)]
    put("c", [(1, 6, "r"), (1, 5, "t"), (2, 3, "q")])
    assert run() == [(1, 3, "p", "r"), (1, 5, "r", "t"), (1, 6, "t", "r"), (2, 2, "q", None), (2, 3, None, "q")]


def texts(spark, values):
    return spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)], "k int, text string")


def test_broken_records_are_kept_apart_with_their_reason(spark):
    point = {"frame": 0, "x": 1, "y": 2}
    layer = lambda **more: {"video_path": "v", "tracks": [{"track_id": "t", **more}]}
    values = [
        (None, "not_json"), ("{", "not_json"), ("3", "not_object"), ({}, "no_video_path"), ({"video_path": None}, "no_video_path"), ({"video_path": "v"}, None), ({"video_path": "v", "tracks": None, "track": {}}, None),
        ({"video_path": "v", "tracks": "no"}, "bad_part"), ({"video_path": "v", "tracks": [{}]}, "no_track_id"), (layer(result={"points": [point]}), "no_clip_id"), (layer(result={"clip_id": "c", "points": [{"frame": 0, "x": 1}]}), "bad_point"),
        (layer(result={"clip_id": "c", "points": [point], "failure_reason": "?"}), "bad_failure_reason"), (layer(prompts=[{**point, "kind": "?"}]), "bad_prompt"), (layer(prompts=[point], result={}), None),
        ({"video_path": "v", "calibration": {"mode": "uniform", "rulers": [{"role": "?"}]}}, "bad_ruler_role"), ({"video_path": "v", "depth_audit": {"readings": {"x": {"frame": 1}}}}, "bad_reading"),
    ]
    rows = texts(spark, [v for v, _ in values])
    parsed = records.parse_records(rows, ["k"])
    assert {r.k: r.reason for r in parsed.select("k", "reason").collect()} == {k: why for k, (_, why) in enumerate(values)}
    assert records.quarantined(parsed, rows, ["k"]).count() + records.accepted(parsed).count() == len(values)


def test_versions_end_as_the_newest(spark):
    values = [
        {"video_path": "v", "track": {"clip_id": "c", "points": [{"frame": 4, "x": 1, "y": 2, "visible": False}]}},
        {"video_path": "v", "schema": "lab.v5", "calibration": {"mode": "planar", "frame": {"y_up": False}, "rulers": [{}], "camera": {"fx": 9}, "plane": {"corners": [{"x": 1}]}}, "depth_audit": {"threshold_m": 0, "readings": {"5": {"z_geom": 2}, "6": {}}}},
        {"video_path": "v", "schema": "odd", "assistant": {"confirmed_type": "pendulum", "teaching_level": "?", "pendulum_length_m": 0.5}, "display": {"track_mode": "fast"}},
    ]
    parsed = records.parse_records(texts(spark, values), ["k"])
    first, second, third = parsed.orderBy("k").collect()
    assert (first.version, second.version, third.version) == (1, 5, None)
    assert first.active_track_id == "track-1" and first.tracks[0].result.points[0].visible is False and first.tracks[0].color == records.FIRST_COLOR
    cal = second.calibration
    assert (cal.mode, cal.frame.y_up, cal.pixel_sigma, cal.rulers[0].length_m, cal.rulers[0].b.y, cal.camera.k3, cal.plane.width_m) == ("planar", False, 0.5, 1.0, 0.0, 0.0, 1.0)
    assert list(second.depth_audit.readings) == ["5"] and second.depth_audit.threshold_m == 0.03
    assert (third.assistant.confirmed_type, third.assistant.teaching_level, third.assistant.pendulum_length_m, third.track_mode) == ("pendulum", "high", 0.5, "fast")
    assert [(r.k, r.frame, r.confidence) for r in records.record_points(parsed, ["k"]).collect()] == [(0, 4, 1.0)]
    assert [(r.k, r.at, r.z_geom, r.flag) for r in records.record_readings(parsed, ["k"]).collect()] == [(1, 5, 2.0, "skipped")]
    found = {r.k: (r.cal.mode, r.cal.warning) for r in records.record_calibrations(parsed, ["k"]).collect()}
    assert found == {0: ("none", ""), 1: ("none", "need_four_corners"), 2: ("none", "")}


def test_pose_records(spark):
    key = {"name": "nose", "x": 1, "y": 2}
    values = [
        {"clip_id": "c", "frames": [{"frame": 0, "keypoints": [key, {**key, "visible": False}]}, {"frame": 1, "person_id": 3, "keypoints": []}]}, {"clip_id": "d", "frames": []}, "nope{",
        {"frames": []}, {"clip_id": "e", "frames": [{"frame": 0, "keypoints": [{"name": "nose", "x": 1}]}]}, {"clip_id": "f", "failure_reason": "?"},
    ]
    rows = records.parse_poses(texts(spark, values), ["k"]).orderBy("k", "frame").collect()
    assert [(r.k, r.reason, r.frame, r.person_id) for r in rows] == [(0, None, 0, 0), (0, None, 1, 3), (1, None, None, None), (2, "not_json", None, None), (3, "no_clip_id", None, None), (4, "bad_frame", None, None), (5, "bad_failure_reason", None, None)]
    assert [k.visible for k in rows[0].keypoints] == [True, False]


def test_each_clip_is_indexed_by_one_way(spark):
    packets = spark.createDataFrame([("good", 30, 5), ("good", 10, 5), ("good", 20, 0), ("twice", 10, 5), ("twice", 10, 5), ("none", None, 5)], "clip string, pts long, size int")
    frames = spark.createDataFrame([(c, k, p) for c in ("good", "twice", "none", "unlisted") for k, p in enumerate([100, None, 90, 400])], "clip string, frame int, pts long")
    got = {}
    for r in video.index_clips(packets, frames, ["clip"], 0.001, 40).orderBy("frame").collect():
        got.setdefault(r.clip, []).append((r.pts, r.pts_ms))
    assert got.pop("good") == [(10, 0), (30, 20)]
    assert got == {c: [(100, 0), (140, 40), (180, 80), (400, 300)] for c in ("twice", "none", "unlisted")}


def test_entries_without_results_stay_in_the_report(spark):
    manifest = spark.createDataFrame([("a", "track", 0), ("b", "pose", 1), ("c", "calibration", 2), ("d", "track", 3)], "clip_id string, task string, entry_no int").withColumns({"difficulty": F.lit("normal"), "split": F.lit("dev"), "hidden": F.lit(False)})
    truth = spark.createDataFrame([("a", f, f * 2.0, 1.0, True) for f in range(10)], "clip_id string, frame int, x double, y double, visible boolean")
    runs = spark.createDataFrame([("a", "m", 0.1, None), ("b", "m", 0.1, None), ("d", "m", 0.1, "crashed")], "clip_id string, model string, elapsed_s double, error string")
    got = {r.clip_id: (r.passed, r.error) for r in reports.evaluate(manifest, truth, truth, runs).collect()}
    assert got == {"a": (True, None), "b": (False, "no results for task pose"), "c": (False, "no results for task calibration"), "d": (False, "crashed")}
    assert reports.pass_rate(reports.evaluate(manifest, truth, truth, runs)).first().pass_rate == pytest.approx(0.25)


def test_first_of_repeated_keys_counts(spark):
    twice = '{"video_path":"v","video_path":"w","depth_audit":{"readings":{"3":{"z_geom":1.5},"7":{},"7":{"z_model":2},"3":{"z_geom":9}}}}'
    rows = spark.createDataFrame([(1, twice), (2, '{"video_path":"v","a":1,"a":NaN}'), (3, '{"video_path":"v","a":'), (4, None)], "k int, text string")
    found = {r.k: r for r in records.parse_records(rows, ["k"]).collect()}
    assert {k: r.reason for k, r in found.items()} == {1: None, 2: "not_json", 3: "not_json", 4: "not_json"}
    assert found[1].video_path == "v" and {k: r.z_geom for k, r in found[1].depth_audit.readings.items()} == {"3": 1.5}


def test_rows_of_accepted_records_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"video_path":"v","track":{"clip_id":"c","points":[{"frame":0,"x":1,"y":2}]}}'), (2, "[")], "k int, text string")
    parsed = records.parse_records(rows, ["k"])
    for find, n in ((records.record_points, 1), (records.record_calibrations, 1), (records.record_readings, 0)):
        found = find(parsed, ["k"])
        assert "variant_get" not in found._jdf.queryExecution().toString() and found.count() == n
