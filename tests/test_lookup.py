"""Lookups at asked frames, usage records and shared contexts on small known cases."""

from pyspark.sql import functions as F

from motionloom.functions import text
from motionloom.operators import lookup
from motionloom.plans import catalog

KEY = ["clip_id"]


def test_positions_are_interpolated_and_clamped(spark):
    points = spark.createDataFrame([(1, 10, 0.0, 5.0), (1, 20, 10.0, 25.0), (2, 3, 7.0, 8.0)], "clip_id long, frame int, x double, y double")
    cursors = spark.createDataFrame([(1, 1, 4), (1, 2, 10), (1, 3, 15), (1, 4, 20), (1, 5, 99), (2, 6, 3), (3, 7, 0)], "clip_id long, cursor_id long, asked int")
    got = {r.cursor_id: (r.x, r.y) for r in lookup.position_at(points, cursors, KEY).collect()}
    assert got == {1: (0.0, 5.0), 2: (0.0, 5.0), 3: (5.0, 15.0), 4: (10.0, 25.0), 5: (10.0, 25.0), 6: (7.0, 8.0), 7: (None, None)}


def test_lost_anchors_drop_and_frames_are_clamped(spark):
    anchors = spark.createDataFrame([(1, 0, 0, 1.0, 2.0), (1, 0, 1, None, 2.0), (1, 1, 0, None, None), (1, 2, 1, 3.0, 4.0)], "clip_id long, frame int, k int, x double, y double")
    cursors = spark.createDataFrame([(1, 1, -5), (1, 2, 1), (1, 3, 50), (2, 4, 0)], "clip_id long, cursor_id long, asked int")
    got = {r.cursor_id: [a.x for a in r.anchors] for r in lookup.anchors_at(anchors, cursors, KEY).collect()}
    assert got == {1: [1.0], 2: [], 3: [3.0], 4: []}


def test_usage_counts_zero_where_it_is_missing(spark):
    answers = ['{"usage": {"prompt_tokens": 3, "total_tokens": 9}}', '{"usage": null}', "{}", "broken", None, '{"usage": {"completion_tokens": null}}']
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", text.usage(F.col("a")).alias("u")).orderBy("i").collect()
    assert [tuple(r.u) for r in rows] == [(3, 0, 9)] + [(0, 0, 0)] * 5


def test_paths_count_among_own_keys_only(spark):
    contexts = ['{"path": 1}', '{"video_path": "x"}', '{"a": {"path": 1}}', '{"note": "sk-1"}', "{}", None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(contexts)], "i int, c string").select("i", text.leaks_context(F.col("c")).alias("leak")).orderBy("i").collect()
    assert [r.leak for r in rows] == ["path", "path", None, "sk-", None, None]


def test_report_messages_hold_the_context_as_it_is(spark):
    rows = catalog.report_messages(spark.createDataFrame([(1, '{"a": 1}'), (2, None)], "clip_id long, context string"), KEY, "S", "I").orderBy("clip_id").collect()
    tail = '{"teaching_level":"high","task":"experiment_report_sections","json":true,"context":'
    assert [[tuple(m) for m in r.messages] for r in rows] == [[("system", "S\nI"), ("user", tail + c + "}")] for c in ('{"a": 1}', "null")]
