"""Writers and stream functions."""

import glob

from motionloom.operators import depth, kinematics
from motionloom.operators import reports as reports_op
from motionloom.plans import views as V
from motionloom.sinks import documents
from motionloom.sinks.track_csv import write_track_csv
from motionloom.streaming.points import mapped_stream, running_coverage

KEY = ["clip_id"]


def test_csv_has_unit_headers_and_empty_cells(spark, sf, tmp_path):
    write_track_csv(kinematics.series(V.event_points(spark, sf), KEY), str(tmp_path / "csv"))
    lines = [line for f in sorted(glob.glob(str(tmp_path / "csv/unit=px/*.csv"))) for line in open(f).read().splitlines()]
    assert lines[0] == "clip_id,frame,time_s,x_px,y_px,vx_px_s,vy_px_s,v_px_s,visible,confidence,sigma_x,sigma_y,quality,off_plane_m,source"
    assert lines[1].startswith("0,0,0.000000,,,,,,0,")


def test_running_coverage_of_a_stream(spark, sf, tmp_path):
    points = V.event_points(spark, sf)
    points.write.parquet(str(tmp_path / "points"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "points"))
    query = running_coverage(stream, KEY).writeStream.outputMode("complete").format("memory").queryName("coverage").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    want = {r.clip_id: r.coverage for r in kinematics.track_summary(points, KEY).collect()}
    assert {r.clip_id: r.coverage for r in spark.table("coverage").collect()} == want


def test_track_json_keeps_every_point_in_few_folders(spark, sf, tmp_path):
    points = V.event_points(spark, sf).select("clip_id", "frame", "x")
    documents.write_track_json(points, str(tmp_path / "json"), buckets=3)
    assert len(glob.glob(str(tmp_path / "json/bucket=*"))) <= 3
    assert spark.read.json(str(tmp_path / "json")).count() == points.count()


def test_reports_and_projects_as_documents(spark, sf, tmp_path):
    reports = V.doc_reports(spark, sf)
    documents.write_reports(reports, str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports")).count() == reports.count()
    project = documents.project_documents(spark.createDataFrame([("a.mp4", 3)], "video_path string, frame int")).first()
    assert project.document == '{"schema":"5","video_path":"a.mp4","frame":3}'
    documents.write_markdown(spark.createDataFrame([("# A",), ("# B",)], "markdown string"), str(tmp_path / "md"))
    assert sum(open(f).read().count("# ") for f in glob.glob(str(tmp_path / "md/*.txt"))) == 2
    items = reports_op.compare_to_baseline(reports, reports)
    assert reports_op.regression_summary(items).first().blocking is False


def test_stream_of_mapped_points(spark, sf, tmp_path):
    points = V.event_points(spark, sf).select("clip_id", "frame", "time_s", "x", "y")
    points.write.parquet(str(tmp_path / "points"))
    solved = V.calibrations(spark, sf)
    stream = mapped_stream(spark.readStream.schema(points.schema).parquet(str(tmp_path / "points")), solved, KEY)
    query = stream.writeStream.format("memory").queryName("mapped").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("mapped").count() == points.count()


def test_audit_summary_counts_frames_off_the_plane(spark):
    readings = spark.createDataFrame([(1, "ok", 0.1), (1, "off_plane", 0.1), (2, "ok", 0.1)], "clip_id int, flag string, limit_m double")
    got = {r.clip_id: (r.n_readings, r.n_off_plane, r.outcome) for r in depth.audit_summary(readings, KEY).collect()}
    assert got == {1: (2, 1, "may_leave_plane"), 2: (1, 0, "no_off_plane_found")}
