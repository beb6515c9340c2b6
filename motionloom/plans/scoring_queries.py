"""Queries on evaluation metrics, clip reports, regression and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CORE_METRICS, POSE_BONES, POSE_KEYPOINTS
from ..operators import metrics as M
from ..operators import reports as R
from . import views as V
from .registry import SQL, r, register
from .sql_views import with_ctes

KEY = V.KEY


def judge_sql(source: str, specs: list[tuple[str, str, str, bool]], key: str = "clip_id") -> str:
    """Long metric rows from a one-row-per-clip source."""
    return " UNION ALL ".join(
        f"""SELECT {key}, '{name}' AS name, round(CAST({value} AS DOUBLE), 6) + 0.0 AS value, CAST({limit} AS DOUBLE) AS threshold, {str(up).upper()} AS higher_is_better,
        CASE WHEN ({value}) IS NULL OR ({limit}) IS NULL THEN NULL ELSE ({value}) {'>=' if up else '<='} ({limit}) END AS passed FROM {source}"""
        for name, value, limit, up in specs
    )


def _hard(normal: str, hard: str) -> str:
    return f"CASE WHEN difficulty = 'hard' THEN {hard} ELSE {normal} END"


def _out(metrics):
    return metrics.select("clip_id", "name", r("value").alias("value"), "threshold", "higher_is_better", "passed")


MATCH = ("m", """SELECT g.clip_id, g.frame, g.x AS gx, g.y AS gy, p.x AS qx, p.y AS qy, g.visible AS gv, coalesce(p.visible, FALSE) AS qv, g.visible AND coalesce(p.visible, FALSE) AS hit,
  CASE WHEN g.visible AND coalesce(p.visible, FALSE) THEN sqrt((p.x - g.x) ** 2 + (p.y - g.y) ** 2) END AS err FROM pt g
  LEFT JOIN (SELECT clip_id, frame, x + CASE WHEN position = 0 THEN 25.0e0 ELSE 0e0 END AS x, y, visible FROM (SELECT *, unnest(CASE WHEN event_id % 19 = 0 THEN [0, 1] ELSE [1] END) AS position FROM pred)
    QUALIFY row_number() OVER (PARTITION BY clip_id, frame ORDER BY position DESC) = 1) p ON p.clip_id = g.clip_id AND p.frame = g.frame""")
GAPS = [
    ("isl", "SELECT *, coalesce(sum(CAST(hit AS INT)) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS pos FROM m"),
    ("gaps", """SELECT clip_id, max(CASE WHEN hit THEN pos END) - min(CASE WHEN gv AND NOT hit THEN pos END) AS gap FROM isl GROUP BY clip_id, island
      HAVING max(CASE WHEN hit THEN pos END) IS NOT NULL AND min(CASE WHEN gv AND NOT hit THEN pos END) IS NOT NULL"""),
]
TRACK_WIDE = ("wide", """SELECT f.*, CASE WHEN f.clip_id % 2 = 1 THEN 'hard' ELSE 'normal' END AS difficulty, t.drift, (SELECT median(gap) FROM gaps g WHERE g.clip_id = f.clip_id) AS rec,
  (SELECT count(*) FROM m a JOIN m b ON b.clip_id = a.clip_id AND b.frame = a.frame - 1 WHERE a.clip_id = f.clip_id AND a.hit AND b.hit AND sqrt((a.qx-b.qx)**2 + (a.qy-b.qy)**2) > 40 AND sqrt((a.gx-b.gx)**2 + (a.gy-b.gy)**2) < 15) AS swaps
  FROM (SELECT clip_id, median(err) AS med, count(err) AS hits, count(*) FILTER (err <= 10.0) AS near, count(*) FILTER (gv) AS seen FROM m GROUP BY clip_id) f
  LEFT JOIN (SELECT clip_id, avg(err) AS drift FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame DESC) AS rk, count(*) OVER (PARTITION BY clip_id) AS n FROM m WHERE hit) WHERE rk <= greatest(1, n // 5) GROUP BY clip_id) t USING (clip_id)""")
TRACK_SPECS = [
    ("center_median_px", "med", _hard("3.0", "8.0"), False),
    ("success_at_10px", "CASE WHEN hits > 0 THEN near / hits ELSE 0 END", _hard("0.95", "0.80"), True),
    ("trajectory_completeness", "CASE WHEN seen > 0 THEN hits / seen ELSE 0 END", _hard("0.98", "0.90"), True),
    ("drift_tail_mean_px", "drift", "CAST(NULL AS DOUBLE)", False),
    ("occlusion_recovery_frames", "coalesce(rec, 0)", _hard("NULL", "10.0"), False),
    ("identity_swaps", "swaps", "1.0", False),
]


@register("track_metrics", with_ctes(judge_sql("wide", TRACK_SPECS), "pt", "pred", MATCH, *GAPS, TRACK_WIDE))
def track_metrics(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    return _out(M.track_metrics(points, V.repeated_predictions(points), V.clip_difficulty(points), KEY))


@register("occlusion_gaps", with_ctes("SELECT clip_id, CAST(gap AS DOUBLE) AS gap, count(*) AS n FROM gaps GROUP BY clip_id, gap", "pt", "pred", MATCH, *GAPS))
def occlusion_gaps(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    gaps = M.recovery_gaps(M.match_frames(points, V.repeated_predictions(points), KEY), KEY)
    return gaps.groupBy("clip_id", "gap").agg(F.count(F.lit(1)).alias("n"))


@register(
    "match_frames",
    with_ctes("SELECT clip_id, frame, hit, gv AND NOT hit AS miss, round(err, 6) AS err FROM m", "pt", "pred", MATCH),
)
def match_frames(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    return M.match_frames(points, V.repeated_predictions(points), KEY).select("clip_id", "frame", "hit", "miss", r("err").alias("err"))


_names = "[" + ", ".join(f"'{n}'" for n in POSE_KEYPOINTS) + "]"
POSE = [
    ("gk", f"""SELECT CAST(label AS BIGINT) AS clip_id, CAST(vec_id AS INT) AS frame, i, ({_names})[i + 1] AS name, 20.0e0 * i + CAST(embedding[2 * i + 1] AS DOUBLE) AS x, 7.0e0 * (i % 4) + CAST(embedding[2 * i + 2] AS DOUBLE) AS y,
      (vec_id + i) % 9 <> 0 AND vec_id % 7 <> 0 AS v FROM embeddings, range(17) g(i)"""),
    ("qk", """SELECT clip_id, frame, i, name, x + ((frame * 31 + i) % 7 - 3) * 0.5 + CASE WHEN (frame + i) % 17 = 0 THEN 9.0 ELSE 0.0 END AS x,
      y - (((frame * 31 + i) % 7 - 3) * 0.5 + CASE WHEN (frame + i) % 17 = 0 THEN 9.0 ELSE 0.0 END) AS y, (frame * 3 + i) % 11 <> 0 AS v FROM gk WHERE frame % 13 <> 0"""),
    ("pk", """SELECT g.clip_id, count(*) AS total, count(*) FILTER (q.v AND sqrt((q.x - g.x)**2 + (q.y - g.y)**2) <= 0.05 * t.s) AS hits FROM gk g LEFT JOIN qk q USING (clip_id, frame, i)
      JOIN (SELECT a.clip_id, a.frame, greatest(1, sqrt((a.x - b.x)**2 + (a.y - b.y)**2)) AS s FROM gk a JOIN gk b USING (clip_id, frame) WHERE a.i = 5 AND b.i = 11) t ON t.clip_id = g.clip_id AND t.frame = g.frame WHERE g.v GROUP BY g.clip_id"""),
    ("fr", """SELECT clip_id, frame, lag(frame) OVER (PARTITION BY clip_id ORDER BY frame) AS pf, gv, coalesce(qv, FALSE) AS qv, row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS pos
      FROM (SELECT clip_id, frame, bool_or(v) AS gv FROM gk GROUP BY 1, 2) LEFT JOIN (SELECT clip_id, frame, bool_or(v) AS qv FROM qk GROUP BY 1, 2) USING (clip_id, frame)"""),
    ("still", """SELECT f.clip_id, f.frame, f.pf FROM fr f JOIN gk a ON a.clip_id = f.clip_id AND a.frame = f.pf JOIN gk b ON b.clip_id = f.clip_id AND b.frame = f.frame AND b.i = a.i WHERE a.v AND b.v
      GROUP BY 1, 2, 3 HAVING avg(sqrt((a.x - b.x)**2 + (a.y - b.y)**2)) <= 1.0"""),
    ("jit", """SELECT s.clip_id, median(sqrt((a.x - b.x)**2 + (a.y - b.y)**2)) AS j FROM still s JOIN qk a ON a.clip_id = s.clip_id AND a.frame = s.pf JOIN qk b ON b.clip_id = s.clip_id AND b.frame = s.frame AND b.i = a.i
      WHERE a.v AND b.v GROUP BY 1"""),
    ("bone", "SELECT clip_id, avg(cv) AS cv FROM (" + " UNION ALL ".join(
        f"""SELECT a.clip_id, stddev_pop(sqrt((a.x - b.x)**2 + (a.y - b.y)**2)) / avg(sqrt((a.x - b.x)**2 + (a.y - b.y)**2)) AS cv FROM qk a JOIN qk b USING (clip_id, frame)
        WHERE a.i = {POSE_KEYPOINTS.index(p)} AND b.i = {POSE_KEYPOINTS.index(q)} AND a.v AND b.v GROUP BY 1 HAVING count(*) >= 3 AND avg(sqrt((a.x - b.x)**2 + (a.y - b.y)**2)) > 1e-6""" for p, q in POSE_BONES) + ") GROUP BY clip_id"),
    ("ons", "SELECT *, sum(CASE WHEN lgv AND NOT gv THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame) AS o FROM (SELECT *, lag(gv) OVER (PARTITION BY clip_id ORDER BY frame) AS lgv FROM fr)"),
    ("rec", "SELECT clip_id, median(g) AS g FROM (SELECT clip_id, min(CASE WHEN gv AND qv THEN pos END) - min(pos) AS g FROM ons WHERE o > 0 GROUP BY clip_id, o) WHERE g IS NOT NULL GROUP BY clip_id"),
    ("wide", """SELECT c.clip_id, CASE WHEN c.clip_id % 2 = 1 THEN 'hard' ELSE 'normal' END AS difficulty, total, hits, j, cv, g FROM (SELECT DISTINCT clip_id FROM gk) c LEFT JOIN pk USING (clip_id)
      LEFT JOIN jit USING (clip_id) LEFT JOIN bone USING (clip_id) LEFT JOIN rec USING (clip_id)"""),
]
POSE_SPECS = [
    ("pck_at_0_05", "coalesce(hits / nullif(total, 0), 0)", _hard("0.95", "0.85"), True),
    ("keypoint_miss_rate", "coalesce((total - hits) / nullif(total, 0), 0)", "CAST(NULL AS DOUBLE)", False),
    ("static_jitter_px", "j", "2.0", False),
    ("bone_length_cv", "cv", "0.03", False),
    ("occlusion_recovery_frames", "coalesce(g, 0)", _hard("NULL", "10.0"), False),
]


@register("pose_metrics", with_ctes(judge_sql("wide", POSE_SPECS), *POSE))
def pose_metrics(spark, sf_dir):
    gt, pred = V.pose_frames(spark, sf_dir), V.pose_frames(spark, sf_dir, predicted=True)
    return _out(M.pose_metrics(gt, pred, V.clip_difficulty(gt), KEY))


CAL = ("cal", """SELECT c_custkey AS clip_id, CASE WHEN c_custkey % 2 = 1 THEN 'hard' ELSE 'normal' END AS difficulty, (160 + c_custkey % 10) / 0.8e0 AS gppm, c_custkey % 360 AS gang, c_custkey % 11 <> 0 AS ok,
  CASE WHEN c_custkey % 13 <> 0 THEN (200.0e0 + c_custkey % 10) * (1.0e0 + (c_custkey % 7 - 3) * 0.004e0) END AS ppm, CASE WHEN c_custkey % 17 <> 0 THEN 40.0e0 + (c_custkey % 9) * 0.5e0 END AS ox,
  CASE WHEN c_custkey % 19 <> 0 THEN c_custkey % 360 + (c_custkey % 5 - 2) * 0.75e0 + CASE WHEN c_custkey % 3 = 0 THEN 360 ELSE 0 END END AS ang,
  c_custkey % 22 = 0 AS rej, c_custkey % 33 = 0 OR c_custkey % 44 = 0 AS why FROM customer""")


@register(
    "calibration_metrics",
    with_ctes(
        judge_sql("(SELECT * FROM cal WHERE NOT ok)", [("rejection_when_no_ruler", "CASE WHEN rej OR why THEN 1 ELSE 0 END", "1.0", True)]) + " UNION ALL "
        + judge_sql("(SELECT * FROM cal WHERE ok AND (rej OR ppm IS NULL))", [("scale_relative_error", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", True), ("false_reject", "1.0", "0.0", False)]) + " UNION ALL "
        + judge_sql("(SELECT * FROM cal WHERE ok AND NOT rej AND ppm IS NOT NULL)", [
            ("scale_relative_error", "abs(ppm - gppm) / gppm", _hard("0.01", "0.03"), False),
            ("axis_angle_error_deg", "abs(((ang - gang + 180 + 720) % 360) - 180)", _hard("1.0", "3.0"), False),
            ("origin_error_px", "sqrt((ox - 40)**2 + 1)", _hard("3.0", "8.0"), False)]),
        CAL,
    ),
)
def calibration_metrics(spark, sf_dir):
    return _out(M.calibration_metrics(*V.calibration_truth(spark, sf_dir), KEY))


PHYS = ("ph", """SELECT c_custkey AS clip_id, CASE WHEN c_custkey % 3 = 0 THEN 1.2e0 END AS gt_t, CASE WHEN c_custkey % 2 = 0 THEN 9.81e0 END AS gt_g, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 4 END AS gt_v,
  CASE WHEN c_custkey % 5 = 0 THEN 1.2e0 END AS gt_a, CASE WHEN c_custkey % 7 <> 0 THEN 1.2e0 + (c_custkey % 9 - 4) * 0.01e0 END AS t, CASE WHEN c_custkey % 4 <> 1 THEN 9.81e0 + (c_custkey % 13 - 6) * 0.11e0 END AS g,
  c_custkey % 4 + (c_custkey % 11 - 5) * 0.02e0 AS v, 1.25e0 AS a, CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey % 12) * 0.006e0 END AS e FROM customer""")


def _rel(p: str, g: str) -> str:
    return f"CASE WHEN abs({g}) >= 1e-9 THEN abs({p} - {g}) / abs({g}) END"


PHYS_SPECS = [
    ("period_relative_error", _rel("t", "gt_t"), "0.02", False), ("gravity_relative_error", _rel("g", "gt_g"), "0.05", False),
    ("velocity_relative_error", _rel("v", "gt_v"), "0.05", False), ("acceleration_relative_error", _rel("a", "gt_a"), "0.05", False),
]


@register(
    "physics_metrics",
    with_ctes(judge_sql("ph", PHYS_SPECS) + " UNION ALL " + judge_sql("(SELECT * FROM ph WHERE e IS NOT NULL)", [("trajectory_fit_error", "e", "0.05", False)]), PHYS),
)
def physics_metrics(spark, sf_dir):
    return _out(M.physics_metrics(*V.physics_truth(spark, sf_dir), KEY))


@register(
    "clip_passed",
    with_ctes(
        "SELECT clip_id, coalesce(bool_and(passed), FALSE) AS passed FROM (" + judge_sql("wide", TRACK_SPECS) + ") GROUP BY clip_id",
        "pt", "pred", MATCH, *GAPS, TRACK_WIDE,
    ),
)
def clip_passed(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    return M.clip_passed(M.track_metrics(points, V.repeated_predictions(points), V.clip_difficulty(points), KEY), KEY)


#: Added to the clip ids of each task, so that no two share one.
TASK_IDS = {"track": 0, "pose": 100_000_000_000, "calibration": 200_000_000_000, "physics": 300_000_000_000}
CLIPS = "SELECT DISTINCT user_id AS clip_id FROM events"


def _judged(name: str, task: str, where: str = "TRUE") -> str:
    return f"SELECT clip_id + {TASK_IDS[task]} AS clip_id, passed FROM ({SQL[name]}) WHERE {where}"


@register(
    "run_eval",
    f"""WITH e AS (SELECT clip_id, 'track' AS task FROM ({CLIPS}) UNION ALL SELECT DISTINCT label + {TASK_IDS["pose"]}, 'pose' FROM embeddings UNION ALL SELECT c_custkey + {TASK_IDS["calibration"]}, 'calibration' FROM customer
        UNION ALL SELECT clip_id + {TASK_IDS["physics"]}, 'physics' FROM ({CLIPS}) UNION ALL SELECT n_nationkey + 400000000000, 'depth' FROM nation),
    j AS ({_judged("track_metrics", "track")} UNION ALL {_judged("pose_metrics", "pose")} UNION ALL {_judged("calibration_metrics", "calibration")}
        UNION ALL {_judged("physics_metrics", "physics", f"clip_id IN ({CLIPS})")} UNION ALL {_judged("track_metrics", "physics")}),
    m AS (SELECT clip_id, coalesce(bool_and(passed), FALSE) AS ok, count(*) AS n, count(*) FILTER (passed = FALSE) AS bad FROM j GROUP BY clip_id),
    t AS (SELECT *, CASE WHEN clip_id % 23 = 0 THEN 'timeout' WHEN task = 'depth' THEN 'no results for task depth' END AS error FROM e)
    SELECT clip_id, task, CASE WHEN clip_id % 2 = 1 THEN 'hard' ELSE 'normal' END AS difficulty, CASE clip_id % 5 WHEN 0 THEN 'holdout' ELSE 'dev' END AS split, 'shift' AS model, error IS NULL AND coalesce(ok, FALSE) AS passed,
      CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_metrics, CASE WHEN error IS NULL THEN coalesce(bad, 0) ELSE 0 END AS n_failed, error
    FROM t LEFT JOIN m USING (clip_id) WHERE clip_id % 5 <> 0 OR clip_id % 10 = 0""",
)
def run_eval(spark, sf_dir):
    """All entries that are not hidden, of four tasks and one that nothing was run for, as the evaluation of a release runs them."""
    points = V.event_points(spark, sf_dir)
    guesses = V.repeated_predictions(points)
    clip = F.col("clip_id")
    moved = lambda rows, task: rows.withColumn("clip_id", clip.cast("long") + TASK_IDS[task])
    both = lambda rows: rows.unionByName(moved(rows, "physics"))
    poses = [moved(V.pose_frames(spark, sf_dir, predicted=guess), "pose") for guess in (False, True)]
    calibrations = [moved(rows, "calibration") for rows in V.calibration_truth(spark, sf_dir)]
    physics = [moved(rows, "physics") for rows in V.physics_truth(spark, sf_dir)]
    other = V.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 400_000_000_000).cast("long").alias("clip_id"), F.lit("depth").alias("task"))
    tracks = points.select("clip_id").distinct()
    entries = other
    for rows, task in ((tracks, "track"), (poses[0], "pose"), (calibrations[0], "calibration"), (moved(tracks, "physics"), "physics")):
        entries = entries.unionByName(rows.select(clip.cast("long").alias("clip_id"), F.lit(task).alias("task")).distinct())
    manifest = entries.select(
        "clip_id", "task", F.when(clip % 2 == 1, "hard").otherwise("normal").alias("difficulty"), F.when(clip % 5 == 0, "holdout").otherwise("dev").alias("split"),
        ((clip % 5 == 0) & (clip % 10 != 0)).alias("hidden"), clip.alias("entry_no"),
    )
    runs = manifest.select("clip_id", F.lit("shift").alias("model"), F.lit(0.5).alias("elapsed_s"), F.when(clip % 23 == 0, "timeout").alias("error"))
    reports = R.evaluate(manifest, both(points), both(guesses), runs, split="all", poses=tuple(poses), calibrations=tuple(calibrations), physics=tuple(physics))
    metrics = F.coalesce("metrics", F.array().cast(reports.schema["metrics"].dataType))
    failed = F.filter(metrics, lambda m: m["passed"] == F.lit(False))
    return reports.select("clip_id", "task", "difficulty", "split", "model", "passed", F.size(metrics).cast("long").alias("n_metrics"), F.size(failed).cast("long").alias("n_failed"), "error")


def _doc_sql(baseline: bool) -> str:
    """Long form of views.doc_reports: clip_id, error, elapsed, metric name, value, limit, ok."""
    sh = "(doc_id % 7 - 3) * 0.05e0" if baseline else "0e0"
    where = "WHERE doc_id % 10 <> 9" if baseline else ""
    err = "doc_id % 41 = 0" if baseline else "doc_id % 37 = 0"
    el = "0.2e0 + (doc_id % 11) * 0.1e0" + ("" if baseline else " + (doc_id % 5) * 0.06e0")
    return f"""SELECT d.doc_id AS clip_id, {err} AS err, {el} AS elapsed, m.name, m.up, m.lim,
      CASE m.name WHEN 'center_median_px' THEN (n_chars % 50) / 10e0 + {sh} WHEN 'success_at_10px' THEN least(1e0, (n_chars % 20) / 19e0 + {sh})
        WHEN 'drift_tail_mean_px' THEN CASE WHEN doc_id % 4 <> 0 THEN (n_chars % 30) / 7e0 END ELSE (n_chars % 3) * 1e0 END AS value
      FROM documents d, (VALUES ('center_median_px', FALSE, 3e0), ('success_at_10px', TRUE, 0.95e0), ('drift_tail_mean_px', FALSE, NULL), ('identity_swaps', FALSE, 1e0)) m(name, up, lim) {where}"""


DOCS = [
    ("cur", "SELECT *, CASE WHEN value IS NOT NULL AND lim IS NOT NULL THEN CASE WHEN up THEN value >= lim ELSE value <= lim END END AS ok FROM (" + _doc_sql(False) + ")"),
    ("base", "SELECT *, CASE WHEN value IS NOT NULL AND lim IS NOT NULL THEN CASE WHEN up THEN value >= lim ELSE value <= lim END END AS ok FROM (" + _doc_sql(True) + ")"),
    ("cc", "SELECT clip_id, any_value(elapsed) AS elapsed, any_value(err) AS err, NOT any_value(err) AND coalesce(bool_and(ok), TRUE) AS passed FROM cur GROUP BY clip_id"),
    ("bc", "SELECT clip_id, any_value(elapsed) AS elapsed, any_value(err) AS err, NOT any_value(err) AND coalesce(bool_and(ok), TRUE) AS passed FROM base GROUP BY clip_id"),
]


@register(
    "pass_rate",
    with_ctes("SELECT count(*) AS n_clips, CAST(coalesce(sum(CAST(passed AS INT)), 0) AS BIGINT) AS n_passed, round(coalesce(avg(CAST(passed AS INT)), 0), 6) AS pass_rate FROM cc", *DOCS),
)
def pass_rate(spark, sf_dir):
    return R.pass_rate(V.doc_reports(spark, sf_dir)).withColumn("pass_rate", r("pass_rate"))


@register(
    "failure_modes",
    with_ctes(
        """SELECT mode, count(*) AS n FROM (SELECT 'crash' AS mode FROM cc WHERE err UNION ALL SELECT name FROM cur WHERE NOT err AND ok = FALSE
        UNION ALL SELECT 'unknown_fail' FROM cc c WHERE NOT passed AND NOT err AND NOT EXISTS (SELECT 1 FROM cur m WHERE m.clip_id = c.clip_id AND m.ok = FALSE)) GROUP BY mode""",
        *DOCS,
    ),
)
def failure_modes(spark, sf_dir):
    return R.failure_modes(V.doc_reports(spark, sf_dir))


_core = ", ".join(f"'{n}'" for n in CORE_METRICS)


@register(
    "regression_items",
    with_ctes(
        f"""SELECT clip_id, NULL AS metric, 'new_failure' AS reason, CAST(NULL AS DOUBLE) AS old, CAST(NULL AS DOUBLE) AS new FROM cc JOIN bc USING (clip_id) WHERE bc.passed AND NOT cc.passed
        UNION ALL SELECT m.clip_id, m.name, CASE WHEN m.up THEN 'metric_drop' ELSE 'metric_worsen' END, round(o.value, 6), round(m.value, 6) FROM cur m JOIN base o USING (clip_id, name) JOIN cc USING (clip_id) JOIN bc USING (clip_id)
          WHERE NOT (bc.passed AND NOT cc.passed) AND NOT m.err AND NOT o.err AND m.name IN ({_core}) AND NOT coalesce(m.ok AND o.ok, FALSE)
          AND CASE WHEN m.up THEN o.value - m.value ELSE m.value - o.value END / greatest(abs(o.value), 1e-3) > 0.02
        UNION ALL SELECT clip_id, NULL, 'perf_regression', round(bc.elapsed, 6), round(cc.elapsed, 6) FROM cc JOIN bc USING (clip_id) WHERE NOT (bc.passed AND NOT cc.passed) AND bc.elapsed >= 0.5 AND cc.elapsed > bc.elapsed * 1.1""",
        *DOCS,
    ),
)
def regression_items(spark, sf_dir):
    items = R.compare_to_baseline(V.doc_reports(spark, sf_dir), V.doc_reports(spark, sf_dir, baseline=True))
    return items.withColumns({"old": r("old"), "new": r("new")})


ANN = ("ann", """SELECT conv_id AS clip_id, ['track', 'pose', 'calibration', 'physics'][conv_id % 4 + 1] AS task, CASE WHEN conv_id % 9 = 0 THEN 0 ELSE 4 END AS frame_count, CASE WHEN conv_id % 11 = 0 THEN 0 ELSE 320 END AS width,
  list(turn) FILTER (conv_id % 5 <> 0) AS track, list(turn) FILTER (conv_id % 3 = 0) AS pose, conv_id % 7 <> 0 AS cal, conv_id % 6 <> 0 AS phys FROM conversations GROUP BY conv_id""")


@register(
    "validate_annotations",
    with_ctes(
        """SELECT clip_id, 'frame_count must be positive' AS error FROM ann WHERE frame_count <= 0 UNION ALL SELECT clip_id, 'width/height must be positive' FROM ann WHERE width <= 0
        UNION ALL SELECT clip_id, 'track annotation missing' FROM ann WHERE task = 'track' AND track IS NULL UNION ALL SELECT clip_id, 'pose annotation missing' FROM ann WHERE task = 'pose' AND pose IS NULL
        UNION ALL SELECT clip_id, 'calibration annotation missing' FROM ann WHERE task = 'calibration' AND NOT cal UNION ALL SELECT clip_id, 'physics annotation missing track or quantities' FROM ann WHERE task = 'physics' AND (track IS NULL OR NOT phys)
        UNION ALL SELECT clip_id, 'track frame ' || f || ' out of range' FROM (SELECT clip_id, frame_count, unnest(track) AS f FROM ann) WHERE f < 0 OR f >= frame_count
        UNION ALL SELECT clip_id, 'pose frame ' || f || ' out of range' FROM (SELECT clip_id, frame_count, unnest(pose) AS f FROM ann) WHERE f < 0 OR f >= frame_count""",
        ANN,
    ),
)
def validate_annotations(spark, sf_dir):
    c = F.col("conv_id")
    frame = F.struct(F.col("turn").cast("int").alias("frame"))
    clips = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.collect_list(F.when(c % 5 != 0, frame)).alias("track"), F.collect_list(F.when(c % 3 == 0, frame)).alias("pose")
    )
    clips = clips.select(
        c.alias("clip_id"), F.get(F.array(*[F.lit(t) for t in ("track", "pose", "calibration", "physics")]), (c % 4).cast("int")).alias("task"),
        F.when(c % 9 == 0, 0).otherwise(4).alias("frame_count"), F.when(c % 11 == 0, 0).otherwise(320).alias("width"), F.lit(180).alias("height"),
        "track", "pose", F.when(c % 7 != 0, F.struct(F.lit(1.0).alias("length_m"))).alias("calibration"), F.when(c % 6 != 0, F.struct(F.lit(1.0).alias("period_s"))).alias("physics"),
    )
    return R.validate_annotations(clips)


@register("duplicate_clips", "SELECT o_custkey AS clip_id, count(*) AS n, 'duplicate clip_id ' || o_custkey AS error FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_clips(spark, sf_dir):
    return R.duplicate_clips(V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip_id")))


@register("missing_annotations", "SELECT c_custkey AS clip_id, 'cannot load annotation' AS error FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_annotations(spark, sf_dir):
    clips = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"))
    return R.missing_annotations(clips, V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip_id")))


def _manifest(spark, sf_dir):
    i = F.col("doc_id")
    return V.table(spark, sf_dir, "documents").select(
        i.alias("entry_no"),
        F.concat(F.lit("clip_"), (i % 300).cast("string"), F.when(i % 4 == 0, "_slot1").otherwise("")).alias("clip_id"),
        F.get(F.array(*[F.lit(s) for s in ("ci", "dev", "holdout")]), (i % 3).cast("int")).alias("split"),
        (i % 3 == 2).alias("hidden"),
    )


MANIFEST = ("mf", "SELECT doc_id AS entry_no, 'clip_' || (doc_id % 300) || CASE WHEN doc_id % 4 = 0 THEN '_slot1' ELSE '' END AS clip_id, ['ci', 'dev', 'holdout'][doc_id % 3 + 1] AS split, doc_id % 3 = 2 AS hidden FROM documents")


@register("split_ci", with_ctes("SELECT min(entry_no) AS entry_no, clip_id FROM mf WHERE split = 'ci' AND clip_id NOT LIKE '%\\_slot%' ESCAPE '\\' GROUP BY clip_id", MANIFEST))
def split_ci(spark, sf_dir):
    return R.select_split(_manifest(spark, sf_dir), "ci").select("entry_no", "clip_id")


@register("split_all", with_ctes("SELECT entry_no, clip_id FROM mf WHERE split = 'all' OR NOT hidden", MANIFEST))
def split_all(spark, sf_dir):
    return R.select_split(_manifest(spark, sf_dir), "all").select("entry_no", "clip_id")
