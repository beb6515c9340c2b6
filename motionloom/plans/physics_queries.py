"""Queries on fits, periods and experiment classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import poly
from ..operators import curves
from ..operators import fitting as fit
from ..operators import kinematics as K
from ..operators.periods import periods
from ..session import stored
from . import analysis as A
from . import views as V
from .registry import r, register, rounded
from .sql_views import FLIPPED, analysis_ctes, period_ctes, run_ctes, with_ctes

KEY = V.KEY


def fit_sql(src: str, attr: str, degree: int, *ctes, select: str | None = None) -> str:
    """Unweighted fit by centred sums and a second residual pass; `select` may read the coefficients from fr."""
    line = "(b1 - s1*b0/n) / (s2 - s1*s1/n)"
    if degree == 1:
        coef = f"SELECT *, {line} AS k1 FROM fs WHERE n >= 3 AND abs(s2 - s1*s1/n) >= 1e-14"
        coef2 = "SELECT *, 0e0 AS k2, (b0 - s1*k1)/n AS k0 FROM fc"
    else:
        coef = """SELECT *, ((b2 - s2*b0/n) - (s3 - s1*s2/n)/(s2 - s1*s1/n)*(b1 - s1*b0/n)) / ((s4 - s2*s2/n) - (s3 - s1*s2/n)**2/(s2 - s1*s1/n)) AS k2
          FROM fs WHERE n >= 4 AND abs(s2 - s1*s1/n) >= 1e-14"""
        coef2 = """SELECT *, (b0 - s1*k1 - s2*k2)/n AS k0 FROM (SELECT *, ((b1 - s1*b0/n) - (s3 - s1*s2/n)*k2)/(s2 - s1*s1/n) AS k1 FROM fc)"""
    c0 = "m + k0 - k1*t0 + k2*t0*t0"
    shown = [f"round({c0}, 5) + 0.0", "round(k1 - 2*k2*t0, 6) + 0.0"] + (["round(k2, 9) + 0.0"] if degree == 2 else [])
    names = ["c0", "c1", "c2"]
    return with_ctes(
        select or "SELECT clip_id, n, " + ", ".join(f"{e} AS {n}" for e, n in zip(shown, names))
        + ", round(CASE WHEN tt < 1e-18 THEN CASE WHEN rr < 1e-18 THEN 1e0 ELSE 0e0 END ELSE greatest(0e0, least(1e0, 1 - rr/tt)) END, 6) AS r2 FROM fr",
        *ctes,
        ("fv", f"SELECT clip_id, time_s, {attr} AS v, time_s - min(time_s) OVER c AS tau, min(time_s) OVER c AS t0, avg({attr}) OVER c AS m FROM {src} WHERE {attr} IS NOT NULL WINDOW c AS (PARTITION BY clip_id)"),
        ("fs", "SELECT clip_id, count(*) AS n, min(t0) AS t0, min(m) AS m, sum(tau) AS s1, sum(tau**2) AS s2, sum(tau**3) AS s3, sum(tau**4) AS s4, sum(v-m) AS b0, sum((v-m)*tau) AS b1, sum((v-m)*tau**2) AS b2 FROM fv GROUP BY 1"),
        ("fc", coef),
        ("fd", coef2),
        ("fr", """SELECT d.clip_id, any_value(d.n) AS n, any_value(d.t0) AS t0, any_value(d.m) AS m, any_value(k0) AS k0, any_value(k1) AS k1, any_value(k2) AS k2,
          sum((v.v - d.m - k0 - k1*tau - k2*tau*tau)**2) AS rr, sum((v.v - d.m)**2) AS tt FROM fd d JOIN fv v USING (clip_id) GROUP BY d.clip_id"""),
    )


def _fit(samples, attr, degree):
    out = fit.fit_quantity(samples, KEY, attr, degree)
    digits = (5, 6, 9)
    return out.select(
        "clip_id", "n", *[r(F.get("coeffs", F.lit(i)), digits[i]).alias(f"c{i}") for i in range(degree + 1)], r("r2").alias("r2")
    )


@register("fit_line_cumulative", fit_sql("d", "x", 1, "pt", "cum", ("d", FLIPPED.format(src="cum"))))
def fit_line_cumulative(spark, sf_dir):
    return _fit(K.display_points(V.cumulative_points(V.event_points(spark, sf_dir)), KEY, None), "x", 1)


@register("fit_parabola_motion", fit_sql("mdisp", "y", 2, "mp_raw", "mp", "mdisp"))
def fit_parabola_motion(spark, sf_dir):
    shown = K.display_points(V.motion_points(spark, sf_dir), KEY, V.motion_calibrations(spark, sf_dir))
    return _fit(shown, "y", 2)


def _longest_rows(points, calibration=None):
    rows, best = A.best_runs(points, KEY, calibration)
    pick = best.select("clip_id", F.col("run_id").alias("_run"))
    from ..operators.joins import attach

    return attach(rows, pick, KEY, "inner").filter("run_id = _run")


LONGEST = ("pick", "SELECT clip_id, run_id FROM (SELECT clip_id, run_id, row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, min(frame)) AS rk FROM runs GROUP BY clip_id, run_id) WHERE rk = 1")


@register(
    "period_estimate",
    with_ctes(
        "SELECT clip_id, round(period_s, 6) AS period_s FROM periods WHERE period_s IS NOT NULL",
        "mp_raw", "mp", *run_ctes("mp"), LONGEST, ("swing", "SELECT r.* FROM runs r JOIN pick USING (clip_id, run_id)"), *period_ctes("swing"),
    ),
)
def period_estimate(spark, sf_dir):
    rows = _longest_rows(V.motion_points(spark, sf_dir))
    return rounded(periods(stored(rows), KEY).filter("period_s is not null"), "period_s")


@register(
    "zero_crossing_period",
    with_ctes(
        "SELECT clip_id, round(period, 6) AS period_s FROM zero WHERE q = 'x'",
        "pt", *run_ctes("pt"), LONGEST, ("swing", "SELECT r.* FROM runs r JOIN pick USING (clip_id, run_id)"), *period_ctes("swing"),
    ),
)
def zero_crossing_period(spark, sf_dir):
    rows = _longest_rows(V.event_points(spark, sf_dir))
    return rounded(fit.zero_crossing_period(rows, KEY, "x"), "period_s")


MOTION_LEN = "CASE WHEN clip_id % 3 <> 0 THEN 0.1e0 + (clip_id % 5) * 0.05e0 END"
MODEL_COLUMNS = "clip_id, kind AS experiment_type, rank, listed, auto, n AS n_samples, f0 AS frame_start, f1 AS frame_end, round(r2, 6) AS r2, round(nrmse, 5) AS nrmse, round(confidence, 5) AS confidence, round(margin, 5) + 0.0 AS margin"


def _models(scored):
    ranked = A.rank_candidates(scored, KEY)
    return ranked.select(
        "clip_id", "experiment_type", "rank", "listed", "auto", F.col("n").alias("n_samples"), "frame_start", "frame_end",
        r("r2").alias("r2"), r("nrmse", 5).alias("nrmse"), r("confidence", 5).alias("confidence"), r("margin", 5).alias("margin"),
    )


@register("score_models_motion", with_ctes(f"SELECT {MODEL_COLUMNS} FROM ranked", "mp_raw", "mp", "mdisp", *analysis_ctes("mp", "clip_id % 2 = 0", MOTION_LEN, True, "mdisp")))
def score_models_motion(spark, sf_dir):
    scored = A.score_models(
        V.motion_points(spark, sf_dir), KEY, calibration=V.motion_calibrations(spark, sf_dir),
        pendulum_length=V.motion_lengths(spark, sf_dir), period_hint=True,
    )
    return _models(scored)


@register("score_models_events", with_ctes(f"SELECT {MODEL_COLUMNS} FROM ranked", "pt", "cum", ("d", FLIPPED.format(src="cum")), *analysis_ctes("cum", "FALSE", "CAST(NULL AS DOUBLE)", False, "d")))
def score_models_events(spark, sf_dir):
    return _models(A.score_models(V.cumulative_points(V.event_points(spark, sf_dir)), KEY))


@register("score_models_visible", with_ctes(f"SELECT {MODEL_COLUMNS} FROM ranked", "pt", "cum", "cumall", ("d", FLIPPED.format(src="cumall")), *analysis_ctes("cumall", "FALSE", "CAST(NULL AS DOUBLE)", False, "d")))
def score_models_visible(spark, sf_dir):
    return _models(A.score_models(V.cumulative_points(V.event_points(spark, sf_dir), all_visible=True), KEY))


def _analysis_sql(select: str) -> str:
    return with_ctes(select, "mp_raw", "mp", "mdisp", *analysis_ctes("mp", "clip_id % 2 = 0", MOTION_LEN, False, "mdisp"))


def _motion_analysis(spark, sf_dir, **kw):
    return A.analyze(
        V.motion_points(spark, sf_dir), KEY, calibration=V.motion_calibrations(spark, sf_dir),
        pendulum_length=V.motion_lengths(spark, sf_dir), **kw,
    )


@register(
    "analyze_experiment",
    _analysis_sql(
        """SELECT f.clip_id, s.kind AS selected, coalesce(s.auto, FALSE) AS auto_confirmable, c.n_candidates, c.best,
          round(f.coverage, 6) AS coverage, round(f.mean_conf, 6) AS mean_track_confidence, f.clip_id % 2 = 0 AS calibration_active,
          CASE WHEN c.best IS NULL THEN 'too_few_points' ELSE concat_ws(',', CASE WHEN s.kind IS NULL AND c.margin < 0.08 AND c.n_candidates > 1 THEN 'several_models_close' END,
            CASE WHEN s.kind IS NULL AND c.nrmse > 0.08 THEN 'residual_too_large' END, CASE WHEN s.kind IS NULL AND c.few THEN 'too_few_samples' END) END AS warnings,
          concat_ws(',', CASE WHEN f.clip_id % 2 <> 0 THEN 'calibration' END, CASE WHEN c.pend THEN 'pendulum_length' END) AS missing
        FROM facts f LEFT JOIN (SELECT clip_id, CAST(count(*) AS INT) AS n_candidates, arg_min(kind, rank) AS best, any_value(margin) AS margin, arg_min(nrmse, rank) AS nrmse,
            arg_min(NOT (n >= 8 OR (kind = 'uniform_linear' AND n >= 6)), rank) AS few, bool_or(kind = 'pendulum' AND len IS NULL) AS pend FROM ranked WHERE listed GROUP BY clip_id) c USING (clip_id)
        LEFT JOIN (SELECT * FROM ranked WHERE auto) s USING (clip_id)"""
    ),
)
def analyze_experiment(spark, sf_dir):
    out = _motion_analysis(spark, sf_dir)
    return out.select(
        "clip_id", F.col("selected.experiment_type").alias("selected"), "auto_confirmable",
        F.when(F.col("candidates").isNotNull(), F.size("candidates")).alias("n_candidates"),
        F.get("candidates", F.lit(0))["experiment_type"].alias("best"),
        r("coverage").alias("coverage"), r("mean_track_confidence").alias("mean_track_confidence"), "calibration_active",
        F.concat_ws(",", "warnings").alias("warnings"), F.concat_ws(",", "missing").alias("missing"),
    )


@register(
    "analyze_forced_pendulum",
    _analysis_sql("SELECT f.clip_id, s.kind AS selected, CASE WHEN NOT EXISTS (SELECT 1 FROM ranked r WHERE r.clip_id = f.clip_id) THEN 'too_few_points' WHEN s.kind IS NULL THEN 'type_does_not_match' ELSE '' END AS warnings FROM facts f LEFT JOIN (SELECT * FROM ranked WHERE kind = 'pendulum') s USING (clip_id)"),
)
def analyze_forced_pendulum(spark, sf_dir):
    out = _motion_analysis(spark, sf_dir, force_type="pendulum")
    return out.select("clip_id", F.col("selected.experiment_type").alias("selected"), F.concat_ws(",", "warnings").alias("warnings"))


@register(
    "physics_results",
    _analysis_sql(
        """SELECT f.clip_id, round(per, 6) AS period_s, round(CASE WHEN kind = 'pendulum' OR act THEN g END, 5) AS gravity_ms2,
          round(CASE WHEN act THEN CASE kind WHEN 'uniform_linear' THEN v WHEN 'projectile' THEN sqrt(v*v + (SELECT yq1*yq1 FROM wide w WHERE w.clip_id = f.clip_id)) END END, 5) + 0.0 AS velocity_ms,
          round(CASE WHEN act THEN CASE kind WHEN 'uniform_accel' THEN a WHEN 'free_fall' THEN g WHEN 'projectile' THEN g END END, 5) + 0.0 AS acceleration_ms2,
          round(nrmse, 5) AS trajectory_fit_error, round(coalesce(confidence, 0), 5) AS confidence,
          CASE WHEN kind IS NULL THEN 'low_confidence' ELSE 'none' END AS failure_reason
        FROM facts f LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY auto DESC, rank) AS o FROM ranked WHERE listed) WHERE o = 1) USING (clip_id)"""
    ),
)
def physics_results(spark, sf_dir):
    out = A.physics_results(_motion_analysis(spark, sf_dir), KEY, min_visible=5)
    return out.withColumns(
        {
            "period_s": r("period_s"),
            **{n: r(n, 5) for n in ("gravity_ms2", "velocity_ms", "acceleration_ms2", "trajectory_fit_error", "confidence")},
        }
    )


VALUE = "m + k0 + k1 * ({t} - t0) + k2 * ({t} - t0) ** 2"
SPANS = "(SELECT clip_id, min(time_s) AS a, CASE WHEN max(time_s) > min(time_s) THEN max(time_s) ELSE min(time_s) + 1 END AS z FROM {src} GROUP BY clip_id)"


@register(
    "fit_curve",
    fit_sql("mdisp", "y", 2, "mp_raw", "mp", "mdisp", select=f"""SELECT clip_id, step::INT AS step, round(t, 7) AS time_s, round({VALUE.format(t="t")}, 7) + 0.0 AS value
      FROM (SELECT fr.*, step, a + (z - a) * step / 80 AS t FROM fr JOIN {SPANS.format(src="mdisp")} USING (clip_id), range(81) s(step))"""),
)
def fit_curve(spark, sf_dir):
    """The fitted parabola of each motion at 81 times."""
    shown = K.display_points(V.motion_points(spark, sf_dir), KEY, V.motion_calibrations(spark, sf_dir))
    rows = curves.fit_curve(shown, fit.fit_quantity(shown, KEY, "y", 2), KEY)
    return rows.select("clip_id", "step", r("time_s", 7).alias("time_s"), r("value", 7).alias("value"))


@register(
    "fit_axes",
    fit_sql("d", "x", 2, "pt", "cum", ("d", "SELECT * REPLACE (CASE WHEN full_track OR frame < 2 THEN x END AS x, CASE WHEN full_track OR (clip_id % 10 = 0 AND frame = 2) THEN y END AS y) FROM (SELECT *, clip_id % 5 > 0 AS full_track FROM (" + FLIPPED.format(src="cum") + "))"), select=f"""SELECT clip_id, round(a, 6) AS t0, round(z, 6) AS t1,
      round(CASE WHEN lo IS NULL THEN -1 WHEN lo = hi THEN lo - 1 ELSE lo END, 4) + 0.0 AS low, round(CASE WHEN lo IS NULL THEN 1 WHEN lo = hi THEN hi + 1 ELSE hi END, 4) + 0.0 AS high
      FROM {SPANS.format(src="d")} LEFT JOIN (SELECT clip_id, min(v) AS lo, max(v) AS hi FROM (SELECT clip_id, unnest([x, y]) AS v FROM d
        UNION ALL SELECT clip_id, {VALUE.format(t="t")} FROM (SELECT fr.*, a + (z - a) * step / 20 AS t FROM fr JOIN {SPANS.format(src="d")} USING (clip_id), range(21) s(step))) GROUP BY clip_id) USING (clip_id)"""),
)
def fit_axes(spark, sf_dir):
    """Extents of x, y and the fitted parabola of x; some tracks have few values, so no fit, or a flat one."""
    whole, f = F.col("clip_id") % 5 > 0, F.col("frame")
    shown = K.display_points(V.cumulative_points(V.event_points(spark, sf_dir)), KEY, None)
    shown = shown.withColumns({"x": F.when(whole | (f < 2), F.col("x")), "y": F.when(whole | ((F.col("clip_id") % 10 == 0) & (f == 2)), F.col("y"))})
    rows = curves.fit_axes(shown, fit.fit_quantity(shown, KEY, "x", 2), KEY, ["x", "y"])
    return rows.select("clip_id", r("t0").alias("t0"), r("t1").alias("t1"), r("low", 4).alias("low"), r("high", 4).alias("high"))


def _coef_sql(c: str) -> str:
    return f"regexp_replace(CASE WHEN abs({c}) >= 100 THEN printf('%.1f', abs({c})) WHEN abs({c}) >= 10 THEN printf('%.2f', abs({c})) ELSE printf('%.3g', abs({c})) END, '\\.0$', '')"


def _term_sql(i: int, var: str, before: list[str]) -> str:
    first = " AND ".join(f"abs({b}) < 1e-12" for b in before)
    c = f"c{i}"
    lead = f"CASE WHEN {first} THEN CASE WHEN {c} < 0 THEN '−' ELSE '' END WHEN {c} < 0 THEN ' − ' ELSE ' + ' END"
    body = f"CASE WHEN {_coef_sql(c)} = '1' AND NOT ({first} AND {c} < 0) THEN '{var}' ELSE {_coef_sql(c)} || ' {var}' END"
    return f"CASE WHEN abs({c}) >= 1e-12 THEN {lead} || {body} ELSE '' END"


@register(
    "fit_equations",
    fit_sql("d", "x", 2, "pt", "cum", ("d", FLIPPED.format(src="cum")), select=f"""SELECT clip_id, 'x = ' || CASE WHEN body = '' THEN '0' ELSE body END || printf('    R²=%.3f', r2) AS equation FROM (
      SELECT clip_id, r2, CASE WHEN abs(c0) >= 1e-12 THEN CASE WHEN c0 < 0 THEN '-' ELSE '' END || {_coef_sql("c0")} ELSE '' END || {_term_sql(1, "t", ["c0"])} || {_term_sql(2, "t^2", ["c0", "c1"])} AS body
      FROM (SELECT clip_id, m + k0 - k1*t0 + k2*t0*t0 AS c0, k1 - 2*k2*t0 AS c1, k2 AS c2, CASE WHEN tt < 1e-18 THEN CASE WHEN rr < 1e-18 THEN 1e0 ELSE 0e0 END ELSE greatest(0e0, least(1e0, 1 - rr/tt)) END AS r2 FROM fr))"""),
)
def fit_equations(spark, sf_dir):
    shown = K.display_points(V.cumulative_points(V.event_points(spark, sf_dir)), KEY, None)
    return poly.equation(fit.fit_quantity(shown, KEY, "x", 2), "x", 2).select("clip_id", "equation")
