"""Experiment classification: motion models scored per track, ranked and selected."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C
from ..functions import calibration as cal_fn
from ..operators import fitting as fit
from ..operators import kinematics as kin
from ..operators.joins import attach
from ..operators.periods import periods
from ..operators.tiling import is_tiled
from ..session import cut_lineage, stored

Keys = Sequence[str]

# experiment types in the order in which equal scores keep their place
TYPES = ("uniform_linear", "uniform_accel", "free_fall", "projectile", "pendulum")

MODELS = {
    "uniform_linear": ("s=s0+vt", "uniform.s"),
    "uniform_accel": ("s=s0+v0t+0.5at^2", "accel.s"),
    "free_fall": ("y=y0+v0yt+0.5gt^2", "freefall.y"),
    "projectile": ("x=x0+v0xt; y=y0+v0yt+0.5gt^2", "projectile.xy"),
    "pendulum": ("x=A cos(2πt/T + φ) + C", "pendulum.period"),
}


def _no() -> Column:
    return F.lit(None).cast("double")


def _params(**values: Column) -> Column:
    pairs = [part for name, value in values.items() for part in (F.lit(name), value.cast("double"))]
    return F.create_map(*pairs)


def _units(**values: Column | str) -> Column:
    pairs = [p for name, v in values.items() for p in (F.lit(name), v if isinstance(v, Column) else F.lit(v))]
    return F.create_map(*pairs)


def _model(kind: str, keep: Column, params: Column, units: Column, r2: Column, nrmse: Column, v: Column, a: Column) -> Column:
    """Candidate struct, or null where the model does not apply."""
    return F.when(
        keep,
        F.struct(
            F.lit(TYPES.index(kind)).alias("ord"),
            F.lit(kind).alias("experiment_type"),
            params.alias("parameters"),
            units.alias("units"),
            r2.alias("r2"),
            nrmse.alias("nrmse"),
            v.alias("v"),
            a.alias("a"),
        ),
    )


def best_runs(points: DataFrame, keys: Keys, calibration: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows of all runs with their frame of reference, sums of the longest run per track)."""
    keys = list(keys)
    shown = kin.display_points(points, keys, calibration)
    if calibration is None:
        shown = shown.withColumn("cal", F.lit(None))
    rows = fit.with_run_frame(kin.runs(shown.drop("cal"), keys), keys)
    if is_tiled(rows):
        rows = cut_lineage(rows)  # split tracks read these rows several times
    sums = fit.run_sums(rows, keys)
    return rows, kin.longest_run(sums, keys)


def score_models(
    points: DataFrame,
    keys: Keys = ("clip_id",),
    *,
    calibration: DataFrame | None = None,
    pendulum_length: DataFrame | None = None,
    period_hint: bool = False,
) -> DataFrame:
    """One row per track and applicable model, with its confidence after the preference rules.

    ``points`` carry time_s; ``calibration`` keys + cal; ``pendulum_length`` keys + length_m.
    """
    keys = list(keys)
    rows, best = best_runs(points, keys, calibration)
    facts = kin.track_summary(points, keys).select(*keys, "coverage", F.col("mean_confidence").alias("mean_conf"))
    best = stored(best.filter(F.col("n") >= C.MIN_LINEAR_POINTS))  # read by the models and to find the swings
    # from here on every table has one row per track: plain joins, no skew
    base = best.join(facts, keys)
    base = base.join(calibration, keys, "left") if calibration is not None else base.withColumn("cal", _empty_cal())
    if pendulum_length is not None:
        base = base.join(pendulum_length.select(*keys, "length_m"), keys, "left")
    else:
        base = base.withColumn("length_m", _no())
    cal = F.col("cal")
    base = base.withColumns(
        {
            "calibrated": cal_fn.active(cal),
            "cal_quality": cal_fn.record_quality(cal),
            "pos_u": cal_fn.position_unit(cal),
            "spd_u": cal_fn.speed_unit(cal),
            "acc_u": cal_fn.accel_unit(cal),
        }
    ).drop("cal")
    base = base.join(_swings(rows, best, keys), keys, "left")
    base = _solve_models(base)
    models = F.array_compact(F.array(*_candidates({name: F.col(name) for name in base.columns}, period_hint)))
    scored = base.select(
        *keys, "n", "frame_start", "frame_end", "time_start_s", "time_end_s", "coverage", "mean_conf",
        "cal_quality", "calibrated", "length_m", F.explode(models).alias("m"),
    ).select("*", "m.*").drop("m")
    return _apply_preferences(scored, keys, period_hint)


def _empty_cal() -> Column:
    """Record of an uncalibrated track."""
    return F.struct(F.lit("none").alias("mode"), F.lit(False).alias("active"), F.lit("").alias("warning"))


def _swings(rows: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """Period and harmonic fit of the longest runs that may swing."""
    orbit = fit.circular(
        F.col("cxx"), F.col("cyy"), F.col("cxy"), F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    )
    able = best.filter((F.col("n") >= C.MIN_PENDULUM_POINTS) & ~orbit).select(*keys, F.col("run_id").alias("_run"))
    long = attach(rows, able, keys, "inner").filter("run_id = _run")
    long = stored(long)  # read by each estimate and by the fit; everything before it runs once
    swings = fit.harmonic_fit(long, periods(long, keys), keys)
    return swings.select(*keys, F.col("period_s").alias("p_T"), F.col("r2").alias("p_r2"), F.col("nrmse").alias("p_nrmse"))


def _solve_models(base: DataFrame) -> DataFrame:
    """Coefficients, then r2 and nrmse, of every line and parabola."""
    c = {name: F.col(name) for name in base.columns}
    solved = {f"{q}l": F.array(*fit.weighted_line(c, q)) for q in ("x", "y", "s")}
    # the parabola along x is not part of any model
    solved |= {f"{q}q": F.array(*fit.weighted_parabola(c, q)) for q in ("y", "s")}
    staged = base.withColumns(solved)
    res = {}
    for name in solved:
        q, size = name[0], 3 if name[1] == "q" else 2
        res[f"{name}_res"] = fit.residual(c, q, [F.get(name, F.lit(i)) for i in range(size)])
    staged = staged.withColumns({**res, **{f"{q}_tot": fit.total_spread(c, q) for q in ("x", "y", "s")}})
    out = {}
    for name in solved:
        q = name[0]
        out[f"{name}_r2"] = fit.r2_of(F.col(f"{name}_res"), F.col(f"{q}_tot"))
        out[f"{name}_nrmse"] = fit.nrmse_of(F.col(f"{name}_res"), c["w0"], c[f"{q}max"] - c[f"{q}min"])
    return staged.withColumns(out)


def _candidates(c: dict[str, Column], hint: bool) -> list[Column]:
    k = lambda name, i: F.get(c[name], F.lit(i))
    base_s = c["x_mean"] * c["ux"] + c["y_mean"] * c["uy"]
    span_x, span_y = c["xmax"] - c["xmin"], c["ymax"] - c["ymin"]
    quad = c["n"] >= C.MIN_QUAD_POINTS
    uniform = _model(
        "uniform_linear", F.lit(True),
        _params(s0=base_s + k("sl", 0), v=k("sl", 1), ux=c["ux"], uy=c["uy"]),
        _units(s0=c["pos_u"], v=c["spd_u"], ux="", uy=""),
        c["sl_r2"], c["sl_nrmse"], k("sl", 1), _no(),
    )
    accel = _model(
        "uniform_accel", quad & c["sq_r2"].isNotNull(),
        _params(s0=base_s + k("sq", 0), v0=k("sq", 1), a=k("sq", 2) * 2.0, ux=c["ux"], uy=c["uy"]),
        _units(s0=c["pos_u"], v0=c["spd_u"], a=c["acc_u"], ux="", uy=""),
        c["sq_r2"], c["sq_nrmse"], k("sq", 1), k("sq", 2) * 2.0,
    )
    a_y = k("yq", 2) * 2.0
    g = F.when(c["calibrated"], F.abs(a_y))
    g_unit = F.when(c["calibrated"], "m/s^2").otherwise("")
    falls = (
        quad & (span_y >= 1e-9) & (span_x <= span_y * C.FREEFALL_DRIFT) & (c["yq_r2"] >= c["yl_r2"] + 0.03)
    )
    free = _model(
        "free_fall", F.coalesce(falls, F.lit(False)),
        _params(y0=c["y_mean"] + k("yq", 0), v0y=k("yq", 1), g=g, a_y=a_y),
        _units(y0=c["pos_u"], v0y=c["spd_u"], g=g_unit, a_y=c["acc_u"]),
        c["yq_r2"], c["yq_nrmse"], _no(), _no(),
    )
    flies = (
        quad & (span_x >= F.greatest(span_y, F.lit(1e-9)) * 0.15) & (c["xl_r2"] >= 0.92)
        & (c["yq_r2"] >= 0.90) & (c["yq_r2"] >= c["yl_r2"] + 0.02)
    )
    projectile = _model(
        "projectile", F.coalesce(flies, F.lit(False)),
        _params(x0=c["x_mean"] + k("xl", 0), v0x=k("xl", 1), y0=c["y_mean"] + k("yq", 0), v0y=k("yq", 1), g=g, a_y=a_y),
        _units(x0=c["pos_u"], v0x=c["spd_u"], y0=c["pos_u"], v0y=c["spd_u"], g=g_unit, a_y=c["acc_u"]),
        F.least(c["xl_r2"], c["yq_r2"]), (c["xl_nrmse"] + c["yq_nrmse"]) * 0.5, _no(), _no(),
    )
    period, length = c["p_T"], c["length_m"]
    swings = (period > 0) & (c["time_end_s"] - c["time_start_s"] >= period * 0.6) & (c["p_r2"] >= 0.75)
    g_len = F.when(length > 0, length * (4.0 * math.pi**2) / (period * period))
    r2 = F.least(F.lit(1.0), c["p_r2"] + 0.01) if hint else c["p_r2"]
    pendulum = _model(
        "pendulum", F.coalesce(swings, F.lit(False)),
        _params(T=period, L=length, g=g_len),
        _units(T="s", L="m", g=F.when(g_len.isNotNull(), "m/s^2").otherwise("")),
        r2, c["p_nrmse"], _no(), _no(),
    )
    return [uniform, accel, free, projectile, pendulum]


def _apply_preferences(scored: DataFrame, keys: list[str], hint: bool) -> DataFrame:
    """Confidence, then the rules that compare the at most five models of a track."""
    c = F.col
    raw = (
        F.greatest(F.lit(0.0), c("r2")) * 0.45
        + F.greatest(F.lit(0.0), F.lit(1.0) - F.least(c("nrmse") / 0.10, F.lit(1.0))) * 0.25
        + c("coverage") * 0.12
        + c("mean_conf") * 0.10
        + c("cal_quality") * 0.08
    )
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, F.lit(top)))
    conf = clamp(raw, 0.99)
    if hint:
        conf = F.when(c("experiment_type") == "pendulum", F.least(F.lit(1.0), conf + C.PERIOD_HINT_BOOST)).otherwise(conf)
    w = W.partitionBy(*keys)
    of = lambda kind, col: F.max(F.when(c("experiment_type") == kind, col)).over(w)
    kind = c("experiment_type")
    out = scored.withColumn("confidence", conf).withColumns(
        {
            "_u_r2": of("uniform_linear", c("r2")), "_u_nr": of("uniform_linear", c("nrmse")),
            "_a_r2": of("uniform_accel", c("r2")), "_a_nr": of("uniform_accel", c("nrmse")),
            "_a_a": of("uniform_accel", F.abs("a")), "_a_v": of("uniform_accel", F.abs("v")),
            **{f"_has_{k}": F.coalesce(of(k, F.lit(True)), F.lit(False)) for k in TYPES[1:]},
        }
    )
    length = F.greatest(c("time_end_s") - c("time_start_s"), F.lit(1e-9))
    gain = c("_a_r2") - c("_u_r2")
    weak = (c("_a_a") * length <= F.greatest(c("_a_v"), F.lit(1e-6)) * C.SMALL_ACCEL_RATIO) | (gain < 0.015)
    clear = ~weak & (gain >= 0.03) & (c("_a_nr") <= c("_u_nr") + 0.01)
    times = lambda cond, factor: F.when(F.coalesce(cond, F.lit(False)), F.lit(factor)).otherwise(F.lit(1.0))
    is_u, is_a = kind == "uniform_linear", kind == "uniform_accel"
    small = is_a & (F.abs("v") > 1e-9) & (F.abs("a") * length < F.abs("v") * C.SMALL_ACCEL_RATIO)
    factor = (
        times(is_a & weak, 0.72)
        * times(is_u & c("_has_uniform_accel") & clear, 0.8)
        * times(is_a & c("_has_free_fall"), 0.52)
        * times(is_a & c("_has_projectile"), 0.52)
        * times((kind == "free_fall") & c("_has_projectile"), 0.6)
        * times((kind != "pendulum") & c("_has_pendulum"), 0.55)
    )
    warnings = F.array_compact(
        F.array(
            F.when(small, "small_acceleration"),
            F.when(is_a & weak, "quadratic_gain_small"),
            F.when(is_a & c("_has_free_fall"), "free_fall_more_specific"),
            F.when(is_a & c("_has_projectile"), "projectile_more_specific"),
        )
    )
    missing = F.array_compact(
        F.array(
            F.when(~c("calibrated"), "calibration"),
            F.when((kind == "pendulum") & F.get(F.map_values(F.map_filter("parameters", lambda k, _v: k == "g")), F.lit(0)).isNull(), "pendulum_length"),
        )
    )
    out = out.withColumns({"confidence": clamp(c("confidence") * factor, 0.99), "warnings": warnings, "missing": missing})
    return out.drop(*[name for name in out.columns if name.startswith("_")])


def rank_candidates(scored: DataFrame, keys: Keys) -> DataFrame:
    """Add ``rank`` (all), ``listed``, ``margin`` and ``auto`` for the best listed one."""
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col("ord"))
    w = W.partitionBy(*keys)
    passing = F.col("nrmse") <= C.LIST_NRMSE
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("_any", F.max(passing).over(w))
    ranked = ranked.withColumn("listed", F.when(F.col("_any"), passing).otherwise(F.col("rank") == 1))
    conf = F.sort_array(F.collect_list(F.when(F.col("listed"), F.col("confidence"))).over(w), asc=False)
    ranked = ranked.withColumns(
        {
            "n_listed": F.sum(F.col("listed").cast("int")).over(w),
            "margin": F.get(conf, F.lit(0)) - F.coalesce(F.get(conf, F.lit(1)), F.lit(0.0)),
            "_top": F.min(F.when(F.col("listed"), F.col("rank"))).over(w),
        }
    )
    enough = (F.col("n") >= C.MIN_QUAD_POINTS) | ((F.col("experiment_type") == "uniform_linear") & (F.col("n") >= C.MIN_LINEAR_POINTS))
    top = F.col("rank") == F.col("_top")
    auto = top & enough & (F.col("nrmse") <= C.MAX_AUTO_NRMSE) & (F.col("confidence") >= C.AUTO_CONFIRM_MIN) & (F.col("margin") >= C.AUTO_CONFIRM_MARGIN)
    return ranked.withColumns({"is_top": top, "enough": enough, "auto": auto}).drop("_any", "_top")


def analyze(
    points: DataFrame,
    keys: Keys = ("clip_id",),
    *,
    calibration: DataFrame | None = None,
    pendulum_length: DataFrame | None = None,
    period_hint: bool = False,
    force_type: str | None = None,
) -> DataFrame:
    """One row per track: listed candidates, the selected one, warnings and missing conditions."""
    keys = list(keys)
    scored = score_models(points, keys, calibration=calibration, pendulum_length=pendulum_length, period_hint=period_hint)
    ranked = rank_candidates(scored, keys)
    cand = F.struct(
        "rank", "experiment_type", "confidence", "r2", "nrmse", F.col("n").alias("n_samples"), "parameters", "units",
        "frame_start", "frame_end", "time_start_s", "time_end_s", "warnings", "missing",
    )
    forced = force_type if force_type not in (None, "unknown") else None
    picked = F.col("experiment_type") == forced if forced else F.col("auto")
    tops = lambda test: F.coalesce(F.bool_or(F.col("is_top") & test), F.lit(False))
    listed = F.array_sort(F.collect_list(F.when(F.col("listed"), cand)), lambda a, b: F.when(a["rank"] < b["rank"], -1).otherwise(1))
    per_track = ranked.groupBy(*keys).agg(
        listed.alias("candidates"),
        F.first(F.when(picked, cand), ignorenulls=True).alias("selected"),
        F.coalesce(F.bool_or("auto"), F.lit(False)).alias("_auto"),
        tops((F.col("margin") < C.AUTO_CONFIRM_MARGIN) & (F.col("n_listed") > 1)).alias("_close"),
        tops(F.col("nrmse") > C.MAX_AUTO_NRMSE).alias("_rough"),
        tops(~F.col("enough")).alias("_few"),
        F.bool_or(F.col("listed") & (F.col("experiment_type") == "pendulum") & F.col("length_m").isNull()).alias("_no_length"),
    )
    facts = kin.track_summary(points, keys).select(
        *keys, "n_visible", "coverage", F.col("mean_confidence").alias("mean_track_confidence")
    )
    out = facts.join(calibration, keys, "left") if calibration is not None else facts.withColumn("cal", _empty_cal())
    cal = F.col("cal")
    out = out.withColumns(
        {
            "calibration_active": cal_fn.active(cal),
            "position_unit": cal_fn.position_unit(cal),
            "speed_unit": cal_fn.speed_unit(cal),
        }
    ).drop("cal")
    out = out.join(per_track, keys, "left")
    scored_any = F.col("candidates").isNotNull()
    if forced:
        notes = [F.when(scored_any & F.col("selected").isNull(), "type_does_not_match")]
    else:
        open_ = scored_any & ~F.coalesce("_auto", F.lit(False))
        notes = [
            F.when(open_ & F.col("_close"), "several_models_close"),
            F.when(open_ & F.col("_rough"), "residual_too_large"),
            F.when(open_ & F.col("_few"), "too_few_samples"),
        ]
    return out.select(
        *keys, "n_visible", "candidates", "selected",
        (F.coalesce("_auto", F.lit(False)) if not forced else F.lit(False)).alias("auto_confirmable"),
        "coverage", "mean_track_confidence", "calibration_active", "position_unit", "speed_unit",
        F.array_compact(F.array(F.when(~scored_any, "too_few_points"), *notes)).alias("warnings"),
        F.array_compact(
            F.array(F.when(~F.col("calibration_active"), "calibration"), F.when(F.col("_no_length"), "pendulum_length"))
        ).alias("missing"),
    )


def physics_results(analysis: DataFrame, keys: Keys = ("clip_id",), *, min_visible: int = 0) -> DataFrame:
    """SI quantities of the selected (else best listed) candidate; null means not computable.

    ``min_visible`` = 5 gives the evaluation wrapper, which rejects shorter tracks outright.
    """
    keys = list(keys)
    pick = F.coalesce(F.col("selected"), F.get("candidates", F.lit(0)))
    rows = analysis.withColumn("_c", F.when(F.col("n_visible") >= min_visible, pick))
    param, unit = F.col("_c.parameters"), F.col("_c.units")

    def si(name: str, *accepted: str) -> Column:
        return F.when(F.try_element_at(unit, F.lit(name)).isin(*accepted), F.try_element_at(param, F.lit(name)))

    gravity = si("g", "m/s^2")
    vx, vy = si("v0x", "m/s"), si("v0y", "m/s")
    falls = F.col("_c.experiment_type").isin("free_fall", "projectile")
    return rows.select(
        *keys,
        si("T", "s").alias("period_s"),
        gravity.alias("gravity_ms2"),
        F.coalesce(si("v", "m/s"), F.hypot(vx, vy), vx).alias("velocity_ms"),
        F.coalesce(si("a", "m/s^2"), F.when(falls, gravity)).alias("acceleration_ms2"),
        F.col("_c.nrmse").alias("trajectory_fit_error"),
        F.coalesce("_c.confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("_c").isNull(), "low_confidence").otherwise("none").alias("failure_reason"),
    )
