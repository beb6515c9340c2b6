"""Calibration records: solving them once, and mapping points with the solved record.

``solve`` turns the raw record (rulers, frame, plane, camera) into one struct ``cal``.
Everything per point is a column expression over that struct.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import constants as C
from . import plane as P
from .geometry import acute_angle, distance, dlit, point_in_quad, quad_measures

# validation outcome -> reason code; empty means usable
REASONS = (
    "no_ruler",
    "ruler_too_short",
    "need_two_rulers",
    "ruler_angle",
    "rulers_too_close",
    "ruler_ratio",
    "need_four_corners",
    "plane_size",
    "not_convex",
    "plane_too_small",
    "corners_collinear",
    "plane_coverage",
    "ill_conditioned",
    "reprojection",
)


def ruler_length(r: Column) -> Column:
    return distance(r["a"]["x"], r["a"]["y"], r["b"]["x"], r["b"]["y"])


def ruler_angle(r: Column) -> Column:
    return F.degrees(F.atan2(r["b"]["y"] - r["a"]["y"], r["b"]["x"] - r["a"]["x"]))


def ruler_mid(r: Column) -> tuple[Column, Column]:
    return (r["a"]["x"] + r["b"]["x"]) / 2.0, (r["a"]["y"] + r["b"]["y"]) / 2.0


def ruler_ppm(r: Column) -> Column:
    """Pixels per metre; null for a degenerate ruler."""
    usable = (r["length_m"] > 1e-9) & (ruler_length(r) >= C.MIN_RULER_PIXELS)
    return F.when(usable, ruler_length(r) / r["length_m"])


def _by_role(rulers: Column, role: str, position: int) -> Column:
    named = F.get(F.filter(rulers, lambda r: r["role"] == role), F.lit(0))
    return F.coalesce(named, F.get(rulers, F.lit(position)))


def near_ruler(rulers: Column) -> Column:
    return _by_role(rulers, "near", 0)


def far_ruler(rulers: Column) -> Column:
    return _by_role(rulers, "far", 1)


def swap_near_far(rulers: Column) -> Column:
    def turned(r: Column) -> Column:
        role = F.when(r["role"] == "near", "far").when(r["role"] == "far", "near").otherwise(r["role"])
        return r.withField("role", role)

    return F.transform(rulers, turned)


def _first_failure(*checks: tuple[Column, str]) -> Column:
    """Code of the first check that holds; an undecided (null) check counts as failed."""
    out = None
    for failed, code in checks:
        bad = F.coalesce(failed, F.lit(True))
        out = F.when(bad, code) if out is None else out.when(bad, code)
    return out.otherwise("")


def solve(dim: DataFrame, keys: list[str], *, planar: bool = True) -> DataFrame:
    """keys + ``cal``. Input columns: mode, rulers, frame, plane, camera, camera_moved, pixel_sigma.

    ``planar=False`` states that no record is planar; the struct then has no homography and the
    point expressions built on it leave the planar branch out.
    """
    near, far = near_ruler(F.col("rulers")), far_ruler(F.col("rulers"))
    staged = dim.withColumns({"_near": near, "_far": far, "_first": F.get("rulers", F.lit(0))})
    n_mx, n_my = ruler_mid(F.col("_near"))
    f_mx, f_my = ruler_mid(F.col("_far"))
    quad, plane, cam = F.col("plane.corners"), F.col("plane"), F.col("camera")
    staged = staged.withColumns(
        {
            "_n_ppm": ruler_ppm(F.col("_near")),
            "_f_ppm": ruler_ppm(F.col("_far")),
            "_ppm": ruler_ppm(F.col("_first")),
            "_nx": n_mx,
            "_ny": n_my,
            "_fx": f_mx,
            "_fy": f_my,
            "_m": quad_measures(quad),
        }
    )
    if planar:
        corners = [F.get(quad, F.lit(i))[axis].alias(f"{axis}{i}") for i in range(4) for axis in ("x", "y")]
        lens = [cam[name].cast("double").alias(name) for name in ("width", "height", "fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3")]
        staged = staged.withColumn(
            "_s",
            P.plane_solution(
                F.struct(*corners), F.struct(plane["width_m"], plane["height_m"]), F.struct(*lens),
                F.struct(F.col("frame.origin_x"), F.col("frame.origin_y")),
            ),
        )
    else:
        staged = staged.withColumn("_s", F.lit(None).cast(P.PLANE_SOLUTION))
    staged = staged.withColumns({"_cond": F.col("_s.cond"), "_rms": F.col("_s.rms")})
    area = F.col("_m.area_px")
    image_area = F.when((cam["width"] > 0) & (cam["height"] > 0), cam["width"] * cam["height"].cast("double"))
    coverage = F.coalesce(area / F.when(image_area > 1.0, image_area), F.lit(0.0))
    ratio = F.greatest("_n_ppm", "_f_ppm") / F.least("_n_ppm", "_f_ppm")
    uniform = _first_failure((F.coalesce(F.size("rulers"), F.lit(0)) < 1, "no_ruler"), (F.col("_ppm").isNull(), "ruler_too_short"))
    near_far = _first_failure(
        (F.coalesce(F.size("rulers"), F.lit(0)) < 2, "need_two_rulers"),
        (F.col("_n_ppm").isNull() | F.col("_f_ppm").isNull(), "ruler_too_short"),
        (acute_angle(ruler_angle(F.col("_near")), ruler_angle(F.col("_far"))) > C.MAX_RULER_ANGLE_DEG, "ruler_angle"),
        (F.hypot(F.col("_fx") - F.col("_nx"), F.col("_fy") - F.col("_ny")) < C.MIN_DEPTH_PIXELS, "rulers_too_close"),
        (ratio > C.PPM_RATIO_MAX, "ruler_ratio"),
    )
    flat = _first_failure(
        (F.coalesce(F.size(quad), F.lit(0)) < 4, "need_four_corners"),
        ((plane["width_m"] <= 1e-6) | (plane["height_m"] <= 1e-6), "plane_size"),
        (~F.col("_m.convex"), "not_convex"),
        (area < C.MIN_QUAD_AREA_PX, "plane_too_small"),
        (F.col("_m.min_angle_deg") < C.MIN_INTERIOR_ANGLE_DEG, "corners_collinear"),
        ((F.coalesce(image_area, F.lit(0.0)) > 1.0) & (coverage < C.MIN_COVERAGE), "plane_coverage"),
        (~(F.col("_cond") <= C.MAX_CONDITION), "ill_conditioned"),
        (F.col("_rms") > C.MAX_REPROJ_RMS_PX, "reprojection"),
    )
    staged = staged.withColumn(
        "_why",
        F.when(F.col("mode") == "uniform", uniform)
        .when(F.col("mode") == "near_far", near_far)
        .when(F.col("mode") == "planar", flat)
        .otherwise(""),
    )
    known = F.col("mode").isin("uniform", "near_far", "planar") & (F.col("_why") == "")
    notes = F.concat_ws(
        ";",
        F.when(F.col("_rms") > C.WARN_REPROJ_RMS_PX, "reprojection"),
        F.when(~P.camera_ready(cam), "no_intrinsics"),
        F.when(F.coalesce("camera_moved", F.lit(False)), "camera_moved"),
    )
    warning = F.when(F.col("_why") != "", F.col("_why")).when(F.col("mode") == "planar", notes).otherwise("")
    frame = F.col("frame")
    sigma = F.col("pixel_sigma")
    angle = F.coalesce(frame["axis_angle_deg"], F.lit(0.0))
    den = F.pow(F.col("_fx") - F.col("_nx"), 2) + F.pow(F.col("_fy") - F.col("_ny"), 2)
    deep = den >= 1e-9
    at = [F.when(frame["origin_x"].isNotNull() & frame["origin_y"].isNotNull(), frame[n]).otherwise(F.lit(0.0)) for n in ("origin_x", "origin_y")]
    staged = staged.withColumns(
        {
            "_ax": F.when(deep, (F.col("_fx") - F.col("_nx")) / den).otherwise(F.lit(0.0)),
            "_ay": F.when(deep, (F.col("_fy") - F.col("_ny")) / den).otherwise(F.lit(0.0)),
        }
    ).withColumn("_uo", (at[0] - F.col("_nx")) * F.col("_ax") + (at[1] - F.col("_ny")) * F.col("_ay"))
    origin_ppm = _blend(F.col("_n_ppm"), F.col("_f_ppm"), F.col("_uo"))
    maps = []
    if planar:
        maps = [
            F.when(known, F.struct(*[F.col(f"_s.{p}{i}").alias(f"h{i}") for i in range(9)])).alias(name)
            for name, p in (("h", "h"), ("hi", "g"))
        ] + [F.col("_s.base_x").alias("base_x"), F.col("_s.base_y").alias("base_y")]
    cal = F.struct(
        F.when(known, F.col("mode")).otherwise("none").alias("mode"),
        known.alias("active"),
        warning.alias("warning"),
        (frame["origin_x"].isNotNull() & frame["origin_y"].isNotNull()).alias("placed"),
        frame["origin_x"].alias("ox"),
        frame["origin_y"].alias("oy"),
        angle.alias("angle"),
        F.coalesce(frame["y_up"], F.lit(True)).alias("y_up"),
        F.col("_ppm").alias("ppm"),
        *[F.col(f"_{n}").alias(n) for n in ("nx", "ny", "ax", "ay", "n_ppm", "f_ppm")],
        origin_ppm.alias("ppm_o"),
        F.cos(F.radians(angle)).alias("ca"),
        F.sin(F.radians(angle)).alias("sa"),
        quad.alias("quad"),
        plane["width_m"].alias("width_m"),
        plane["height_m"].alias("height_m"),
        *maps,
        F.col("_rms").alias("rms"),
        F.when(sigma.isNull() | (sigma == 0), F.lit(C.DEFAULT_PIXEL_SIGMA)).otherwise(sigma).alias("pixel_sigma"),
        F.coalesce("camera_moved", F.lit(False)).alias("camera_moved"),
        area.alias("area_px"),
        F.col("_m.min_angle_deg").alias("min_angle_deg"),
        coverage.alias("coverage"),
        cam.alias("camera"),
    )
    return staged.select(*keys, cal.alias("cal"))


def is_mode(cal: Column, mode: str) -> Column:
    return F.coalesce(cal["mode"] == mode, F.lit(False))


def active(cal: Column) -> Column:
    return F.coalesce(cal["active"], F.lit(False))


def placed(cal: Column) -> Column:
    return F.coalesce(cal["placed"], F.lit(False))


def position_unit(cal: Column) -> Column:
    return F.when(active(cal), "m").otherwise("px")


def speed_unit(cal: Column) -> Column:
    return F.when(active(cal), "m/s").otherwise("px/s")


def accel_unit(cal: Column) -> Column:
    return F.when(active(cal), "m/s^2").otherwise("px/s^2")


def depth_position(cal: Column, x: Column, y: Column) -> Column:
    """Unclamped place between the near (0) and far (1) ruler; 0 when they coincide."""
    return (x - cal["nx"]) * cal["ax"] + (y - cal["ny"]) * cal["ay"]


def _blend(near: Column, far: Column, raw_u: Column) -> Column:
    u = F.greatest(F.lit(-C.EXTRAPOLATE_U), F.least(F.lit(1.0 + C.EXTRAPOLATE_U), raw_u))
    scale = near + u * (far - near)
    return F.greatest(F.when(scale <= 1e-9, F.least(near, far)).otherwise(scale), F.lit(1e-6))


def near_far_ppm(cal: Column, x: Column, y: Column) -> Column:
    return _blend(cal["n_ppm"], cal["f_ppm"], depth_position(cal, x, y))


Pair = tuple[Column, Column]


def undistorted(cal: Column, x: Column, y: Column) -> Pair:
    """Lens-corrected pixel of planar records; compute it once and pass it on as ``uv``."""
    u, v = P.undistort(x, y, cal["camera"])
    planar = is_mode(cal, "planar")
    return F.when(planar, u).otherwise(x), F.when(planar, v).otherwise(y)


def position_sigma(cal: Column, x: Column, y: Column, pixel_sigma: Column | float | None = None, uv: Pair | None = None) -> Pair:
    """One-sigma world uncertainty; 0 outside planar mode."""
    u, v = undistorted(cal, x, y) if uv is None else uv
    sx, sy = P.world_sigma(cal["h"], u, v, cal["pixel_sigma"] if pixel_sigma is None else pixel_sigma, cal["rms"])
    planar = is_mode(cal, "planar")
    return F.when(planar, sx).otherwise(F.lit(0.0)), F.when(planar, sy).otherwise(F.lit(0.0))


def ppm_at(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """Add the local scale at image point (x, y); null where there is none."""
    cal, px, py = F.col("cal"), F.col(x), F.col(y)
    u, v = undistorted(cal, px, py)
    rows = df.withColumns({"_u": u, "_v": v})
    sx, sy = position_sigma(cal, px, py, 1.0, uv=(F.col("_u"), F.col("_v")))
    rows = rows.withColumn("_m", F.hypot(sx, sy))
    scale = (
        F.when(is_mode(cal, "planar"), F.when(F.col("_m") > 1e-12, F.lit(1.0) / F.col("_m")))
        .when(is_mode(cal, "uniform"), cal["ppm"])
        .when(is_mode(cal, "near_far"), near_far_ppm(cal, px, py))
    )
    return rows.withColumn(out, scale).drop("_u", "_v", "_m")


def extrapolated(cal: Column, x: Column, y: Column, planar: bool = True) -> Column:
    raw = depth_position(cal, x, y)
    beyond = F.when(is_mode(cal, "near_far"), F.coalesce((raw < -1e-6) | (raw > 1.0 + 1e-6), F.lit(False)))
    if planar:
        beyond = F.when(is_mode(cal, "planar"), ~point_in_quad(x, y, cal["quad"])).otherwise(beyond)
    return F.coalesce(beyond, F.lit(False))


def log_mean(ppm0: Column, ppm1: Column) -> Column:
    """Metres per pixel along a straight image path with linearly changing scale."""
    delta = ppm1 - ppm0
    flat = F.abs(delta) < 1e-9
    return F.when(flat, F.lit(1.0) / ppm0).otherwise(F.ln(ppm1 / ppm0) / F.when(flat, F.lit(1.0)).otherwise(delta))


def _origin(cal: Column) -> Pair:
    zero = F.lit(0.0)
    return F.when(placed(cal), cal["ox"]).otherwise(zero), F.when(placed(cal), cal["oy"]).otherwise(zero)


def has_planar(solved: DataFrame) -> bool:
    """Whether the solved records carry homographies."""
    return "h" in solved.schema["cal"].dataType.names


def pixel_to_world(df: DataFrame, x: str, y: str, out: tuple[str, str], *, planar: bool = True) -> DataFrame:
    """Add the world position of image point (x, y); also ``pu``/``pv``, its lens-corrected pixel.

    Rotation applies only with a placed origin, the image flip only outside planar mode. The
    steps are separate projections so that no intermediate is computed twice.
    """
    cal, px, py = F.col("cal"), F.col(x), F.col(y)
    ox, oy = _origin(cal)
    uv = undistorted(cal, px, py) if planar else (px, py)
    rows = df.withColumns({"pu": uv[0], "pv": uv[1], "_k": F.when(is_mode(cal, "near_far"), near_far_ppm(cal, px, py))})
    scale = (
        F.when(is_mode(cal, "uniform"), F.lit(1.0) / F.coalesce(cal["ppm"], F.lit(1.0)))
        .when(is_mode(cal, "near_far"), log_mean(cal["ppm_o"], F.col("_k")))
        .otherwise(F.lit(1.0))
    )
    rows = rows.withColumn("_k", scale)
    flip = F.when(F.coalesce(cal["y_up"], F.lit(True)), F.lit(-1.0)).otherwise(F.lit(1.0))
    mapped = P.apply_h(cal["h"], F.col("pu"), F.col("pv")) if planar else None
    dx, dy = (px - ox) * F.col("_k"), flip * (py - oy) * F.col("_k")
    if planar:
        on_plane = is_mode(cal, "planar")
        base = [F.when(placed(cal), cal[n]).otherwise(F.lit(0.0)) for n in ("base_x", "base_y")]
        dx = F.when(on_plane, mapped[0] - base[0]).otherwise(dx)
        dy = F.when(on_plane, mapped[1] - base[1]).otherwise(dy)
    rows = rows.withColumns({"_dx": dx, "_dy": dy})
    ca, sa = cal["ca"], cal["sa"]
    turned = placed(cal)
    wx = F.when(turned, F.col("_dx") * ca + F.col("_dy") * sa).otherwise(F.col("_dx"))
    wy = F.when(turned, F.col("_dy") * ca - F.col("_dx") * sa).otherwise(F.col("_dy"))
    if planar:
        lost = on_plane & F.col("_dx").isNull()
        wx, wy = F.when(lost, F.lit(0.0)).otherwise(wx), F.when(lost, F.lit(0.0)).otherwise(wy)
    return rows.withColumns({out[0]: wx, out[1]: wy}).drop("_k", "_dx", "_dy")


@F.pandas_udf(DoubleType())
def _along(
    dist: pd.Series, hi: pd.Series, ox: pd.Series, oy: pd.Series, ux: pd.Series, uy: pd.Series, nx: pd.Series, ny: pd.Series,
    ax: pd.Series, ay: pd.Series, n_ppm: pd.Series, f_ppm: pd.Series, ppm_o: pd.Series, rounds: pd.Series,
) -> pd.Series:
    """Image distance from the origin of points at world distance ``dist``, halved over the batch; nan without one."""
    out = np.full(len(dist), np.nan)
    at = np.flatnonzero(dist.notna().to_numpy())
    if not len(at):
        return pd.Series(out)
    columns = (dist, hi, ox, oy, ux, uy, nx, ny, ax, ay, n_ppm, f_ppm, ppm_o)
    d, top, ox, oy, ux, uy, nx, ny, ax, ay, near, far, ppm_o = (c.to_numpy(float)[at] for c in columns)
    low = np.zeros(len(at))
    with np.errstate(all="ignore"):
        for _ in range(int(rounds.iloc[0])):
            mid = (low + top) * 0.5
            u = (ox + ux * mid - nx) * ax + (oy + uy * mid - ny) * ay
            scale = near + np.clip(u, -C.EXTRAPOLATE_U, 1.0 + C.EXTRAPOLATE_U) * (far - near)
            ppm = np.maximum(np.where(scale <= 1e-9, np.minimum(near, far), scale), 1e-6)
            delta = ppm - ppm_o
            flat = np.abs(delta) < 1e-9
            mean = np.where(flat, 1.0 / ppm_o, np.log(ppm / ppm_o) / np.where(flat, 1.0, delta))
            short = mid * mean < d
            low, top = np.where(short, mid, low), np.where(short, top, mid)
    out[at] = (low + top) * 0.5
    return pd.Series(out)


def world_to_pixel(df: DataFrame, x: str, y: str, out: tuple[str, str], *, planar: bool = True, rounds: int = 40) -> DataFrame:
    """Add the image point of world position (x, y); near/far scaling is inverted by bisection."""
    cal, wx, wy = F.col("cal"), F.col(x), F.col(y)
    ox, oy = _origin(cal)
    ca, sa, turned = cal["ca"], cal["sa"], placed(cal)
    rows = df.withColumns(
        {
            "_rx": F.when(turned, wx * ca - wy * sa).otherwise(wx),
            "_ry": F.when(turned, wx * sa + wy * ca).otherwise(wy),
        }
    )
    flip = F.when(F.coalesce(cal["y_up"], F.lit(True)), F.lit(-1.0)).otherwise(F.lit(1.0))
    rows = rows.withColumns({"_dx": F.col("_rx"), "_dy": flip * F.col("_ry"), "_d": F.hypot("_rx", "_ry"), "_ox": ox, "_oy": oy})
    dist = F.col("_d")
    rows = rows.withColumns({"_ux": P.guarded(F.col("_dx"), dist), "_uy": P.guarded(F.col("_dy"), dist)})
    first = F.greatest(dist * cal["ppm_o"] * 4.0, F.lit(8.0))
    searched = is_mode(cal, "near_far") & (dist >= 1e-12)
    given = {"dist": dist, "hi": first, "ox": F.col("_ox"), "oy": F.col("_oy"), "ux": F.col("_ux"), "uy": F.col("_uy"), **{n: cal[n] for n in ("nx", "ny", "ax", "ay", "n_ppm", "f_ppm", "ppm_o")}}
    found = _along(*[F.when(searched, v.cast("double")).alias(n) for n, v in given.items()], F.lit(rounds))
    rows = rows.withColumn("_e", found)
    along = F.coalesce(F.nanvl("_e", F.lit(None).cast("double")), F.lit(0.0))
    ppm = F.coalesce(cal["ppm"], F.lit(1.0))

    def flat(o: str, unit: str, d: str) -> Column:
        return (
            F.when(is_mode(cal, "uniform"), F.col(o) + F.col(d) * ppm)
            .when(is_mode(cal, "near_far"), F.col(o) + F.coalesce(F.col(unit) * along, F.lit(0.0)))
            .otherwise(F.col(o) + F.col(d))
        )

    fx, fy = flat("_ox", "_ux", "_dx"), flat("_oy", "_uy", "_dy")
    if planar:
        base = [F.when(turned, cal[n]).otherwise(F.lit(0.0)) for n in ("base_x", "base_y")]
        rows = rows.withColumns({"_bx": F.col("_rx") + base[0], "_by": F.col("_ry") + base[1]})
        qx, qy = plane_to_pixel(cal, F.col("_bx"), F.col("_by"))
        fx, fy = F.when(is_mode(cal, "planar"), qx).otherwise(fx), F.when(is_mode(cal, "planar"), qy).otherwise(fy)
    rows = rows.withColumns({out[0]: fx, out[1]: fy})
    return rows.drop("_rx", "_ry", "_dx", "_dy", "_d", "_ox", "_oy", "_ux", "_uy", "_e", "_bx", "_by")


def plane_to_pixel(cal: Column, x: Column, y: Column) -> tuple[Column, Column]:
    mx, my = P.apply_h(cal["hi"], x, y)
    u, v = P.distort(mx, my, cal["camera"])
    return F.when(mx.isNull(), F.lit(0.0)).otherwise(u), F.when(mx.isNull(), F.lit(0.0)).otherwise(v)


def display_xy(df: DataFrame, x: str, y: str, out: tuple[str, str], *, planar: bool = True) -> DataFrame:
    """Analysis coordinates: mapped when calibrated or an origin is placed, else image y flipped."""
    cal = F.col("cal")
    rows = pixel_to_world(df, x, y, ("_wx", "_wy"), planar=planar)
    mapped = active(cal) | placed(cal)
    up = F.coalesce(cal["y_up"], F.lit(True))
    return rows.withColumns(
        {
            out[0]: F.when(mapped, F.col("_wx")).otherwise(F.col(x)),
            out[1]: F.when(mapped, F.col("_wy")).when(up, -F.col(y)).otherwise(F.col(y)),
        }
    ).drop("_wx", "_wy")


def measurement_source(cal: Column, beyond: Column) -> Column:
    return (
        F.when(~active(cal), "pixel")
        .when(beyond, "extrapolated")
        .when(is_mode(cal, "planar"), "geometric")
        .otherwise("scaled")
    )


def record_quality(cal: Column) -> Column:
    """Weight of the calibration in candidate confidence."""
    return F.when(~active(cal), F.lit(0.4)).when(F.coalesce(cal["warning"], F.lit("")) != "", F.lit(0.7)).otherwise(F.lit(1.0))


def record_label(cal: Column) -> Column:
    planar = F.concat_ws(
        " / ",
        F.lit("motion plane"),
        F.when(~P.camera_ready(cal["camera"]), "lens not corrected"),
        F.when(cal["rms"] > C.WARN_REPROJ_RMS_PX, F.format_string("reprojection %.2f px", cal["rms"])),
        F.when(cal["camera_moved"], "camera may have moved"),
    )
    return (
        F.when(is_mode(cal, "planar"), planar)
        .when(is_mode(cal, "near_far"), "near and far rulers")
        .when(is_mode(cal, "uniform"), "single ruler")
        .otherwise("uncalibrated")
    )


def grid_lines(cal: Column, nx: int = 4, ny: int = 4) -> Column:
    """Segments of the metre grid in image pixels; empty outside planar mode."""
    nx, ny = max(nx, 1), max(ny, 1)
    w, h = F.greatest(cal["width_m"], F.lit(1e-9)), F.greatest(cal["height_m"], F.lit(1e-9))
    zero = F.lit(0.0)

    def ends(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        mapped = [*P.apply_h(cal["hi"], x0, y0), *P.apply_h(cal["hi"], x1, y1)]
        return F.struct(*[F.coalesce(m, F.lit(0.0)).alias(n) for m, n in zip(mapped, ("x0", "y0", "x1", "y1"))])

    upright = F.transform(F.sequence(F.lit(0), F.lit(nx)), lambda i: ends(w * i / nx, zero, w * i / nx, h))
    level = F.transform(F.sequence(F.lit(0), F.lit(ny)), lambda j: ends(zero, h * j / ny, w, h * j / ny))

    def bent(s: Column) -> Column:
        a, b = P.distort(s["x0"], s["y0"], cal["camera"]), P.distort(s["x1"], s["y1"], cal["camera"])
        return F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"))

    lines = F.transform(F.concat(upright, level), bent)
    return F.when(is_mode(cal, "planar"), lines).otherwise(F.slice(lines, 1, 0))


def migrate_for_shake(dim: DataFrame, dx: Column, dy: Column, invalidate_px: float = 8.0) -> DataFrame:
    """Move raw records drawn before stabilisation by the first frame's offset."""
    moved = (F.abs(dx) >= 1e-9) | (F.abs(dy) >= 1e-9)
    moved = F.coalesce(moved, F.lit(False))
    sx, sy = F.when(moved, dx).otherwise(F.lit(0.0)), F.when(moved, dy).otherwise(F.lit(0.0))
    shift = lambda p: F.struct((p["x"] - sx).alias("x"), (p["y"] - sy).alias("y"))
    big = moved & (F.col("mode") == "planar") & (F.sqrt(sx * sx + sy * sy) >= invalidate_px)
    plane = F.col("plane").withField("corners", F.transform("plane.corners", shift))
    return dim.withColumns(
        {
            "rulers": F.transform("rulers", lambda r: r.withField("a", shift(r["a"])).withField("b", shift(r["b"]))),
            "plane": F.when(F.col("plane").isNotNull(), plane),
            "frame": F.col("frame").withField("origin_x", F.col("frame.origin_x") - sx).withField("origin_y", F.col("frame.origin_y") - sy),
            "camera_moved": F.coalesce("camera_moved", F.lit(False)) | big,
        }
    )


def uniform_record(a: Column, b: Column, length_m: Column, origin: Column | None = None, angle: Column | None = None) -> dict[str, Column]:
    """Raw record columns for one ruler; the axis follows the ruler unless ``angle`` is given."""
    ruler = F.struct(a.alias("a"), b.alias("b"), length_m.cast("double").alias("length_m"), F.lit("single").alias("role"))
    return _record("uniform", F.array(ruler), ruler_angle(ruler) if angle is None else angle, origin)


def near_far_record(near: Column, far: Column, origin: Column | None = None, angle: Column | None = None) -> dict[str, Column]:
    near = near.withField("role", F.lit("near"))
    far = far.withField("role", F.lit("far"))
    return _record("near_far", F.array(near, far), ruler_angle(near) if angle is None else angle, origin)


def planar_record(corners: Column, width_m: Column, height_m: Column, origin: Column | None = None, angle: Column | None = None, y_up: bool = True) -> dict[str, Column]:
    plane = F.struct(corners.alias("corners"), width_m.cast("double").alias("width_m"), height_m.cast("double").alias("height_m"))
    out = _record("planar", None, F.lit(0.0) if angle is None else angle, origin, y_up)
    out["plane"] = plane
    return out


RULER_TYPE = "array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,length_m:double,role:string>>"
PLANE_TYPE = "struct<corners:array<struct<x:double,y:double>>,width_m:double,height_m:double>"
CAMERA_TYPE = "struct<width:int,height:int,fx:double,fy:double,cx:double,cy:double,k1:double,k2:double,p1:double,p2:double,k3:double>"


def _record(mode: str, rulers: Column | None, angle: Column, origin: Column | None, y_up: bool = True) -> dict[str, Column]:
    return {
        "mode": F.lit(mode),
        "rulers": (F.array() if rulers is None else rulers).cast(RULER_TYPE),
        "frame": F.struct(
            (dlit(None) if origin is None else origin["x"]).alias("origin_x"),
            (dlit(None) if origin is None else origin["y"]).alias("origin_y"),
            angle.cast("double").alias("axis_angle_deg"),
            F.lit(y_up).alias("y_up"),
        ),
        "plane": F.lit(None).cast(PLANE_TYPE),
        "camera": F.lit(None).cast(CAMERA_TYPE),
        "camera_moved": F.lit(False),
        "pixel_sigma": dlit(C.DEFAULT_PIXEL_SIGMA),
    }
