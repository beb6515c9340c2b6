"""Queries on calibration records, point mapping and the full kinematic series."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import calibration as cal_fn
from ..functions import geometry as G
from ..functions import quality
from ..operators import depth as D
from ..operators import kinematics as K
from ..operators.joins import attach
from ..session import stored
from ..sinks.track_csv import csv_rows
from . import views as V
from .registry import r, register, rounded
from .sql_views import velocity_ctes, with_ctes

KEY = V.KEY

# --- the same records in SQL ------------------------------------------------------------------

LENS = "clip_id % 8 = 7"
CORNERS = """SELECT clip_id, c AS tag, 0 AS id, CAST(CASE c WHEN 0 THEN 0 WHEN 1 THEN 100 + clip_id % 20 WHEN 2 THEN 95 + clip_id % 10 ELSE 5 END AS DOUBLE) AS u,
  CAST(CASE c WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 110 ELSE 100 + clip_id % 9 END AS DOUBLE) AS v FROM users, range(4) g(c) WHERE clip_id % 4 = 3"""


def undistort_ctes(src: str) -> list[tuple[str, str]]:
    """``und``: rows of ``src`` (clip_id, tag, id, u, v) with lens-corrected uu, vv."""
    steps = [("u0", f"SELECT *, (u - 160e0) / 400e0 AS x0, (v - 120e0) / 410e0 AS y0, (u - 160e0) / 400e0 AS x, (v - 120e0) / 410e0 AS y FROM {src}")]
    rad = "(1e0 - 0.1e0 * (x*x+y*y) + 0.01e0 * (x*x+y*y) * (x*x+y*y))"
    for i in range(10):
        steps.append((f"u{i + 1}a", f"SELECT *, x AS px, (x0 - 2e0 * 0.001e0 * x * y + 0.002e0 * ((x*x+y*y) + 2e0 * x * x)) / {rad} AS nx, {rad} AS rd, x*x+y*y AS r2 FROM u{i}"))
        steps.append((f"u{i + 1}", f"SELECT clip_id, tag, id, u, v, x0, y0, nx AS x, (y0 - 0.001e0 * (r2 + 2e0 * y * y) + 2e0 * 0.002e0 * nx * y) / rd AS y FROM u{i + 1}a"))
    steps.append(("und", f"SELECT clip_id, tag, id, u, v, CASE WHEN {LENS} THEN 400e0 * x + 160e0 ELSE u END AS uu, CASE WHEN {LENS} THEN 410e0 * y + 120e0 ELSE v END AS vv FROM u10"))
    return steps


def _h(name: str, x: str, y: str, row: int) -> str:
    m = [f"{name}{i}" for i in range(9)]
    return f"({m[3 * row]} * {x} + {m[3 * row + 1]} * {y} + {m[3 * row + 2]}) / ({m[6]} * {x} + {m[7]} * {y} + {m[8]})"


def record_ctes(points: str | None) -> list[tuple[str, str]]:
    """``rec``: one row per user with homographies m0..m8 (pixel->metre) and g0..g8; ``und`` for points."""
    src = CORNERS + " UNION ALL SELECT clip_id, 9, 0, 10e0, 20e0 FROM users WHERE clip_id % 4 = 3"
    if points:
        src += f" UNION ALL SELECT clip_id, 5, frame, x, y FROM {points} WHERE clip_id % 4 = 3"
    c = lambda i, a: f"max(CASE WHEN tag = {i} THEN {a} END)"
    corner = ", ".join(f"{c(i, a)} AS {n}{i}" for i in range(4) for a, n in (("uu", "x"), ("vv", "y")))
    inv = ["(g4*g8-g5*g7)", "(g2*g7-g1*g8)", "(g1*g5-g2*g4)", "(g5*g6-g3*g8)", "(g0*g8-g2*g6)", "(g2*g3-g0*g5)", "(g3*g7-g4*g6)", "(g1*g6-g0*g7)", "(g0*g4-g1*g3)"]
    return [
        ("users", "SELECT DISTINCT user_id AS clip_id FROM events"),
        ("toun", src),
        *undistort_ctes("toun"),
        ("qd", f"SELECT clip_id, {corner}, {c(9, 'uu')} AS ou, {c(9, 'vv')} AS ov FROM und WHERE tag <> 5 GROUP BY clip_id"),
        ("q1", "SELECT *, x1-x2 AS e1, y1-y2 AS e2, x3-x2 AS e3, y3-y2 AS e4, x0-x1+x2-x3 AS e5, y0-y1+y2-y3 AS e6 FROM qd"),
        ("q2", "SELECT *, (e5*e4-e3*e6)/(e1*e4-e3*e2) AS p, (e1*e6-e5*e2)/(e1*e4-e3*e2) AS q FROM q1"),
        ("q3", "SELECT *, (x1-x0+p*x1)/2e0 AS g0, (x3-x0+q*x3)/1.5e0 AS g1, x0 AS g2, (y1-y0+p*y1)/2e0 AS g3, (y3-y0+q*y3)/1.5e0 AS g4, y0 AS g5, p/2e0 AS g6, q/1.5e0 AS g7, 1e0 AS g8 FROM q2"),
        ("q4", "SELECT *, " + ", ".join(f"{v}/{inv[8]} AS m{i}" for i, v in enumerate(inv)) + " FROM q3"),
        ("rec", f"""SELECT u.clip_id, u.clip_id % 3 = 0 AS placed, radians(u.clip_id % 90) AS ang, sqrt((50 + u.clip_id % 50)**2 + (u.clip_id % 7)**2) AS ppm,
          60e0 + u.clip_id % 20 AS np, sqrt((30 + u.clip_id % 15)**2 + (u.clip_id % 5)**2) AS fp, (60 + u.clip_id % 20) / 2e0 AS nx, 0e0 AS ny, (50 + u.clip_id % 15) / 2e0 AS fx, (160 + u.clip_id % 5) / 2e0 AS fy,
          CASE WHEN u.clip_id % 3 = 0 THEN 10e0 ELSE 0e0 END AS ox, CASE WHEN u.clip_id % 3 = 0 THEN 20e0 ELSE 0e0 END AS oy, {', '.join(f'm{i}' for i in range(9))}, {', '.join(f'g{i}' for i in range(9))},
          CASE WHEN u.clip_id % 3 = 0 THEN {_h('m', 'ou', 'ov', 0)} ELSE 0e0 END AS bas_x, CASE WHEN u.clip_id % 3 = 0 THEN {_h('m', 'ou', 'ov', 1)} ELSE 0e0 END AS bas_y,
          ['none', 'uniform', 'near_far', 'planar'][u.clip_id % 4 + 1] AS mode FROM users u LEFT JOIN q4 USING (clip_id)"""),
    ]


def _ppm(x: str, y: str) -> str:
    u = f"greatest(-0.35, least(1.35, (({x} - nx)*(fx-nx) + ({y} - ny)*(fy-ny)) / ((fx-nx)**2 + (fy-ny)**2)))"
    raw = f"(np + {u}*(fp-np))"
    return f"greatest(CASE WHEN {raw} <= 1e-9 THEN least(np, fp) ELSE {raw} END, 1e-6)"


def world_ctes(points: str) -> list[tuple[str, str]]:
    """``world``: rows of ``points`` with record columns and world position wx, wy."""
    return [
        *record_ctes(points),
        ("w0", f"SELECT p.*, r.* EXCLUDE (clip_id), {_ppm('ox', 'oy')} AS k0, {_ppm('p.x', 'p.y')} AS k1, n.uu, n.vv FROM {points} p JOIN rec r USING (clip_id) LEFT JOIN und n ON n.tag = 5 AND n.clip_id = p.clip_id AND n.id = p.frame"),
        ("w1", "SELECT *, CASE mode WHEN 'uniform' THEN 1 / ppm WHEN 'near_far' THEN CASE WHEN abs(k1-k0) < 1e-9 THEN 1 / k0 ELSE ln(k1/k0) / (k1-k0) END ELSE 1e0 END AS sc FROM w0"),
        ("w2", f"SELECT *, CASE WHEN mode = 'planar' THEN {_h('m', 'uu', 'vv', 0)} - bas_x ELSE (x - ox)*sc END AS dx, CASE WHEN mode = 'planar' THEN {_h('m', 'uu', 'vv', 1)} - bas_y ELSE -(y - oy)*sc END AS dy FROM w1"),
        ("world", "SELECT *, CASE WHEN placed THEN dx*cos(ang) + dy*sin(ang) ELSE dx END AS wx, CASE WHEN placed THEN dy*cos(ang) - dx*sin(ang) ELSE dy END AS wy FROM w2"),
    ]


def _mapped(spark, sf_dir):
    points = attach(V.event_points(spark, sf_dir), V.calibrations(spark, sf_dir), KEY)
    return cal_fn.pixel_to_world(points, "x", "y", ("wx", "wy"))


@register(
    "calibration_records",
    with_ctes(
        """SELECT clip_id, mode, mode <> 'none' AS active, CASE WHEN mode <> 'planar' THEN '' ELSE concat_ws(';', CASE WHEN clip_id % 8 <> 7 THEN 'no_intrinsics' END, CASE WHEN clip_id % 16 = 3 THEN 'camera_moved' END) END AS warning,
        round(CASE mode WHEN 'uniform' THEN ppm END, 6) AS ppm, round(CASE mode WHEN 'near_far' THEN np END, 6) AS near_ppm, round(CASE mode WHEN 'near_far' THEN fp END, 6) AS far_ppm,
        round(m0, 6) + 0.0 AS h0, round(m5, 6) + 0.0 AS h5, round(m7, 6) + 0.0 AS h7 FROM rec""",
        *record_ctes(None),
    ),
)
def calibration_records(spark, sf_dir):
    c = V.calibrations(spark, sf_dir).select("clip_id", "cal.*")
    is_mode = lambda m, v: F.when(F.col("mode") == m, F.col(v))
    return c.select(
        "clip_id", "mode", "active", "warning", r(is_mode("uniform", "ppm")).alias("ppm"), r(is_mode("near_far", "n_ppm")).alias("near_ppm"),
        r(is_mode("near_far", "f_ppm")).alias("far_ppm"), *[r(F.col(f"h.{n}")).alias(n) for n in ("h0", "h5", "h7")],
    )


@register("pixel_to_world", with_ctes("SELECT clip_id, frame, round(wx, 6) + 0.0 AS wx, round(wy, 6) + 0.0 AS wy FROM world", "pt", *world_ctes("pt")))
def pixel_to_world(spark, sf_dir):
    return rounded(_mapped(spark, sf_dir).select("clip_id", "frame", "wx", "wy"), "wx", "wy")


@register("world_to_pixel", with_ctes("SELECT clip_id, frame, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM pt", "pt"))
def world_to_pixel(spark, sf_dir):
    """Round trip through the world frame; the answer is the point itself."""
    back = cal_fn.world_to_pixel(_mapped(spark, sf_dir), "wx", "wy", ("bx", "by"))
    return back.select("clip_id", "frame", r("bx", 3).alias("x"), r("by", 3).alias("y"))


SIGMA = [
    ("j", f"""SELECT *, ({_h('m', '(uu + 0.25e0)', 'vv', 0)} - {_h('m', 'uu', 'vv', 0)}) / 0.25e0 AS jxu, ({_h('m', 'uu', '(vv + 0.25e0)', 0)} - {_h('m', 'uu', 'vv', 0)}) / 0.25e0 AS jxv,
      ({_h('m', '(uu + 0.25e0)', 'vv', 1)} - {_h('m', 'uu', 'vv', 1)}) / 0.25e0 AS jyu, ({_h('m', 'uu', '(vv + 0.25e0)', 1)} - {_h('m', 'uu', 'vv', 1)}) / 0.25e0 AS jyv FROM world"""),
    ("sg", "SELECT *, sqrt(jxu**2 + jxv**2) AS s1, sqrt(jyu**2 + jyv**2) AS s2 FROM j"),
]


@register(
    "pixels_per_meter",
    with_ctes(
        "SELECT clip_id, frame, round(CASE mode WHEN 'uniform' THEN ppm WHEN 'near_far' THEN k1 WHEN 'planar' THEN 1 / sqrt(s1**2 + s2**2) END, 4) AS ppm FROM sg", "pt", *world_ctes("pt"), *SIGMA,
    ),
)
def pixels_per_meter(spark, sf_dir):
    points = attach(V.event_points(spark, sf_dir), V.calibrations(spark, sf_dir), KEY)
    return cal_fn.ppm_at(points, "x", "y", "ppm").select("clip_id", "frame", r("ppm", 4).alias("ppm"))


def _edge(i: int) -> str:
    xs = ["0", "(100 + clip_id % 20)", "(95 + clip_id % 10)", "5"]
    ys = ["0", "5", "110", "(100 + clip_id % 9)"]
    j = (i + 1) % 4
    return f"(({xs[j]} - {xs[i]}) * (y - {ys[i]}) - ({ys[j]} - {ys[i]}) * (x - {xs[i]}))"


EXTRA = f"""CASE mode WHEN 'planar' THEN NOT ({' AND '.join(f'{_edge(i)} <= 1e-9' for i in range(4))} OR {' AND '.join(f'{_edge(i)} >= -1e-9' for i in range(4))})
  WHEN 'near_far' THEN ((x-nx)*(fx-nx) + (y-ny)*(fy-ny)) / ((fx-nx)**2 + (fy-ny)**2) NOT BETWEEN -1e-6 AND 1.000001 ELSE FALSE END"""

SERIES = [
    *world_ctes("pt"),
    *SIGMA,
    ("disp", f"""SELECT clip_id, frame, time_s, CASE WHEN visible THEN CASE WHEN mode <> 'none' OR placed THEN wx ELSE x END END AS x, CASE WHEN visible THEN CASE WHEN mode <> 'none' OR placed THEN wy ELSE -y END END AS y,
      visible, confidence, manual, mode, visible AND {EXTRA} AS extra, CASE WHEN visible AND mode = 'planar' THEN 0.5e0 * s1 END AS sigma_x, CASE WHEN visible AND mode = 'planar' THEN 0.5e0 * s2 END AS sigma_y,
      CASE WHEN event_id % 8 = 0 THEN (event_id % 50) / 1000e0 END AS res FROM sg"""),
    *velocity_ctes("disp", 3),
    ("full", """SELECT *, visible AND coalesce(res > 0.03, FALSE) AS off, CASE WHEN NOT visible OR mode = 'none' THEN 'pixel' WHEN extra THEN 'extrapolated' WHEN mode = 'planar' THEN 'geometric' ELSE 'scaled' END AS source FROM samples"""),
]


def _full(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    return K.series(points, KEY, calibration=V.calibrations(spark, sf_dir), depth=V.depth_readings(points))


@register(
    "kinematic_series_calibrated",
    with_ctes(
        """SELECT clip_id, frame, round(time_s, 6) AS time_s, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(vx, 9) + 0.0 AS vx, round(vy, 9) + 0.0 AS vy, round(speed, 9) AS speed, visible, confidence, manual,
        CASE WHEN mode = 'none' THEN 'px' ELSE 'm' END AS position_unit, CASE WHEN mode = 'none' THEN 'px/s' ELSE 'm/s' END AS speed_unit, round(sigma_x, 6) AS sigma_x, round(sigma_y, 6) AS sigma_y,
        concat_ws(',', CASE WHEN extra THEN 'extrapolated' END, CASE WHEN off THEN 'off_plane' END) AS quality_flags, CASE WHEN visible THEN res END AS off_plane_m, source FROM full""".replace("FROM full", "FROM \"full\""),
        "pt", *[(f'"{n}"' if n == "full" else n, b) for n, b in SERIES],
    ),
)
def kinematic_series_calibrated(spark, sf_dir):
    s = _full(spark, sf_dir)
    return rounded(s, "vx", "vy", "speed", digits=9).withColumns(
        {**{n: r(n) for n in ("time_s", "x", "y", "sigma_x", "sigma_y")}, "quality_flags": F.concat_ws(",", "quality_flags")}
    ).drop("tile")


@register(
    "sample_quality",
    with_ctes(
        """SELECT clip_id, CASE WHEN off THEN 'off plane' WHEN extra THEN 'extrapolated' WHEN source = 'geometric' THEN 'geometric' WHEN source = 'scaled' THEN 'ruler' ELSE 'pixel' END AS label,
        (visible AND confidence < 0.6) OR extra OR off AS low_confidence, count(*) AS n FROM "full" GROUP BY ALL""",
        "pt", *[(f'"{n}"' if n == "full" else n, b) for n, b in SERIES],
    ),
)
def sample_quality(spark, sf_dir):
    s = _full(spark, sf_dir)
    return s.groupBy(
        "clip_id", quality.label(F.col("quality_flags"), F.col("source")).alias("label"),
        quality.low_confidence(F.col("visible"), F.col("confidence"), F.col("quality_flags")).alias("low_confidence"),
    ).agg(F.count(F.lit(1)).alias("n"))


@register(
    "track_csv",
    with_ctes(
        """SELECT clip_id, CASE WHEN mode = 'none' THEN 'px' ELSE 'm' END AS unit, frame, printf('%.6f', time_s) AS time_s, coalesce(printf('%.4f', round(x, 4) + 0.0), '') AS x, coalesce(printf('%.4f', round(y, 4) + 0.0), '') AS y,
        CAST(visible AS INT) AS visible, printf('%.4f', confidence) AS confidence, coalesce(printf('%.6f', round(sigma_x, 6)), '') AS sigma_x,
        CASE WHEN off THEN 'off plane' WHEN extra THEN 'extrapolated' WHEN source = 'geometric' THEN 'geometric' WHEN source = 'scaled' THEN 'ruler' ELSE 'pixel' END AS quality,
        coalesce(printf('%.6f', CASE WHEN visible THEN res END), '') AS off_plane_m, source FROM "full" """,
        "pt", *[(f'"{n}"' if n == "full" else n, b) for n, b in SERIES],
    ),
)
def track_csv(spark, sf_dir):
    rows = csv_rows(_full(spark, sf_dir), KEY)
    return rows.select("clip_id", "unit", "frame", "time_s", "x", "y", "visible", "confidence", "sigma_x", "quality", "off_plane_m", "source")


def _bent(u: str, v: str, axis: int) -> str:
    """Lens distortion of an image point of the records that have a lens."""
    x, y = f"(({u} - 160e0) / 400e0)", f"(({v} - 120e0) / 410e0)"
    r2 = f"({x}*{x} + {y}*{y})"
    radial = f"(1e0 - 0.1e0 * {r2} + 0.01e0 * {r2} * {r2})"
    moved = (
        f"400e0 * ({x} * {radial} + 2e0 * 0.001e0 * {x} * {y} - 0.002e0 * ({r2} + 2e0 * {x} * {x})) + 160e0",
        f"410e0 * ({y} * {radial} + 0.001e0 * ({r2} + 2e0 * {y} * {y}) - 2e0 * 0.002e0 * {x} * {y}) + 120e0",
    )[axis]
    return f"(CASE WHEN {LENS} THEN {moved} ELSE {(u, v)[axis]} END)"


@register(
    "grid_lines",
    with_ctes(
        f"""SELECT clip_id, CAST(i AS INT) AS line, round({_bent('x0', 'y0', 0)}, 5) + 0.0 AS x0, round({_bent('x0', 'y0', 1)}, 5) + 0.0 AS y0, round({_bent('x1', 'y1', 0)}, 5) + 0.0 AS x1, round({_bent('x1', 'y1', 1)}, 5) + 0.0 AS y1 FROM (
        SELECT clip_id, i, {_h('g', 'ax', 'ay', 0)} AS x0, {_h('g', 'ax', 'ay', 1)} AS y0, {_h('g', 'bx_', 'by_', 0)} AS x1, {_h('g', 'bx_', 'by_', 1)} AS y1 FROM
        (SELECT r.*, i, CASE WHEN i < 5 THEN 0.5e0 * i ELSE 0e0 END AS ax, CASE WHEN i < 5 THEN 0e0 ELSE 0.375e0 * (i - 5) END AS ay, CASE WHEN i < 5 THEN 0.5e0 * i ELSE 2e0 END AS bx_, CASE WHEN i < 5 THEN 1.5e0 ELSE 0.375e0 * (i - 5) END AS by_
        FROM rec r, range(10) g(i) WHERE mode = 'planar'))""",
        *record_ctes(None),
    ),
)
def grid_lines(spark, sf_dir):
    """Metre grid of planar records; with a lens its ends are distorted."""
    c = V.calibrations(spark, sf_dir)
    lines = c.select("clip_id", F.posexplode(cal_fn.grid_lines(F.col("cal"))).alias("line", "l")).select("clip_id", "line", "l.*")
    return rounded(lines, "x0", "y0", "x1", "y1", digits=5)


POSED = [
    ("po0", f"""SELECT clip_id, CASE WHEN {LENS} THEN 400e0 ELSE 1280e0 END AS fx, CASE WHEN {LENS} THEN 410e0 ELSE 1280e0 END AS fy, CASE WHEN {LENS} THEN 160e0 ELSE 640e0 END AS px,
      CASE WHEN {LENS} THEN 120e0 ELSE 360e0 END AS py, g0, g1, g2, g3, g4, g5, g6, g7, g8 FROM rec WHERE mode = 'planar'"""),
    ("po1", "SELECT *, (g0 - px*g6)/fx AS a0, (g3 - py*g6)/fy AS a1, g6 AS a2, (g1 - px*g7)/fx AS b0, (g4 - py*g7)/fy AS b1, g7 AS b2, g8 AS t2 FROM po0"),
    ("po2", "SELECT clip_id, a0/l AS a0, a1/l AS a1, a2/l AS a2, b0/l AS b0, b1/l AS b1, b2/l AS b2, t2/l AS t2 FROM (SELECT *, sqrt(a0*a0 + a1*a1 + a2*a2) AS l FROM po1)"),
    ("po3", "SELECT *, a0*a0 + a1*a1 + a2*a2 AS p, a0*b0 + a1*b1 + a2*b2 AS q, b0*b0 + b1*b1 + b2*b2 AS r FROM po2"),
    ("po4", "SELECT *, sqrt(p*r - q*q) AS d FROM po3"),
    ("pose", "SELECT clip_id, sign(t2) * (a2*(r + d) - b2*q) / (d*sqrt(p + r + 2*d)) AS r20, sign(t2) * (b2*(p + d) - a2*q) / (d*sqrt(p + r + 2*d)) AS r21, abs(t2) AS tz FROM po4"),
    ("deep", "SELECT w.*, CASE WHEN r20*wx + r21*wy + tz > 1e-6 THEN r20*wx + r21*wy + tz END AS z FROM world w LEFT JOIN pose USING (clip_id)"),
]


@register("expected_depth", with_ctes("SELECT clip_id, frame, round(z, 6) AS z_geom FROM deep", "pt", *world_ctes("pt"), *POSED))
def expected_depth(spark, sf_dir):
    posed = D.with_pose(stored(V.calibrations(spark, sf_dir)), KEY)
    return D.expected_depth(V.event_points(spark, sf_dir), posed.filter("cal.mode = 'planar'"), KEY).select("clip_id", "frame", r("z_geom").alias("z_geom"))


@register(
    "depth_audit",
    with_ctes(
        """SELECT clip_id, frame, round(z, 6) AS z_geom, round(zm, 6) AS z_model, round(abs(zm - z), 6) AS residual_m, round(coalesce(greatest(0, least(1, 1 - abs(zm - z) / (3 * lim))), 0), 6) AS confidence,
        CASE WHEN zm - z IS NULL THEN 'skipped' WHEN abs(zm - z) > lim THEN 'off_plane' ELSE 'ok' END AS flag, round(lim, 6) AS limit_m
        FROM (SELECT *, CASE WHEN event_id % 9 <> 0 THEN z + (event_id % 21 - 10) * 0.02e0 END AS zm, greatest(%ALLOWED%, 2 * %SHARE%) AS lim, min(frame) OVER c AS fa, max(frame) OVER c AS fz
          FROM deep WHERE visible AND mode = 'planar' WINDOW c AS (PARTITION BY clip_id)) WHERE frame IN (fa, fz) OR confidence < 0.6 OR frame % 8 = 0""".replace("%ALLOWED%", f"{C.OFF_PLANE_WARN_M}e0").replace("%SHARE%", f"{C.OFF_PLANE_RATIO}e0"),
        "pt", *world_ctes("pt"), *POSED,
    ),
)
def depth_audit(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    posed = D.with_pose(stored(V.calibrations(spark, sf_dir)), KEY)
    seen = D.expected_depth(points, posed, KEY)
    i = F.col("event_id")
    model = seen.filter(i % 9 != 0).select("clip_id", "frame", (F.col("z_geom") + (i % 21 - 10) * 0.02).alias("z_model"))
    return rounded(D.audit_track(points, posed, model, KEY), "z_geom", "z_model", "residual_m", "confidence", "limit_m")


@register(
    "audit_frames",
    with_ctes(
        """SELECT clip_id, frame FROM (SELECT *, min(frame) OVER w AS a, max(frame) OVER w AS z FROM pt WHERE visible WINDOW w AS (PARTITION BY clip_id)) WHERE frame IN (a, z) OR confidence < 0.6 OR frame % 8 = 0""", "pt",
    ),
)
def audit_frames(spark, sf_dir):
    return D.select_audit_frames(V.event_points(spark, sf_dir), KEY).select("clip_id", "frame")


@register(
    "robust_center_depth",
    """WITH cells AS (SELECT vec_id, abs(CAST(embedding[i + 1] AS DOUBLE)) * 10 AS z FROM embeddings, range(64) g(i) WHERE i % 8 BETWEEN CAST(vec_id % 8 AS INT) - 4 AND vec_id % 8 + 4 AND i // 8 BETWEEN CAST((vec_id // 8) % 8 AS INT) - 4 AND (vec_id // 8) % 8 + 4),
    q AS (SELECT vec_id, quantile_cont(z, 0.2) AS lo, quantile_cont(z, 0.8) AS hi, count(*) AS n FROM cells WHERE z > 1e-4 GROUP BY vec_id)
    SELECT c.vec_id, round(median(z), 6) AS depth FROM cells c JOIN q USING (vec_id) WHERE z > 1e-4 AND z >= lo AND z <= hi AND n >= 3 GROUP BY c.vec_id""",
)
def robust_center_depth(spark, sf_dir):
    v = F.col("vec_id")
    e = V.table(spark, sf_dir, "embeddings").withColumn("map", F.transform("embedding", lambda z: F.abs(z.cast("double")) * 10))
    rows = D.robust_center_depth(e, "map", 8, 8, (v % 8).cast("double"), (F.floor(v / 8) % 8).cast("double"), "depth")
    return rows.select("vec_id", r("depth").alias("depth"))


@register(
    "axis_geometry",
    """SELECT o_orderkey, round(degrees(atan2(-(y - 50), x - 60)), 6) + 0.0 AS pointer, CAST((floor(a / 90e0 + 0.5e0) * 90) % 360 AS DOUBLE) + 0.0 AS snapped,
      round(60 + cos(radians(a)) * 10, 6) + 0.0 AS arm_x, round(50 - sin(radians(a)) * 10, 6) + 0.0 AS arm_y,
      round(sqrt((x - (20 + t * 80)) ** 2 + (y - (30 + t * 10)) ** 2), 6) AS dist
    FROM (SELECT *, greatest(0e0, least(1e0, ((x - 20) * 80 + (y - 30) * 10) / 6500e0)) AS t FROM (SELECT o_orderkey, CAST(o_orderkey % 131 AS DOUBLE) AS x, CAST(o_custkey % 97 AS DOUBLE) AS y, CAST(o_orderkey % 361 AS DOUBLE) AS a FROM orders))""",
)
def axis_geometry(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 131).cast("double").alias("x"), (F.col("o_custkey") % 97).cast("double").alias("y"), (F.col("o_orderkey") % 361).cast("double").alias("a")
    )
    d = F.lit
    arms = G.axis_arms(d(60.0), d(50.0), 10.0, F.col("a"), d(True))
    return o.select(
        "o_orderkey", r(G.pointer_angle(d(60.0), d(50.0), F.col("x"), F.col("y"), d(True))).alias("pointer"), (G.snap_angle(F.col("a")) + 0.0).alias("snapped"),
        r(arms["x_x"]).alias("arm_x"), r(arms["x_y"]).alias("arm_y"), r(G.segment_distance(F.col("x"), F.col("y"), d(20.0), d(30.0), d(100.0), d(40.0))).alias("dist"),
    )
