"""The SQL side of the domain views: common table expressions, composed by name."""

from __future__ import annotations

BASE = {
    "pt": """SELECT user_id AS clip_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS time_s,
  value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
  event_type <> 'error' AS visible,
  (CAST(json_extract_string(props, '$.k') AS INT) + 1) / 100.0 AS confidence,
  event_type = 'signup' AS manual, event_id, epoch_us(ts) AS pts FROM events""",
    "cum": """SELECT * REPLACE (CAST(sum(CAST(round(x * 100) AS BIGINT)) OVER (PARTITION BY clip_id ORDER BY frame) AS DOUBLE) / 100.0 AS x) FROM pt""",
    "cumall": "SELECT * REPLACE (TRUE AS visible) FROM cum",
    "pred": """SELECT * REPLACE (
  x + ((event_id * 37) % 11 - 5) * 0.5 + CASE WHEN event_id % 29 = 0 THEN 60.0 ELSE 0.0 END AS x,
  y - ((event_id * 37) % 11 - 5) * 0.5 AS y,
  event_id % 13 <> 0 AS visible) FROM pt WHERE event_id % 17 <> 0""",
}


def with_ctes(select: str, *ctes: tuple[str, str] | str) -> str:
    """``WITH ... select``; a bare name refers to BASE."""
    parts = []
    for cte in ctes:
        name, body = (cte, BASE[cte]) if isinstance(cte, str) else cte
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n" + select


USABLE = "visible AND x IS NOT NULL AND y IS NOT NULL"


def run_ctes(src: str, usable: str = USABLE, prefix: str = "") -> list[tuple[str, str]]:
    """``runs``: usable rows with run_id, pos (1-based in run) and n (run length)."""
    return [
        (f"{prefix}numbered", f"SELECT *, sum(CASE WHEN {usable} THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY frame) AS run_id FROM {src}"),
        (f"{prefix}runs", f"""SELECT *, row_number() OVER (PARTITION BY clip_id, run_id ORDER BY frame) AS pos,
  count(*) OVER (PARTITION BY clip_id, run_id) AS n FROM {prefix}numbered WHERE {usable}"""),
    ]


def velocity_ctes(src: str, step: int) -> list[tuple[str, str]]:
    """``samples``: rows of ``src`` with vx, vy and speed."""
    return run_ctes(src) + [
        ("ends", f"""SELECT *, CASE WHEN least({step}, pos - 1, n - pos) >= 1 THEN pos - least({step}, pos - 1, n - pos)
    WHEN n - pos >= 1 THEN pos ELSE pos - least({step}, pos - 1) END AS lo,
  CASE WHEN least({step}, pos - 1, n - pos) >= 1 THEN pos + least({step}, pos - 1, n - pos)
    WHEN n - pos >= 1 THEN pos + least({step}, n - pos) ELSE pos END AS hi FROM runs"""),
        ("vel", """SELECT e.clip_id, e.frame, (h.x - l.x) / (h.time_s - l.time_s) AS vx, (h.y - l.y) / (h.time_s - l.time_s) AS vy
  FROM ends e JOIN runs l ON l.clip_id = e.clip_id AND l.run_id = e.run_id AND l.pos = e.lo
  JOIN runs h ON h.clip_id = e.clip_id AND h.run_id = e.run_id AND h.pos = e.hi WHERE h.time_s > l.time_s"""),
        ("samples", f"""SELECT s.*, v.vx, v.vy, sqrt(v.vx * v.vx + v.vy * v.vy) AS speed
  FROM {src} s LEFT JOIN vel v ON v.clip_id = s.clip_id AND v.frame = s.frame"""),
    ]


FLIPPED = "SELECT * REPLACE (CASE WHEN visible THEN x END AS x, CASE WHEN visible THEN -y END AS y) FROM {src}"


BASE["mp_raw"] = """SELECT s_suppkey AS clip_id, CAST(f AS INT) AS frame, f / 30e0 AS time_s, s_suppkey % 6 AS kind,
  1e0 + (s_suppkey % 7) * 0.1e0 AS p, ((f * 7919 + s_suppkey * 104729) % 13 - 6) * 0.01e0 * (s_suppkey % 3) AS noise,
  2e0 * pi() * (f / 30e0) / (0.5e0 + (s_suppkey % 5) * 0.1e0) AS turn FROM supplier, range(60) AS g(f)"""
BASE["mp"] = """SELECT clip_id, frame, time_s,
  noise + CASE kind WHEN 0 THEN 40e0 + p * 90e0 * time_s WHEN 1 THEN 40e0 + time_s * 30e0 + p * 60e0 * time_s * time_s
    WHEN 2 THEN 160e0 WHEN 3 THEN 20e0 + p * 80e0 * time_s WHEN 4 THEN 160e0 + p * 40e0 * sin(turn) ELSE 160e0 + cos(turn) * 50e0 END AS x,
  -noise + CASE kind WHEN 0 THEN 100e0 + time_s * 10e0 WHEN 1 THEN 100e0 WHEN 2 THEN 20e0 + p * 490.5e0 * time_s * time_s
    WHEN 3 THEN 100e0 - time_s * 120e0 + time_s * time_s * 90e0 WHEN 4 THEN 100e0 + cos(turn * 2e0) * 3e0 ELSE 90e0 + sin(turn) * 50e0 END AS y,
  NOT (clip_id % 4 = 1 AND (frame + clip_id) % 23 = 0) AS visible,
  0.7e0 + ((frame * 31 + clip_id) % 30) / 100e0 AS confidence, FALSE AS manual FROM mp_raw"""
BASE["mdisp"] = """SELECT * REPLACE (CASE WHEN visible THEN CASE WHEN clip_id % 2 = 0 THEN x / 100e0 ELSE x END END AS x,
  CASE WHEN visible THEN CASE WHEN clip_id % 2 = 0 THEN -y / 100e0 ELSE -y END END AS y) FROM mp"""


def period_ctes(src: str, prefix: str = "") -> list[tuple[str, str]]:
    """``periods``: clip_id, period_s estimated from ``src`` (clip_id, frame, time_s, x, y: one run per clip)."""
    p = prefix
    return [
        (f"{p}axes", f"SELECT clip_id, frame, time_s, 'x' AS q, x AS v FROM {src} UNION ALL SELECT clip_id, frame, time_s, 'y', y FROM {src}"),
        (f"{p}cent", f"""SELECT *, v - avg(v) OVER (PARTITION BY clip_id, q) AS c, lead(time_s) OVER (PARTITION BY clip_id, q ORDER BY frame) AS t1
          FROM {p}axes"""),
        (f"{p}cent2", f"SELECT *, lead(c) OVER w AS c1, lag(c) OVER w AS c0 FROM {p}cent WINDOW w AS (PARTITION BY clip_id, q ORDER BY frame)"),
        (f"{p}meta", f"""SELECT clip_id, q, median(t1 - time_s) AS dt, min(time_s) AS ta, max(time_s) AS tb, count(*) AS n, max(abs(c)) AS amp
          FROM {p}cent2 GROUP BY clip_id, q"""),
        (f"{p}grid", f"""SELECT clip_id, q, dt, ta, tb, unnest(range(CAST(ceil((tb + 0.5e0 * dt - ta) / dt) AS BIGINT))) AS g
          FROM {p}meta WHERE n >= 8 AND dt > 1e-9 AND ceil((tb + 0.5e0 * dt - ta) / dt) >= 8 AND amp >= 1e-9"""),
        (f"{p}even", f"""SELECT g.clip_id, g.q, g.g, g.dt, CASE WHEN s.t1 IS NULL THEN s.c
            ELSE s.c + (s.c1 - s.c) * ((g.ta + g.g * g.dt - s.time_s) / (s.t1 - s.time_s)) END AS v
          FROM {p}grid g JOIN {p}cent2 s ON s.clip_id = g.clip_id AND s.q = g.q
            AND s.time_s <= g.ta + g.g * g.dt AND (s.t1 IS NULL OR s.t1 > g.ta + g.g * g.dt)"""),
        (f"{p}evenc", f"SELECT clip_id, q, g, dt, v - avg(v) OVER (PARTITION BY clip_id, q) AS v FROM {p}even"),
        (f"{p}corr", f"""SELECT a.clip_id, a.q, b.g - a.g AS lag, min(a.dt) AS dt, sum(a.v * b.v) AS c
          FROM {p}evenc a JOIN {p}evenc b ON b.clip_id = a.clip_id AND b.q = a.q AND b.g >= a.g GROUP BY 1, 2, 3"""),
        (f"{p}peaks", f"""SELECT *, lag(c) OVER w AS cb, lead(c) OVER w AS cf, first_value(c) OVER w AS c0
          FROM {p}corr WINDOW w AS (PARTITION BY clip_id, q ORDER BY lag)"""),
        (f"{p}auto", f"""SELECT clip_id, q, min(lag * dt) AS period FROM {p}peaks
          WHERE c0 > 0 AND lag >= greatest(2, CAST(floor(0.08e0 / dt) AS BIGINT)) AND c >= cb - 1e-9 * c0 AND c >= cf - 1e-9 * c0 AND c > 0.25e0 * c0 GROUP BY 1, 2"""),
        (f"{p}crossing", f"""SELECT *, lag(time_s) OVER (PARTITION BY clip_id, q ORDER BY frame) AS tp, count(*) OVER (PARTITION BY clip_id, q) AS nc
          FROM {p}cent2 WHERE (c0 <= 0 AND c > 0) OR (c0 >= 0 AND c < 0)"""),
        (f"{p}zero", f"SELECT clip_id, q, 2e0 * median(time_s - tp) AS period FROM {p}crossing WHERE nc >= 3 AND time_s - tp > 1e-6 GROUP BY 1, 2"),
        (f"{p}est", f"""SELECT m.clip_id, m.q, (SELECT avg(u.period) FROM (SELECT period FROM {p}auto a WHERE a.clip_id = m.clip_id AND a.q = m.q
            UNION ALL SELECT period FROM {p}zero z WHERE z.clip_id = m.clip_id AND z.q = m.q) u) AS period FROM {p}meta m WHERE m.amp >= 1e-9"""),
        (f"{p}periods", f"""SELECT clip_id, coalesce(max(period) FILTER (q = 'x'), max(period) FILTER (q = 'y')) AS period_s
          FROM {p}est GROUP BY clip_id"""),
    ]


def analysis_ctes(points: str, active: str, length: str, hint: bool = False, disp: str | None = None) -> list[tuple[str, str]]:
    """``ranked``: every scored model of every track of ``points``, with true two-pass residuals.

    ``disp`` holds analysis coordinates; ``active`` and ``length`` are expressions over clip_id.
    """
    disp = disp or points
    return [
        ("facts", f"""SELECT clip_id, count(*) AS np, sum(CAST(visible AS INT)) AS nv, sum(CAST(visible AS INT)) / greatest(count(*), 1) AS coverage,
          coalesce(avg(confidence) FILTER (visible), 0) AS mean_conf FROM {points} GROUP BY clip_id"""),
        *run_ctes(disp),
        ("pick", """SELECT clip_id, run_id FROM (SELECT clip_id, run_id, row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, min(frame)) AS rk
          FROM runs GROUP BY clip_id, run_id HAVING count(*) >= 1) WHERE rk = 1"""),
        ("seg", "SELECT r.*, greatest(r.confidence, 1e-3) AS w FROM runs r JOIN pick USING (clip_id, run_id) WHERE r.n >= 6"),
        ("st", """SELECT clip_id, count(*) AS n, min(frame) AS f0, max(frame) AS f1, min(time_s) AS t0, max(time_s) AS t1,
          arg_min(x, frame) AS xa, arg_min(y, frame) AS ya, arg_max(x, frame) AS xb, arg_max(y, frame) AS yb,
          max(x) - min(x) AS spx, max(y) - min(y) AS spy, var_pop(x) AS cxx, var_pop(y) AS cyy, covar_pop(x, y) AS cxy FROM seg GROUP BY clip_id"""),
        ("ax", """SELECT *, CASE WHEN sqrt((xb - xa) ** 2 + (yb - ya) ** 2) > 1e-9 THEN (xb - xa) / sqrt((xb - xa) ** 2 + (yb - ya) ** 2)
            ELSE cos(0.5e0 * atan2(2e0 * cxy, cxx - cyy)) END AS ux,
          CASE WHEN sqrt((xb - xa) ** 2 + (yb - ya) ** 2) > 1e-9 THEN (yb - ya) / sqrt((xb - xa) ** 2 + (yb - ya) ** 2)
            ELSE sin(0.5e0 * atan2(2e0 * cxy, cxx - cyy)) END AS uy FROM st"""),
        ("sx", "SELECT s.clip_id, s.frame, s.time_s - a.t0 AS tau, s.w, s.x, s.y, s.x * a.ux + s.y * a.uy AS s FROM seg s JOIN ax a USING (clip_id)"),
        ("lg0", """SELECT clip_id, tau, w, 'x' AS q, x AS v FROM sx UNION ALL SELECT clip_id, tau, w, 'y', y FROM sx
          UNION ALL SELECT clip_id, tau, w, 's', s FROM sx"""),
        ("lg", "SELECT *, avg(v) OVER (PARTITION BY clip_id, q) AS m, v - avg(v) OVER (PARTITION BY clip_id, q) AS c FROM lg0"),
        ("sm", """SELECT clip_id, q, min(m) AS m, sum(w) AS s0, sum(w*tau) AS s1, sum(w*tau*tau) AS s2, sum(w*tau**3) AS s3, sum(w*tau**4) AS s4,
          sum(w*c) AS b0, sum(w*c*tau) AS b1, sum(w*c*tau*tau) AS b2, max(v) - min(v) AS span, sum(w*v)/sum(w) AS wm FROM lg GROUP BY 1, 2"""),
        ("cf0", """SELECT *, (b1 - s1*b0/s0) / (s2 - s1*s1/s0) AS l1, s2 - s1*s1/s0 AS d22, s3 - s1*s2/s0 AS d23, s4 - s2*s2/s0 AS d33,
          b1 - s1*b0/s0 AS e2, b2 - s2*b0/s0 AS e3 FROM sm"""),
        ("cf", """SELECT *, (b0 - s1*l1)/s0 AS l0, (e3 - d23/d22*e2) / (d33 - d23/d22*d23) AS q2 FROM cf0"""),
        ("cg", """SELECT *, (e2 - d23*q2)/d22 AS q1, (b0 - s1*((e2 - d23*q2)/d22) - s2*q2)/s0 AS q0 FROM cf"""),
        ("rs", """SELECT l.clip_id, l.q, sum(l.w*(l.c - g.l0 - g.l1*l.tau)**2) AS rl, sum(l.w*(l.c - g.q0 - g.q1*l.tau - g.q2*l.tau*l.tau)**2) AS rq,
          sum(l.w*(l.v - g.wm)**2) AS tt FROM lg l JOIN cg g USING (clip_id, q) GROUP BY 1, 2"""),
        ("ft", """SELECT g.*, CASE WHEN tt < 1e-18 THEN CASE WHEN rl < 1e-18 THEN 1e0 ELSE 0e0 END ELSE greatest(0e0, least(1e0, 1 - rl/tt)) END AS r2l,
          CASE WHEN tt < 1e-18 THEN CASE WHEN rq < 1e-18 THEN 1e0 ELSE 0e0 END ELSE greatest(0e0, least(1e0, 1 - rq/tt)) END AS r2q,
          CASE WHEN span < 1e-12 THEN CASE WHEN sqrt(rl/s0) < 1e-12 THEN 0e0 ELSE 1e0 END ELSE sqrt(rl/s0)/span END AS nl,
          CASE WHEN span < 1e-12 THEN CASE WHEN sqrt(rq/s0) < 1e-12 THEN 0e0 ELSE 1e0 END ELSE sqrt(rq/s0)/span END AS nq FROM cg g JOIN rs USING (clip_id, q)"""),
        ("wide", f"""SELECT a.*, f.coverage, f.mean_conf, {active} AS act, {length} AS len,
          x.m + x.l0 AS xl0, x.l1 AS xl1, x.r2l AS xr2l, x.nl AS xnl, y.r2l AS yr2l, y.r2q AS yr2q, y.nq AS ynq, y.m + y.q0 AS yq0, y.q1 AS yq1, y.q2 AS yq2,
          s.m + s.l0 AS sl0, s.l1 AS sl1, s.r2l AS sr2l, s.nl AS snl, s.m + s.q0 AS sq0, s.q1 AS sq1, s.q2 AS sq2, s.r2q AS sr2q, s.nq AS snq
          FROM ax a JOIN facts f USING (clip_id) JOIN ft x ON x.clip_id = a.clip_id AND x.q = 'x' JOIN ft y ON y.clip_id = a.clip_id AND y.q = 'y'
          JOIN ft s ON s.clip_id = a.clip_id AND s.q = 's'"""),
        ("orbit", """SELECT clip_id FROM st WHERE spx >= 1e-9 AND spy >= 1e-9 AND least(spx, spy) / greatest(spx, spy) >= 0.45
          AND sqrt(cxx * cyy) >= 1e-12 AND abs(cxy) / sqrt(cxx * cyy) < 0.35"""),
        ("swing", "SELECT s.* FROM seg s WHERE s.n >= 12 AND s.clip_id NOT IN (SELECT clip_id FROM orbit)"),
        *period_ctes("swing"),
        ("hb", """SELECT l.clip_id, l.q, p.period_s, l.w, l.c AS v, cos(2e0*pi()/p.period_s*l.tau) AS c, sin(2e0*pi()/p.period_s*l.tau) AS s
          FROM lg l JOIN periods p USING (clip_id) WHERE p.period_s > 0 AND l.q <> 's'"""),
        ("hs", """SELECT clip_id, q, min(period_s) AS pt, sum(w*c*c) AS a, sum(w*c*s) AS b, sum(w*c) AS c, sum(w*s*s) AS d, sum(w*s) AS e, sum(w) AS f,
          sum(w*c*v) AS g, sum(w*s*v) AS h, sum(w*v) AS i FROM hb GROUP BY 1, 2"""),
        ("hd", "SELECT *, a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c) AS det FROM hs"),
        ("hc", """SELECT *, (g*(d*f-e*e) - b*(h*f-e*i) + c*(h*e-d*i))/det AS k0, (a*(h*f-e*i) - g*(b*f-e*c) + c*(b*i-h*c))/det AS k1,
          (a*(d*i-h*e) - b*(b*i-h*c) + g*(b*e-d*c))/det AS k2 FROM hd"""),
        ("hr", """SELECT b.clip_id, b.q, min(k.pt) AS pt, sum(b.w*(b.v - k.k0*b.c - k.k1*b.s - k.k2)**2) AS res, sum(b.w) AS sw
          FROM hb b JOIN hc k USING (clip_id, q) GROUP BY 1, 2"""),
        ("hf", """SELECT h.clip_id, h.pt, CASE WHEN r.tt < 1e-18 THEN CASE WHEN h.res < 1e-18 THEN 1e0 ELSE 0e0 END ELSE greatest(0e0, least(1e0, 1 - h.res/r.tt)) END AS r2,
          CASE WHEN m.span < 1e-12 THEN CASE WHEN sqrt(h.res/h.sw) < 1e-12 THEN 0e0 ELSE 1e0 END ELSE sqrt(h.res/h.sw)/m.span END AS nr
          FROM hr h JOIN rs r USING (clip_id, q) JOIN sm m USING (clip_id, q) JOIN st USING (clip_id) WHERE h.q = CASE WHEN st.spx >= st.spy THEN 'x' ELSE 'y' END"""),
        ("mods", f"""SELECT clip_id, 0 AS ord, 'uniform_linear' AS kind, sr2l AS r2, snl AS nrmse, sl1 AS v, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS per FROM wide
          UNION ALL SELECT clip_id, 1, 'uniform_accel', sr2q, snq, sq1, 2*sq2, NULL, NULL FROM wide WHERE n >= 8
          UNION ALL SELECT clip_id, 2, 'free_fall', yr2q, ynq, yq1, 2*yq2, CASE WHEN act THEN abs(2*yq2) END, NULL FROM wide
            WHERE n >= 8 AND spy >= 1e-9 AND spx / spy <= 0.08 AND yr2q >= yr2l + 0.03
          UNION ALL SELECT clip_id, 3, 'projectile', least(xr2l, yr2q), 0.5*xnl + 0.5*ynq, xl1, 2*yq2, CASE WHEN act THEN abs(2*yq2) END, NULL FROM wide
            WHERE n >= 8 AND spx >= 0.15*greatest(spy, 1e-9) AND xr2l >= 0.92 AND yr2q >= 0.90 AND yr2q >= yr2l + 0.02
          UNION ALL SELECT clip_id, 4, 'pendulum', {'least(1e0, h.r2 + 0.01e0)' if hint else 'h.r2'}, h.nr, NULL, NULL, CASE WHEN len > 0 THEN 4*pi()**2*len/pt**2 END, pt
            FROM wide JOIN hf h USING (clip_id) WHERE t1 - t0 >= 0.6*pt AND h.r2 >= 0.75"""),
        ("conf", f"""SELECT m.*, w.n, w.f0, w.f1, w.t0, w.t1, w.act, w.len,
          greatest(0e0, least(0.45*greatest(0e0, r2) + 0.25*greatest(0e0, 1 - least(nrmse/0.10, 1e0)) + 0.12*coverage + 0.10*mean_conf + 0.08*CASE WHEN act THEN 1.0 ELSE 0.4 END, 0.99))
            {"+ CASE WHEN kind = 'pendulum' THEN 0.04e0 ELSE 0 END" if hint else ''} AS conf0 FROM mods m JOIN wide w USING (clip_id)"""),
        ("flg", """SELECT *, max(CASE WHEN kind='uniform_linear' THEN r2 END) OVER c AS ur2, max(CASE WHEN kind='uniform_linear' THEN nrmse END) OVER c AS unr,
          max(CASE WHEN kind='uniform_accel' THEN r2 END) OVER c AS ar2, max(CASE WHEN kind='uniform_accel' THEN nrmse END) OVER c AS anr,
          max(CASE WHEN kind='uniform_accel' THEN abs(a) END) OVER c AS aa, max(CASE WHEN kind='uniform_accel' THEN abs(v) END) OVER c AS av,
          bool_or(kind='uniform_accel') OVER c AS ha, bool_or(kind='free_fall') OVER c AS hf, bool_or(kind='projectile') OVER c AS hp,
          bool_or(kind='pendulum') OVER c AS hq FROM conf WINDOW c AS (PARTITION BY clip_id)"""),
        ("nud", """SELECT *, ha AND (aa*greatest(t1-t0,1e-9) <= 0.12*greatest(av,1e-6) OR ar2-ur2 < 0.015) AS weak FROM flg"""),
        ("prf", """SELECT *, greatest(0e0, least(0.99, conf0
          * CASE WHEN kind='uniform_accel' AND weak THEN 0.72e0 ELSE 1 END
          * CASE WHEN kind='uniform_linear' AND ha AND NOT weak AND ar2-ur2 >= 0.03 AND anr <= unr+0.01 THEN 0.8e0 ELSE 1 END
          * CASE WHEN kind='uniform_accel' AND hf THEN 0.52e0 ELSE 1 END * CASE WHEN kind='uniform_accel' AND hp THEN 0.52e0 ELSE 1 END
          * CASE WHEN kind='free_fall' AND hp THEN 0.6e0 ELSE 1 END * CASE WHEN kind<>'pendulum' AND hq THEN 0.55e0 ELSE 1 END)) AS confidence FROM nud"""),
        ("rk0", """SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY confidence DESC, ord) AS rank, bool_or(nrmse <= 0.18) OVER (PARTITION BY clip_id) AS anyp FROM prf"""),
        ("rk1", "SELECT *, CASE WHEN anyp THEN nrmse <= 0.18 ELSE rank = 1 END AS listed FROM rk0"),
        ("rk2", "SELECT *, row_number() OVER (PARTITION BY clip_id, listed ORDER BY rank) AS lr, count(*) FILTER (listed) OVER (PARTITION BY clip_id) AS nl FROM rk1"),
        ("rk3", """SELECT *, max(CASE WHEN listed AND lr = 1 THEN confidence END) OVER (PARTITION BY clip_id) - coalesce(max(CASE WHEN listed AND lr = 2 THEN confidence END) OVER (PARTITION BY clip_id), 0) AS margin FROM rk2"""),
        ("ranked", """SELECT *, listed AND lr = 1 AND (n >= 8 OR (kind = 'uniform_linear' AND n >= 6)) AND nrmse <= 0.08 AND confidence >= 0.62 AND margin >= 0.08 AS auto FROM rk3"""),
    ]
