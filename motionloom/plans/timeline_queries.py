"""Queries on the frame timeline, joins by frame and the frame index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import kinematics as K
from ..operators import stabilize as ST
from ..operators import timeline as TL
from ..operators import video as VI
from . import views as V
from .registry import r, register, rounded
from .sql_views import FLIPPED, with_ctes

KEY = V.KEY
BOUNDS = ("bounds", "SELECT clip_id, clip_id % 3 AS a, max(frame) + clip_id % 4 AS z FROM pt GROUP BY clip_id")
SPARSE = ("sp", "SELECT * FROM pt WHERE visible OR manual")


@register(
    "densify",
    with_ctes(
        """SELECT g.clip_id, CAST(g.f AS INT) AS frame,
          round(CASE WHEN e.frame IS NOT NULL THEN e.x WHEN p.visible AND n.visible THEN p.x + (n.x - p.x) * ((g.f - p.frame) / (n.frame - p.frame)) ELSE coalesce(p.x, n.x, 0) END, 6) AS x,
          round(CASE WHEN e.frame IS NOT NULL THEN e.y WHEN p.visible AND n.visible THEN p.y + (n.y - p.y) * ((g.f - p.frame) / (n.frame - p.frame)) ELSE coalesce(p.y, n.y, 0) END, 6) AS y,
          CASE WHEN e.frame IS NOT NULL THEN e.visible ELSE coalesce(p.visible AND n.visible, FALSE) END AS visible,
          CASE WHEN e.frame IS NOT NULL THEN e.confidence WHEN p.visible AND n.visible THEN least(p.confidence, n.confidence) ELSE 0 END AS confidence,
          coalesce(e.manual, FALSE) AS manual, e.frame IS NULL AND coalesce(p.visible AND n.visible, FALSE) AS interpolated
        FROM grid g LEFT JOIN sp e ON e.clip_id = g.clip_id AND e.frame = g.f
        ASOF LEFT JOIN sp p ON p.clip_id = g.clip_id AND p.frame < g.f ASOF LEFT JOIN sp n ON n.clip_id = g.clip_id AND n.frame > g.f""",
        "pt", BOUNDS, SPARSE, ("grid", "SELECT clip_id, unnest(range(a, z + 1)) AS f FROM bounds"),
    ),
)
def densify(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    return rounded(TL.densify(V.sparse_points(points), V.clip_bounds(points), KEY), "x", "y")


@register(
    "sample_grid",
    with_ctes(
        """SELECT DISTINCT clip_id, CAST(f AS INT) AS frame FROM (SELECT clip_id, unnest(range(a, z + 1, 3)) AS f FROM bounds UNION ALL SELECT clip_id, z FROM bounds
        UNION ALL SELECT p.clip_id, p.frame FROM pt p JOIN bounds b USING (clip_id) WHERE p.manual AND p.frame BETWEEN b.a AND b.z)""",
        "pt", BOUNDS,
    ),
)
def sample_grid(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    return TL.sample_grid(V.clip_bounds(points), KEY, 3, points.filter("manual").select("clip_id", "frame"))


@register(
    "remap_prompts",
    with_ctes(
        """SELECT p.clip_id, p.event_id, CAST(o.k AS INT) AS frame FROM pt p JOIN (SELECT clip_id, frame, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS k FROM sp) o
        ON o.clip_id = p.clip_id AND o.frame = p.frame""",
        "pt", SPARSE,
    ),
)
def remap_prompts(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    prompts = points.select("clip_id", "event_id", "frame")
    return TL.remap_prompts(prompts, V.sparse_points(points).select("clip_id", "frame"), KEY)


@register(
    "window_prompts",
    """SELECT conv_id AS clip_id, coalesce(list_sort(list(turn - 1) FILTER (turn BETWEEN 1 AND 4)), [0])::VARCHAR AS frames, count(*) FILTER (turn BETWEEN 1 AND 4) = 0 AS seeded FROM conversations GROUP BY conv_id""",
)
def window_prompts(spark, sf_dir):
    prompt = lambda f, kind: F.struct(f.cast("int").alias("frame"), F.lit(kind).alias("kind"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    layers = V.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("clip_id")).agg(F.array_sort(F.collect_list(prompt(F.col("turn"), "positive"))).alias("prompts"))
    out = TL.window_prompts(F.col("prompts"), F.lit(1), F.lit(4), prompt(F.lit(0), "seed"))
    frames = F.concat(F.lit("["), F.concat_ws(", ", F.transform(out, lambda p: p["frame"].cast("string"))), F.lit("]"))
    return layers.select("clip_id", frames.alias("frames"), (F.get(out, F.lit(0))["kind"] == "seed").alias("seeded"))


@register(
    "visible_neighbours",
    with_ctes(
        """SELECT clip_id, frame, max(CASE WHEN visible THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_visible,
        min(CASE WHEN visible THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_visible FROM pt""",
        "pt",
    ),
)
def visible_neighbours(spark, sf_dir):
    return TL.visible_neighbours(V.event_points(spark, sf_dir), KEY).select("clip_id", "frame", "prev_visible", "next_visible")


def _predict_sql(axis: str) -> str:
    v = [f"s[{i}].{axis}" for i in range(1, 5)]
    d = [f"({v[i]} - {v[i + 1]})" for i in range(3)]
    a = [f"({d[i]} - {d[i + 1]})" for i in range(2)]
    mv = f"abs(CASE len(s) WHEN 2 THEN {d[0]} WHEN 3 THEN ({d[0]} + {d[1]}) / 2 ELSE ({d[0]} + {d[1]} + {d[2]}) / 3 END)"
    return f"""round(CASE WHEN len(s) = 0 THEN -1 WHEN len(s) = 1 THEN {v[0]}
      WHEN len(s) = 3 OR (len(s) = 4 AND abs({a[0]} - {a[1]}) < abs(({a[0]} + {a[1]}) / 2)) THEN {v[0]} + {d[0]} + {a[0]}
      WHEN len(s) < 3 OR abs({d[0]} - {d[1]}) < {mv} THEN {v[0]} + {d[0]} ELSE {v[0]} END, 4) + 0.0 AS pred_{axis}"""


@register(
    "predict_next",
    with_ctes(
        f"SELECT clip_id, frame, {_predict_sql('x')}, {_predict_sql('y')} FROM seen",
        "pt",
        ("ints", "SELECT clip_id, frame, visible, CAST(floor(x) AS INT) AS x, CAST(y AS INT) AS y FROM pt"),
        ("seen", """SELECT clip_id, frame, list_filter([lag(p, 1) OVER w, lag(p, 2) OVER w, lag(p, 3) OVER w, lag(p, 4) OVER w], lambda q: q IS NOT NULL AND q.v) AS s
          FROM (SELECT clip_id, frame, {'x': x, 'y': y, 'v': visible} AS p FROM ints) WINDOW w AS (PARTITION BY clip_id ORDER BY frame)"""),
    ),
)
def predict_next(spark, sf_dir):
    points = V.event_points(spark, sf_dir).withColumn("x", F.floor("x").cast("double"))
    out = TL.predict_next(points, KEY, (F.lit(-1.0), F.lit(-1.0)))
    return out.select("clip_id", "frame", r("pred_x", 4).alias("pred_x"), r("pred_y", 4).alias("pred_y"))


@register(
    "representative_points",
    with_ctes(
        """SELECT clip_id, frame, round(time_s, 6) AS t, x, y + 0.0 AS y FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY edge, frame) AS rk FROM marked
        WHERE n <= 24 OR edge OR pos % stride = 0) WHERE n <= 24 OR edge OR rk <= room""",
        "pt", ("d", FLIPPED.format(src="pt")),
        ("vis", "SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS pos FROM d WHERE visible"),
        ("ext", """SELECT clip_id, count(*) AS n, list_distinct([min(frame), max(frame), arg_min(frame, {'v': x, 'f': frame}), arg_min(frame, {'v': -x, 'f': frame}),
          arg_min(frame, {'v': y, 'f': frame}), arg_min(frame, {'v': -y, 'f': frame})]) AS e FROM vis GROUP BY clip_id"""),
        ("marked", "SELECT v.*, n, list_contains(e, v.frame) AS edge, 24 - len(e) AS room, greatest(1, n // (24 - len(e))) AS stride FROM vis v JOIN ext USING (clip_id)"),
    ),
)
def representative_points(spark, sf_dir):
    shown = K.display_points(V.event_points(spark, sf_dir), KEY, None)
    out = TL.representative_points(shown, KEY)
    return out.select("clip_id", "frame", r("time_s").alias("t"), "x", (F.col("y") + 0.0).alias("y"))


@register(
    "trailing_hidden",
    with_ctes(
        """SELECT clip_id, count(*) FILTER (frame > coalesce(m, -1)) AS lost_streak, CASE WHEN count(*) FILTER (frame > coalesce(m, -1)) >= 8 THEN 'target_lost' ELSE 'none' END AS failure_reason
        FROM (SELECT *, max(CASE WHEN visible THEN frame END) OVER (PARTITION BY clip_id) AS m FROM (SELECT * REPLACE (event_type = 'view' AS visible) FROM (SELECT p.*, e.event_type FROM pt p JOIN events e USING (event_id)))) GROUP BY clip_id""",
        "pt",
    ),
)
def trailing_hidden(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    types = V.table(spark, sf_dir, "events").select("event_id", "event_type")
    rare = points.join(types, "event_id").withColumn("visible", F.col("event_type") == "view")
    return TL.trailing_hidden(rare, KEY)


HISTORY = """SELECT conv_id, turn, role, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations)
  WHERE rk <= {kept} AND role IN ('user', 'assistant') AND length(trim(text, ' \t\n\r')) > 0"""


def _history(spark, sf_dir, kept):
    talks = V.table(spark, sf_dir, "conversations")
    last = TL.last_messages(talks, ["conv_id"], "turn", kept)
    said = F.length(F.trim(F.col("text"), F.lit(" \t\n\r"))) > 0
    return last.filter(F.col("role").isin("user", "assistant") & said).select("conv_id", "turn", "role", F.col("text").alias("content"))


@register("chat_history", HISTORY.format(kept=12))
def chat_history(spark, sf_dir):
    return _history(spark, sf_dir, 12)


@register("chat_history_last4", HISTORY.format(kept=4))
def chat_history_last4(spark, sf_dir):
    return _history(spark, sf_dir, 4)


PACKETS = ("pk", "SELECT user_id AS clip_id, CASE WHEN event_id % 23 <> 0 THEN epoch_us(ts) END AS pts, event_id % 19 AS size FROM events")
INDEX = ("ix", """SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY pts) - 1 AS INT) AS frame, pts,
  CAST(round_even((pts - min(pts) OVER (PARTITION BY clip_id)) * 1e-6 * 1000.0, 0) AS BIGINT) AS pts_ms FROM (SELECT DISTINCT clip_id, pts FROM pk WHERE size > 0 AND pts IS NOT NULL)""")


def _index(spark, sf_dir):
    return VI.index_packets(V.packets(spark, sf_dir), KEY, 1e-6)


@register("video_index", with_ctes("SELECT * FROM ix", PACKETS, INDEX))
def video_index(spark, sf_dir):
    return _index(spark, sf_dir).select("clip_id", "frame", "pts", "pts_ms")


@register(
    "video_index_fallback",
    """SELECT user_id AS clip_id, count(*) FILTER (event_id % 19 > 0 AND event_id % 23 <> 0) AS n_usable, count(DISTINCT date_trunc('hour', ts)) FILTER (event_id % 19 > 0 AND event_id % 23 <> 0) AS n_unique,
      count(*) FILTER (event_id % 19 > 0 AND event_id % 23 <> 0) = 0 OR count(*) FILTER (event_id % 19 > 0 AND event_id % 23 <> 0) <> count(DISTINCT date_trunc('hour', ts)) FILTER (event_id % 19 > 0 AND event_id % 23 <> 0) AS fallback
    FROM events GROUP BY user_id""",
)
def video_index_fallback(spark, sf_dir):
    coarse = V.packets(spark, sf_dir).withColumn("pts", F.floor(F.col("pts") / 3_600_000_000))
    return VI.needs_decoding(coarse, KEY)


@register(
    "video_index_mixed",
    """WITH RECURSIVE pk AS (SELECT user_id AS clip_id, CASE WHEN event_id % 23 <> 0 AND user_id % 7 <> 0 THEN CASE WHEN user_id % 3 = 0 THEN epoch_us(ts) // 3600000000 ELSE epoch_us(ts) END END AS pts, event_id % 19 AS size FROM events),
    ok AS (SELECT clip_id, pts FROM pk WHERE size > 0 AND pts IS NOT NULL), fine AS (SELECT clip_id FROM ok GROUP BY clip_id HAVING count(*) = count(DISTINCT pts)),
    pt AS (SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame, event_id FROM events WHERE user_id NOT IN (SELECT clip_id FROM fine)),
    raw AS (SELECT clip_id, frame, coalesce(CASE WHEN event_id % 5 <> 0 THEN frame * 100 + (event_id % 7 - 3) * 60 END, frame * 40) AS v FROM pt),
    walk AS (SELECT clip_id, frame, CAST(v AS BIGINT) AS pts FROM raw WHERE frame = 0 UNION ALL
      SELECT r.clip_id, r.frame, CAST(CASE WHEN r.v > w.pts THEN r.v ELSE w.pts + 40 END AS BIGINT) FROM walk w JOIN raw r ON r.clip_id = w.clip_id AND r.frame = w.frame + 1),
    every AS (SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY pts) - 1 AS INT) AS frame, pts FROM ok WHERE clip_id IN (SELECT clip_id FROM fine) UNION ALL SELECT * FROM walk)
    SELECT *, CAST(round_even((pts - min(pts) OVER (PARTITION BY clip_id)) * 1e-6 * 1000.0, 0) AS BIGINT) AS pts_ms FROM every""",
)
def video_index_mixed(spark, sf_dir):
    """Clips with repeated packet timestamps (every third) or none at all (every seventh) are indexed from decoded frames."""
    c = F.col("clip_id")
    packets = V.packets(spark, sf_dir).withColumn("pts", F.when(c % 7 == 0, F.lit(None)).when(c % 3 == 0, F.floor(F.col("pts") / 3_600_000_000)).otherwise(F.col("pts")))
    return VI.index_clips(packets, V.decoded_frames(V.event_points(spark, sf_dir)), KEY, 1e-6, 40)


@register(
    "repair_pts",
    """WITH RECURSIVE pt AS (SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame, event_id FROM events),
    raw AS (SELECT clip_id, frame, coalesce(CASE WHEN event_id % 5 <> 0 THEN frame * 100 + (event_id % 7 - 3) * 60 END, frame * 40) AS v FROM pt),
    walk AS (SELECT clip_id, frame, CAST(v AS BIGINT) AS pts FROM raw WHERE frame = 0 UNION ALL
      SELECT r.clip_id, r.frame, CAST(CASE WHEN r.v > w.pts THEN r.v ELSE w.pts + 40 END AS BIGINT) FROM walk w JOIN raw r ON r.clip_id = w.clip_id AND r.frame = w.frame + 1)
    SELECT * FROM walk""",
)
def repair_pts(spark, sf_dir):
    return VI.repair_pts(V.decoded_frames(V.event_points(spark, sf_dir)), KEY, 40)


@register(
    "constant_rate_index",
    with_ctes("SELECT clip_id, CAST(f AS INT) AS frame, f AS pts, CAST(round_even(f * 1000.0 / (24 + clip_id % 7), 0) AS BIGINT) AS pts_ms FROM (SELECT clip_id, unnest(range(max(frame) + 1)) AS f FROM pt GROUP BY clip_id)", "pt"),
)
def constant_rate_index(spark, sf_dir):
    return VI.constant_rate_index(V.event_points(spark, sf_dir), KEY, (24 + F.col("clip_id") % 7).cast("double"))


@register(
    "clip_facts",
    with_ctes(
        """SELECT clip_id, count(*) AS frame_count, round(CASE WHEN count(*) >= 2 AND max(pts_ms) > min(pts_ms) THEN (count(*) - 1) * 1000.0 / (max(pts_ms) - min(pts_ms)) ELSE 30.0 END, 9) AS fps,
        CASE WHEN count(*) = 1 THEN min(pts_ms) ELSE max(pts_ms) + greatest(arg_max(gap, frame), 0) END AS duration_ms
        FROM (SELECT *, pts_ms - lag(pts_ms) OVER (PARTITION BY clip_id ORDER BY frame) AS gap FROM ix) GROUP BY clip_id""",
        PACKETS, INDEX,
    ),
)
def clip_facts(spark, sf_dir):
    return VI.clip_facts(_index(spark, sf_dir), KEY).withColumn("fps", r("fps", 9))


@register(
    "frame_delays",
    with_ctes("SELECT clip_id, frame, CAST(coalesce(greatest(coalesce(lead(pts_ms) OVER w - pts_ms, pts_ms - lag(pts_ms) OVER w), 1), 33) AS BIGINT) AS delay_ms FROM ix WINDOW w AS (PARTITION BY clip_id ORDER BY frame)", PACKETS, INDEX),
)
def frame_delays(spark, sf_dir):
    return VI.frame_delays(_index(spark, sf_dir), KEY).select("clip_id", "frame", "delay_ms")


@register(
    "index_of_pts",
    with_ctes(
        """SELECT q.clip_id, q.query_id, coalesce(min(i.frame) FILTER (i.pts >= q.value), max(i.frame)) AS frame FROM (SELECT user_id AS clip_id, event_id AS query_id, epoch_us(ts) + 1000000 AS value FROM events) q
        JOIN ix i ON i.clip_id = q.clip_id GROUP BY q.clip_id, q.query_id""",
        PACKETS, INDEX,
    ),
)
def index_of_pts(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    wanted = e.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("query_id"), (V.micros(F.col("ts")) + 1_000_000).alias("value"))
    return VI.index_of_pts(_index(spark, sf_dir), wanted, KEY)


@register(
    "frame_time",
    with_ctes(
        "SELECT p.clip_id, p.frame, round(coalesce(i.pts_ms / 1000.0, p.frame / 25e0), 6) AS time_s FROM pt p LEFT JOIN ix i ON i.clip_id = p.clip_id AND i.frame = p.frame",
        "pt", PACKETS, INDEX,
    ),
)
def frame_time(spark, sf_dir):
    points = V.event_points(spark, sf_dir).drop("time_s")
    return K.attach_time(points, _index(spark, sf_dir), KEY, 25.0).select("clip_id", "frame", r("time_s").alias("time_s"))


@register(
    "merge_points",
    with_ctes("SELECT clip_id, frame, x, y, visible FROM pt WHERE frame < 20 UNION ALL SELECT clip_id, frame, x, y, visible FROM pred WHERE frame >= 20", "pt", "pred"),
)
def merge_points(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    cols = ["clip_id", "frame", "x", "y", "visible", "event_id"]
    out = J.merge_points(points.select(*cols), V.predictions(points).select(*cols), KEY, F.lit(20), "event_id")
    return out.select("clip_id", "frame", "x", "y", "visible")


@register(
    "override_points",
    with_ctes(
        """SELECT clip_id, frame, x, y, visible, confidence, manual, FALSE AS interpolated FROM pt p WHERE NOT EXISTS (SELECT 1 FROM fix f WHERE f.clip_id = p.clip_id AND f.frame = p.frame)
        UNION ALL SELECT clip_id, frame, x, y, TRUE, 1.0, TRUE, FALSE FROM fix""",
        "pt", ("fix", "SELECT clip_id, CAST(frame + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1000 END AS INT) AS frame, x + 1 AS x, y - 1 AS y FROM pt WHERE confidence < 0.75 OR NOT visible"),
    ),
)
def override_points(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    even = F.col("event_id") % 2 == 0
    fixes = points.filter("confidence < 0.75 or not visible").select(
        "clip_id", (F.col("frame") + F.when(even, 0).otherwise(1000)).alias("frame"), (F.col("x") + 1).alias("x"), (F.col("y") - 1).alias("y")
    )
    return J.override_points(points, fixes, KEY)


SHAKE = ("shake", "SELECT clip_id, frame, ((frame * 7 + clip_id) % 9 - 4) * 0.5 AS dx, ((frame * 5 + clip_id) % 7 - 3) * 0.25 AS dy FROM pt WHERE frame < 20 + clip_id % 40")


@register(
    "compensate_shake",
    with_ctes(
        """SELECT p.clip_id, p.frame, round(p.x - coalesce(s.dx, 0), 6) AS x, round(p.y - coalesce(s.dy, 0), 6) AS y, p.visible, p.confidence FROM pt p LEFT JOIN (SELECT clip_id, max(frame) AS last FROM shake GROUP BY clip_id) l USING (clip_id)
        LEFT JOIN shake s ON s.clip_id = p.clip_id AND s.frame = least(p.frame, l.last)""",
        "pt", SHAKE,
    ),
)
def compensate_shake(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    out = J.compensate(points, V.shake_offsets(points), KEY)
    return out.select("clip_id", "frame", r("x").alias("x"), r("y").alias("y"), "visible", "confidence")


@register(
    "nearest_in_time",
    with_ctes(
        """SELECT clip_id, cursor_id, frame, round(time_s, 6) AS time_s FROM (SELECT c.clip_id, c.event_id AS cursor_id, p.frame, p.time_s, row_number() OVER (PARTITION BY c.clip_id, c.event_id ORDER BY abs(p.time_s - c.at_s), p.frame) AS rk
        FROM (SELECT clip_id, event_id, time_s + 1800 * (event_id % 50) AS at_s FROM pt) c JOIN pt p ON p.clip_id = c.clip_id) WHERE rk = 1""",
        "pt",
    ),
)
def nearest_in_time(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    i = F.col("event_id")
    cursors = points.select("clip_id", i.alias("cursor_id"), (F.col("time_s") + (i % 50) * 1800).alias("at_s"))
    return J.nearest_in_time(points, cursors, KEY).select("clip_id", "cursor_id", "frame", r("time_s").alias("time_s"))


OPTIONS = """(SELECT *, list_filter(s, lambda e: e.n = list_max(list_transform(s, lambda o: o.n))) AS options FROM (SELECT *, list_transform(list_transform(p, lambda c: list_filter(p, lambda q: (q.x - c.x) ** 2 + (q.y - c.y) ** 2 <= 576)),
      lambda g: {{'n': len(g), 'dx': list_aggregate(list_transform(g, lambda q: q.x), 'median'), 'dy': list_aggregate(list_transform(g, lambda q: q.y), 'median')}}) AS s FROM {src}))"""
WALK = """SELECT clip_id, frame, dx, dy FROM (SELECT clip_id, -1 AS frame, 0e0 AS dx, 0e0 AS dy FROM pt GROUP BY clip_id) UNION ALL
      SELECT w.clip_id, o.frame, coalesce(list_sort(list_transform(options, lambda e, k: {{'d': (e.dx - w.dx) ** 2 + (e.dy - w.dy) ** 2, 'k': k, 'v': e}}))[1].v.dx, w.dx), coalesce(list_sort(list_transform(options, lambda e, k: {{'d': (e.dx - w.dx) ** 2 + (e.dy - w.dy) ** 2, 'k': k, 'v': e}}))[1].v.dy, w.dy)
      FROM {me} w JOIN {src} o ON o.clip_id = w.clip_id AND o.frame = w.frame + 1"""


@register(
    "estimate_shake",
    with_ctes(
        "SELECT clip_id, frame, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy FROM w2 WHERE frame >= 0",
        "pt",
        ("a", """SELECT clip_id, frame, k, CASE WHEN frame > 0 THEN event_id * 13 % 41 - 20 ELSE 0 END + j AS x, CASE WHEN frame > 0 THEN event_id * 7 % 23 - 11 ELSE 0 END - j AS y, frame > 0 AND ((event_id + k) % 6 = 0 OR event_id % 31 = 0) AS lost
          FROM (SELECT *, CASE WHEN frame > 0 AND k >= 2 + event_id % 2 AND event_id % 3 = 0 THEN 60 ELSE 0 END AS j FROM pt, range(5) r(k))"""),
        ("b1", "SELECT clip_id, frame, coalesce(list({'x': x::DOUBLE, 'y': y::DOUBLE} ORDER BY k) FILTER (NOT lost), []) AS p FROM a GROUP BY ALL"),
        ("o1", "SELECT * FROM " + OPTIONS.format(src="b1")),
        ("w1", WALK.format(me="w1", src="o1")),
        ("b2", "SELECT b.clip_id, b.frame, CASE WHEN b.frame = 0 THEN p ELSE list_filter(p, lambda q: (q.x - w.dx) ** 2 + (q.y - w.dy) ** 2 <= 576) END AS p FROM b1 b JOIN w1 w USING (clip_id, frame)"),
        ("o2", "SELECT * FROM " + OPTIONS.format(src="b2")),
        ("w2", WALK.format(me="w2", src="o2")),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def estimate_shake(spark, sf_dir):
    return rounded(ST.estimate_shake(V.shake_anchors(V.event_points(spark, sf_dir)), KEY), "dx", "dy")


@register(
    "pick_anchors",
    """WITH cells AS (SELECT vec_id, label, i // 16 AS corner, CAST(embedding[i + 1] AS DOUBLE) AS score, (i % 8) * 3 AS x, (i // 8) * 3 AS y FROM embeddings, range(64) g(i)),
    ok AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY vec_id, corner) AS peak FROM cells) WHERE score >= 0.2 * peak AND peak >= 1e-6),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, corner ORDER BY score DESC, x DESC, y DESC) AS rk FROM ok) WHERE rk = 1),
    two AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o.vec_id, o.corner ORDER BY o.score DESC, o.x DESC, o.y DESC) AS r2 FROM ok o JOIN one f ON f.vec_id = o.vec_id AND f.corner = o.corner
      WHERE (o.x - f.x) ** 2 + (o.y - f.y) ** 2 >= 64) WHERE r2 = 1)
    SELECT label AS clip_id, CAST(vec_id AS INT) AS frame, CAST(corner AS INT) AS corner, 0 AS rank, round(score, 6) AS score, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM one
    UNION ALL SELECT label, CAST(vec_id AS INT), CAST(corner AS INT), 1, round(score, 6), CAST(x AS DOUBLE), CAST(y AS DOUBLE) FROM two""",
)
def pick_anchors(spark, sf_dir):
    cells = V.table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), F.col("vec_id").cast("int").alias("frame"), F.posexplode("embedding").alias("i", "e"))
    cells = cells.select(
        "clip_id", "frame", F.floor(F.col("i") / 16).cast("int").alias("corner"), F.col("e").cast("double").alias("score"),
        ((F.col("i") % 8) * 3).cast("double").alias("x"), (F.floor(F.col("i") / 8) * 3).cast("double").alias("y"),
    )
    from pyspark.sql import Window as W

    peak = F.max("score").over(W.partitionBy("clip_id", "frame", "corner"))
    strong = cells.withColumn("peak", peak).filter("peak >= 1e-6 and score >= 0.2 * peak")
    return ST.pick_anchors(strong, KEY).withColumn("score", r("score"))
