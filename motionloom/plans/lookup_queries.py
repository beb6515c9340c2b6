"""Queries on lookups at asked frames, layers, shared contexts and usage totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins as J
from ..operators import lookup as L
from . import catalog as CT
from . import views as V
from .registry import r, register
from .sql_views import with_ctes
from .timeline_queries import SHAKE, SPARSE

KEY = V.KEY
CURSORS = ("cur", "SELECT clip_id, event_id AS cursor_id, frame + event_id % 41 - 20 AS asked FROM pt")


def _cursors(points):
    i = F.col("event_id")
    return points.select("clip_id", i.alias("cursor_id"), (F.col("frame") + i % 41 - 20).alias("asked"))


@register(
    "position_at_frame",
    with_ctes(
        """SELECT c.clip_id, c.cursor_id, round(CASE WHEN p.frame IS NULL THEN n.x WHEN n.frame IS NULL THEN p.x ELSE p.x + (n.x - p.x) * ((c.asked - p.frame) / (n.frame - p.frame)) END, 6) AS x,
          round(CASE WHEN p.frame IS NULL THEN n.y WHEN n.frame IS NULL THEN p.y ELSE p.y + (n.y - p.y) * ((c.asked - p.frame) / (n.frame - p.frame)) END, 6) AS y
        FROM cur c ASOF LEFT JOIN sp p ON p.clip_id = c.clip_id AND p.frame <= c.asked ASOF LEFT JOIN sp n ON n.clip_id = c.clip_id AND n.frame > c.asked""",
        "pt", SPARSE, CURSORS,
    ),
)
def position_at_frame(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    out = L.position_at(V.sparse_points(points), _cursors(points), KEY)
    return out.select("clip_id", "cursor_id", r("x").alias("x"), r("y").alias("y"))


@register(
    "stable_to_video",
    with_ctes(
        """SELECT p.clip_id, p.frame, round(p.x + coalesce(s.dx, 0), 6) AS x, round(p.y + coalesce(s.dy, 0), 6) AS y, TRUE AS back FROM pt p LEFT JOIN (SELECT clip_id, max(frame) AS last FROM shake GROUP BY clip_id) l USING (clip_id)
        LEFT JOIN shake s ON s.clip_id = p.clip_id AND s.frame = least(p.frame, l.last)""",
        "pt", SHAKE,
    ),
)
def stable_to_video(spark, sf_dir):
    """Points taken as stable ones, in video coordinates, and whether the way back ends at the point."""
    points = V.event_points(spark, sf_dir)
    shake = V.shake_offsets(points)
    moved = L.to_video(points.withColumns({"x0": F.col("x"), "y0": F.col("y")}), shake, KEY)
    there = moved.withColumns({"vx": F.col("x"), "vy": F.col("y")})
    home = J.compensate(there, shake, KEY)
    back = (F.abs(F.col("x") - F.col("x0")) < 1e-9) & (F.abs(F.col("y") - F.col("y0")) < 1e-9)
    return home.select("clip_id", "frame", r("vx").alias("x"), r("vy").alias("y"), back.alias("back"))


@register(
    "anchors_at_frame",
    with_ctes(
        """SELECT c.clip_id, c.cursor_id, coalesce(a.n, 0) AS n_anchors, a.xs AS xs FROM cur c LEFT JOIN (SELECT clip_id, max(frame) AS last FROM pt GROUP BY clip_id) l USING (clip_id)
        LEFT JOIN (SELECT clip_id, frame, count(*) FILTER (NOT lost)::INT AS n, coalesce(string_agg(CAST(x AS INT)::VARCHAR, ',' ORDER BY k) FILTER (NOT lost), '') AS xs FROM (
          SELECT clip_id, frame, k, (event_id + k) % 6 = 0 AND frame > 0 OR frame > 0 AND event_id % 31 = 0 AS lost,
            100 + k * 50 + CASE WHEN frame = 0 THEN 0 ELSE event_id * 13 % 41 - 20 END + CASE WHEN frame > 0 AND k >= 2 + event_id % 2 AND event_id % 3 = 0 THEN 60 ELSE 0 END AS x
          FROM pt, range(5) g(k)) GROUP BY clip_id, frame) a ON a.clip_id = c.clip_id AND a.frame = greatest(0, least(c.asked, l.last))""",
        "pt", CURSORS,
    ),
)
def anchors_at_frame(spark, sf_dir):
    points = V.event_points(spark, sf_dir)
    out = L.anchors_at(V.shake_anchors(points), _cursors(points), KEY)
    xs = F.array_join(F.transform("anchors", lambda a: a["x"].cast("int").cast("string")), ",")
    return out.select("clip_id", "cursor_id", F.size("anchors").alias("n_anchors"), xs.alias("xs"))


@register("track_layers", "SELECT DISTINCT user_id AS clip_id, left(sha256(user_id::VARCHAR), 10) AS track_id, 'track ' || user_id AS name, '#e4572e' AS color, 'done' AS status FROM events")
def track_layers(spark, sf_dir):
    tracks = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id")).distinct()
    return L.layers(tracks, KEY)


@register(
    "token_usage",
    """SELECT conv_id, sum(CASE WHEN role = 'user' AND turn % 5 <> 0 THEN length(text) ELSE 0 END)::BIGINT AS prompt_tokens, sum(CASE WHEN role <> 'user' AND turn % 5 <> 0 THEN length(text) ELSE 0 END)::BIGINT AS completion_tokens,
      sum(CASE WHEN turn % 5 <> 0 THEN length(text) ELSE 0 END)::BIGINT AS total_tokens FROM conversations GROUP BY conv_id""",
)
def token_usage(spark, sf_dir):
    """Totals a conversation; every fifth answer has no usage, and fields of others are missing or null."""
    size, asks = F.length("text"), F.col("role") == "user"
    answer = F.to_json(F.struct(F.when(F.col("turn") % 5 != 0, F.struct(F.when(asks, size).alias("prompt_tokens"), F.when(~asks, size).alias("completion_tokens"), size.alias("total_tokens"))).alias("usage")))
    rows = V.table(spark, sf_dir, "conversations").select("conv_id", text.usage(answer).alias("u"))
    return rows.groupBy("conv_id").agg(*[F.sum(F.col(f"u.{n}")).alias(n) for n in text.USAGE_FIELDS])


CONTEXT = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{\"results\":' || props || '}' WHEN 2 THEN '{\"video_path\":\"a\",\"results\":' || props || '}' ELSE '{\"inner\":{\"path\":\"a\"}}' END"


def _contexts(spark, sf_dir):
    i, props = F.col("event_id"), F.col("props")
    wrap = lambda head: F.concat(F.lit(head), props, F.lit("}"))
    context = F.when(i % 4 == 0, props).when(i % 4 == 1, wrap('{"results":')).when(i % 4 == 2, wrap('{"video_path":"a","results":')).otherwise('{"inner":{"path":"a"}}')
    return V.table(spark, sf_dir, "events").select("event_id", context.alias("context"))


@register("shareable_contexts", "SELECT event_id, CASE WHEN event_id % 4 = 2 THEN 'path' END AS leak FROM events")
def shareable_contexts(spark, sf_dir):
    """What keeps a context from being shared: a forbidden word, or a path among its own keys (not inside)."""
    return _contexts(spark, sf_dir).select("event_id", text.leaks_context(F.col("context")).alias("leak"))


@register(
    "report_messages",
    f"""SELECT event_id, 2 AS n_messages, sha256('system' || chr(10) || 'Use local numbers only.' || chr(10) || 'Answer with the sections as JSON.' || chr(10) || 'user' || chr(10)
      || '{{"teaching_level":"high","task":"experiment_report_sections","json":true,"context":' || {CONTEXT} || '}}' || chr(10)) AS messages_sha256 FROM events""",
)
def report_messages(spark, sf_dir):
    out = CT.report_messages(_contexts(spark, sf_dir), ["event_id"], "Use local numbers only.", "Answer with the sections as JSON.")
    whole = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["content"], F.lit("\n"))), "")
    return out.select("event_id", F.size("messages").alias("n_messages"), F.sha2(F.encode(whole, "utf-8"), 256).alias("messages_sha256"))
