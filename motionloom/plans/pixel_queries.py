"""Queries on frames held as arrays: the vectors of `embeddings` as 8x8 gray frames, a label as a clip."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import images
from ..operators import stabilize, templates
from . import views as V
from .registry import r, register, rounded

SIDE = 8
GRAY = "list_transform(embedding, lambda v: 128 + 400 * CAST(v AS DOUBLE))"
FRAMES = f"SELECT label, vec_id AS frame, {GRAY} AS g FROM embeddings"


def frames(spark, sf_dir):
    """label, frame, width, gray, planes (the gray one alone)."""
    gray = F.transform("embedding", lambda v: v.cast("double") * 400 + 128)
    rows = V.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("frame"), F.lit(SIDE).alias("width"), gray.alias("gray"))
    return rows.withColumn("planes", F.array("gray"))


def with_previous(rows, column):
    """Rows with `source`, the column of the frame before in the clip, searched from the middle on."""
    before = F.lag(column).over(W.partitionBy("label").orderBy("frame"))
    return rows.withColumn("source", before).filter("source IS NOT NULL")


CELLS = f"""f AS ({FRAMES}),
  p AS (SELECT label, frame, g, i, i % 8 AS x, i // 8 AS y FROM f, range(64) r(i)),
  e AS (SELECT label, frame, x, y, ((g[i + 1 + (x < 7)::INT] - g[i + 1 - (x > 0)::INT]) / (CASE WHEN x BETWEEN 1 AND 6 THEN 2 ELSE 1 END)) ** 2
             + ((g[i + 1 + 8 * (y < 7)::INT] - g[i + 1 - 8 * (y > 0)::INT]) / (CASE WHEN y BETWEEN 1 AND 6 THEN 2 ELSE 1 END)) ** 2 AS score FROM p),
  c AS (SELECT *, x // 4 + 2 * (y // 4) AS corner, (x % 4) // 2 + 2 * ((y % 4) // 2) AS cell FROM e),
  k AS (SELECT *, max(score) OVER (PARTITION BY frame, corner) AS peak, row_number() OVER (PARTITION BY frame, corner, cell ORDER BY score DESC, y, x) AS n FROM c),
  cells AS (SELECT * FROM k WHERE n = 1 AND score >= 0.2 * peak AND peak >= 1e-6 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6)"""


def small_cells(spark, sf_dir):
    return templates.corner_grid(frames(spark, sf_dir), ["label"], least=4, grid=2, pad=1)


@register("corner_grid", f"WITH {CELLS} SELECT label, frame, corner::INT AS corner, x::DOUBLE AS x, y::DOUBLE AS y, round(score, 4) AS score FROM cells")
def corner_grid(spark, sf_dir):
    return small_cells(spark, sf_dir).withColumn("score", r("score", 4))


@register(
    "corner_anchors",
    f"""WITH {CELLS} SELECT label, frame, corner::INT AS corner, 0 AS rank, x::DOUBLE AS x, y::DOUBLE AS y FROM (SELECT *, row_number() OVER (PARTITION BY frame, corner ORDER BY score DESC, x DESC, y DESC) AS best FROM cells) WHERE best = 1""",
)
def corner_anchors(spark, sf_dir):
    """Anchors of one corner are 8 px apart, so a 4x4 corner has one."""
    return stabilize.pick_anchors(small_cells(spark, sf_dir), ["label"]).select("label", "frame", "corner", "rank", "x", "y")


@register(
    "ncc_match",
    f"""WITH f AS (SELECT *, lag(g) OVER (PARTITION BY label ORDER BY frame) AS s FROM ({FRAMES})),
  w AS (SELECT label, frame, x, y, k, g[(y - 1 + k // 3) * 8 + x + k % 3] AS w, s[(2 + k // 3) * 8 + 3 + k % 3] AS t FROM f, range(1, 7) a(x), range(1, 7) b(y), range(9) c(k) WHERE s IS NOT NULL),
  n AS (SELECT label, frame, x, y, covar_pop(w, t) AS c, stddev_pop(w) AS sw, stddev_pop(t) AS st FROM w GROUP BY ALL),
  m AS (SELECT *, CASE WHEN 9 * sw * st < 1e-6 THEN -1 ELSE c / (sw * st) END AS score, greatest(abs(x - 3), abs(y - 3)) AS off FROM n WHERE st >= 8),
  b AS (SELECT label, frame, reach, arg_max({{'x': x, 'y': y, 'score': score}}, {{'a': round(score, 12), 'b': -y, 'c': -x}}) AS best FROM m, (VALUES (1), (2), (8)) v(reach) WHERE off <= reach GROUP BY ALL)
  SELECT label, frame, best.x::DOUBLE AS found_x, best.y::DOUBLE AS found_y, round(best.score, 6) + 0.0 AS score, best.score >= 0.42 AS accepted
  FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (reach = 8 OR best.score >= 0.42) DESC, reach) AS n FROM b) WHERE n = 1""",
)
def ncc_match(spark, sf_dir):
    """Each frame's middle looked for in the next frame of its clip."""
    pairs = with_previous(frames(spark, sf_dir), "gray").withColumns({"x": F.lit(3.0), "y": F.lit(3.0)})
    return rounded(templates.ncc_match(pairs, ["label"], side=3, searches=(1, 2, 8, 8)), "score")


@register(
    "ssd_match",
    f"""WITH f AS (SELECT *, lag(g) OVER (PARTITION BY label ORDER BY frame) AS s FROM ({FRAMES})),
  t AS (SELECT label, frame, g, s, list_transform(range(9), lambda k: s[(3 + k // 3) * 8 + 4 + k % 3]) AS t FROM f WHERE s IS NOT NULL),
  d AS (SELECT label, frame, x, y, sum((1 + 0.25 + 4) * (g[(y + k // 3) * 8 + x + k % 3 + 1] - t[k + 1]) ** 2) AS d
        FROM t, range(6) a(x), range(6) b(y), (VALUES (1), (3), (4), (5), (7)) m(k) GROUP BY ALL),
  q AS (SELECT label, frame, avg(d) AS mean, min(d) AS least, arg_min({{'x': x, 'y': y}}, {{'d': d, 'y': y, 'x': x}}) AS p, map_from_entries(list({{'k': y * 6 + x, 'v': d}})) AS m FROM d GROUP BY ALL),
  n AS (SELECT *, CASE WHEN p.x BETWEEN 1 AND 4 THEN m[p.y * 6 + p.x - 1] END AS l, CASE WHEN p.x BETWEEN 1 AND 4 THEN m[p.y * 6 + p.x + 1] END AS r,
               CASE WHEN p.y BETWEEN 1 AND 4 THEN m[p.y * 6 + p.x - 6] END AS u, CASE WHEN p.y BETWEEN 1 AND 4 THEN m[p.y * 6 + p.x + 6] END AS o FROM q),
  c AS (SELECT *, (l + r) / 2 - least AS bx, (u + o) / 2 - least AS bend FROM n),
  z AS (SELECT *, CASE WHEN bx > 1e-9 THEN greatest(-1, least(1, (l - r) / 4 / bx)) ELSE 0 END AS dx, CASE WHEN bend > 1e-9 THEN greatest(-1, least(1, (u - o) / 4 / bend)) ELSE 0 END AS dy,
               list_avg(list_filter([CASE WHEN bx > 1e-9 THEN sqrt(2 * least / bx) END, CASE WHEN bend > 1e-9 THEN sqrt(2 * least / bend) END], lambda v: v IS NOT NULL)) AS spread,
               CASE WHEN least <= 1e-9 THEN 'inf'::DOUBLE ELSE greatest(mean / least - 1, 0) END AS peak FROM c)
  SELECT label, frame, round(p.x + 1.5 + dx, 6) AS found_x, round(p.y + 1.5 + dy, 6) AS found_y, round(CASE WHEN peak = 'inf'::DOUBLE THEN 1 ELSE pk / (pk + 4) END, 6) AS confidence
  FROM (SELECT *, CASE WHEN spread > 1 THEN peak / spread ELSE peak END AS pk FROM z)""",
)
def ssd_match(spark, sf_dir):
    """Three channels (gray, its half inverted, its double); the template is a round one of 3 px."""
    planes = F.array("gray", F.transform("gray", lambda v: 255 - v * 0.5), F.transform("gray", lambda v: v * 2))
    pairs = with_previous(frames(spark, sf_dir).withColumn("planes", planes), "planes").withColumns({"x": F.lit(4.9), "y": F.lit(4.9)})
    found = templates.ssd_match(pairs, ["label"], template=(3, 3), radius=8)
    return rounded(found, "found_x", "found_y", "confidence")


#: A cross, for peaks of an 8x8 frame.
CROSS = (("centre", 0, 0), ("right", 2, 0), ("left", -2, 0), ("down", 0, 2), ("up", 0, -2))
PEAKS = f"""f AS ({FRAMES}),
  s AS (SELECT label, frame, i, (i % 8)::DOUBLE AS x, (i // 8)::DOUBLE AS y FROM f, range(9, 55) r(i)
        WHERE i % 8 BETWEEN 1 AND 6 AND g[i + 1] >= 160 AND g[i + 1] >= g[i] AND g[i + 1] >= g[i + 2] AND g[i + 1] >= g[i - 7] AND g[i + 1] >= g[i + 9]),
  p AS (SELECT label, frame, list({{'x': x, 'y': y}} ORDER BY i) AS peaks FROM s GROUP BY ALL)"""


def peaks_of(spark, sf_dir):
    rows = frames(spark, sf_dir).select("label", "frame", images.bright_peaks(F.col("gray"), F.col("width"), 160.0).alias("peaks"))
    return rows.filter(F.size("peaks") > 0)


@register(
    "merged_peaks",
    f"""WITH {PEAKS}, a AS (SELECT *, list_reduce(list_prepend([]::STRUCT(x DOUBLE, y DOUBLE)[], list_transform(peaks, lambda q: [q])),
      lambda acc, q: CASE WHEN len(list_filter(acc, lambda c: abs(c.x - q[1].x) <= 1 AND abs(c.y - q[1].y) <= 1)) > 0 THEN acc ELSE acc || q END) AS leads FROM p),
    b AS (SELECT label, frame, q, list_position(list_transform(leads, lambda c: abs(c.x - q.x) <= 1 AND abs(c.y - q.y) <= 1), true) AS cluster FROM (SELECT label, frame, leads, unnest(peaks) AS q FROM a))
    SELECT label, frame, (cluster - 1)::INT AS cluster, round(avg(q.x), 6) AS x, round(avg(q.y), 6) AS y FROM b GROUP BY ALL""",
)
def merged_peaks(spark, sf_dir):
    merged = images.merge_peaks(F.col("peaks"), 1.0)
    rows = peaks_of(spark, sf_dir).select("label", "frame", F.posexplode(merged).alias("cluster", "p"))
    return rows.select("label", "frame", "cluster", r("p.x").alias("x"), r("p.y").alias("y"))


@register(
    "assign_keypoints",
    f"""WITH RECURSIVE {PEAKS},
  t(step, name, dx, dy) AS (VALUES {", ".join(f"({k + 1}, '{n}', {dx}, {dy})" for k, (n, dx, dy) in enumerate(CROSS))}),
  w AS (SELECT label, frame, k AS origin, 0 AS step, peaks[k].x AS ox, peaks[k].y AS oy, peaks AS free, []::STRUCT(name VARCHAR, x DOUBLE, y DOUBLE, confidence DOUBLE)[] AS given, 0 AS hits
        FROM (SELECT *, unnest(range(1, len(peaks) + 1)) AS k FROM p WHERE len(peaks) >= 4)
        UNION ALL
        SELECT label, frame, origin, step, ox, oy, CASE WHEN hit THEN list_filter(free, lambda q, j: j <> near.k) ELSE free END,
               list_append(given, CASE WHEN hit THEN {{'name': name, 'x': near.q.x, 'y': near.q.y, 'confidence': 0.95::DOUBLE}} ELSE {{'name': name, 'x': tx, 'y': ty, 'confidence': CASE WHEN near IS NULL THEN 0.4 ELSE 0.55 END::DOUBLE}} END), hits + hit::INT
        FROM (SELECT *, coalesce(near.d <= 2.25, false) AS hit FROM (
              SELECT w.* REPLACE (t.step AS step), name, ox + dx AS tx, oy + dy AS ty, list_sort(list_transform(free, lambda q, j: {{'d': (q.x - ox - dx) ** 2 + (q.y - oy - dy) ** 2, 'k': j, 'q': q}}))[1] AS near
              FROM w JOIN t ON t.step = w.step + 1))),
  o AS (SELECT label, frame, given, hits, row_number() OVER (PARTITION BY frame ORDER BY hits DESC, origin) AS n FROM w WHERE step = {len(CROSS)})
  SELECT label, frame, g.name AS name, g.x AS x, g.y AS y, g.confidence AS confidence FROM (SELECT label, frame, unnest(given) AS g FROM o WHERE n = 1 AND hits >= 3)""",
)
def assign_keypoints(spark, sf_dir):
    given = images.assign_keypoints(F.col("peaks"), CROSS, reach=1.5, least_hits=3)
    return peaks_of(spark, sf_dir).select("label", "frame", F.inline(given))


@register(
    "plane_corners",
    """WITH p AS (SELECT l_orderkey, {'l': l_linenumber, 'q': l_quantity, 'p': l_extendedprice} AS ord, l_partkey % 5 AS id, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem),
  a AS (SELECT l_orderkey, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, count(DISTINCT id) FILTER (id < 4) = 4 AS by_id,
               [arg_max({'x': x, 'y': y}, ord) FILTER (id = 0), arg_max({'x': x, 'y': y}, ord) FILTER (id = 1), arg_max({'x': x, 'y': y}, ord) FILTER (id = 3), arg_max({'x': x, 'y': y}, ord) FILTER (id = 2)] AS c FROM p GROUP BY l_orderkey)
  SELECT l_orderkey, k::INT AS corner, CASE WHEN by_id THEN c[k + 1].x ELSE [lx, hx, hx, lx][k + 1] END AS x, CASE WHEN by_id THEN c[k + 1].y ELSE [hy, hy, ly, ly][k + 1] END AS y, by_id FROM a, range(4) r(k)""",
)
def plane_corners(spark, sf_dir):
    """Lines of an order as detected corners of a board of 3x3 squares; orders lack none, some or all of its ids."""
    points = V.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_quantity", "l_extendedprice").alias("ord"), (F.col("l_partkey") % 5).alias("id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return templates.plane_corners(points, ["l_orderkey"], (3, 3))
