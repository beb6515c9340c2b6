"""Queries on reports, context, charts, text helpers and small pixel arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels, text, ticks
from ..operators import kinematics as K
from ..operators import timeline as TL
from . import analysis as A
from . import catalog as CT
from . import views as V
from .registry import r, register, rounded
from .sql_views import analysis_ctes, with_ctes
from .physics_queries import MOTION_LEN, _motion_analysis

KEY = V.KEY


@register("privacy_documents", """SELECT doc_id, CASE WHEN contains(lower(text), 'api_key') THEN 'api_key' WHEN contains(lower(text), 'authorization') THEN 'authorization' WHEN contains(lower(text), 'sk-') THEN 'sk-' END AS leak FROM documents
  WHERE contains(lower(text), 'api_key') OR contains(lower(text), 'authorization') OR contains(lower(text), 'sk-')""")
def privacy_documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", text.leaks_secret(F.col("text")).alias("leak")).filter("leak is not null")


@register("privacy_pages", """SELECT page_id, CASE WHEN contains(lower(html), 'api_key') THEN 'api_key' WHEN contains(lower(html), 'authorization') THEN 'authorization' WHEN contains(lower(html), 'sk-') THEN 'sk-' END AS leak FROM pages""")
def privacy_pages(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", text.leaks_secret(F.col("html")).alias("leak"))


TAG = "CASE WHEN o_orderkey % 6 = 5 THEN 'v1.' || (o_custkey % 9) ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'v' ELSE '' END || (o_orderkey % 3) || '.' || (o_custkey % 12) || '.' || (o_orderkey % 17) END"
PARSED = f"""SELECT o_orderkey, {TAG} AS tag, o_orderkey % 6 <> 5 AS ok, [o_orderkey % 3, o_custkey % 12, o_orderkey % 17] AS v, o_orderkey % 13 = 0 AS draft FROM orders"""


@register(
    "release_status",
    f"""SELECT o_orderkey, tag, CASE WHEN draft THEN 'no_release' WHEN NOT ok THEN 'invalid' WHEN NOT v > [1, 5, 9] THEN 'latest' WHEN v = [2, 3, 4] THEN 'skipped' ELSE 'available' END AS status FROM ({PARSED})""",
)
def release_status(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda v: v.cast("string")
    tag = F.when(o % 6 == 5, F.concat(F.lit("v1."), s(c % 9))).otherwise(
        F.concat(F.when(o % 2 == 0, "v").otherwise(""), s(o % 3), F.lit("."), s(c % 12), F.lit("."), s(o % 17))
    )
    rows = V.table(spark, sf_dir, "orders").select("o_orderkey", tag.alias("tag"))
    status = text.release_status(F.col("tag"), F.lit("1.5.9"), F.col("o_orderkey") % 13 == 0, F.lit(False), F.lit("v2.3.4"))
    return rows.select("o_orderkey", "tag", status.alias("status"))


@register(
    "checksum_lists",
    """SELECT DISTINCT ON (c, name) c AS c_custkey, name, digest FROM (SELECT o_custkey AS c, 'file' || (o_orderkey % 4) AS name, sha256(CAST(o_orderkey AS VARCHAR)) AS digest, o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) ORDER BY c, name, o_orderkey DESC""",
)
def checksum_lists(spark, sf_dir):
    o = F.col("o_orderkey")
    digest = F.sha2(o.cast("string"), 256)
    line = F.concat(
        F.when(o % 5 == 0, F.lit("# ")).otherwise(""), F.when(o % 2 == 0, F.upper(digest)).otherwise(digest), F.lit("  "),
        F.when(o % 3 == 0, "*").otherwise(""), F.when(o % 7 == 0, "dist/").otherwise(""), F.lit("file"), (o % 4).cast("string"),
    )
    lists = V.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), line.alias("l")))), lambda e: e["l"])).alias("body")
    )
    return lists.select(F.col("o_custkey").alias("c_custkey"), F.explode(text.checksums(F.col("body"))).alias("name", "digest"))


@register(
    "sse_payloads",
    """SELECT conv_id, list_sort(list(turn) FILTER (turn < coalesce(cut, 99)))::VARCHAR AS turns FROM (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 2 END AS cut FROM conversations) WHERE turn < coalesce(cut, 99) GROUP BY conv_id""",
)
def sse_payloads(spark, sf_dir):
    t = F.col("turn")
    line = F.concat(F.lit(": ping\nevent: delta\ndata: "), F.when((F.col("conv_id") % 3 == 0) & (t == 2), "[DONE]").otherwise(F.to_json(F.struct(t))), F.lit("\n"))
    streams = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(t, line.alias("l")))), lambda e: e["l"])).alias("body")
    )
    data = F.transform(text.sse_data(F.col("body")), lambda d: F.get_json_object(d, "$.turn"))
    return streams.select("conv_id", F.concat(F.lit("["), F.concat_ws(", ", data), F.lit("]")).alias("turns"))


@register("json_answers", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_answers(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Sure!\n```json\n"), "props", F.lit("\n```\nDone.")).alias("answer"))
    return e.select("event_id", F.get_json_object(text.json_object(F.col("answer")), "$.k").cast("int").alias("k"))


def _nice(span: str) -> str:
    p = f"pow(10e0, floor(log10({span})))"
    return f"CASE WHEN {span} / {p} < 1.5 THEN {p} WHEN {span} / {p} < 3 THEN 2 * {p} WHEN {span} / {p} < 7 THEN 5 * {p} ELSE 10 * {p} END"


@register(
    "axis_ticks",
    with_ctes(
        f"""SELECT clip_id, round(st, 9) AS step, round(floor(lo / st) * st, 6) + 0.0 AS start, round(CASE WHEN ceil(hi / st) <= floor(lo / st) THEN floor(lo / st) + 1 ELSE ceil(hi / st) END * st, 6) + 0.0 AS "end",
        CAST(CASE WHEN st >= 1 - 1e-12 THEN 0 ELSE greatest(0, least(6, -floor(log10(st) + 1e-12))) END AS INT) AS decimals FROM (SELECT *, {_nice('(hi - lo) / 4e0')} AS st FROM (SELECT clip_id, min(x) AS lo, max(x) AS hi FROM pt GROUP BY clip_id))""", "pt",
    ),
)
def axis_ticks(spark, sf_dir):
    ext = V.event_points(spark, sf_dir).groupBy("clip_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = ext.withColumn("step", ticks.tick_interval(F.col("lo"), F.col("hi"), 5))
    rows = rows.withColumn("a", ticks.axis(F.col("lo"), F.col("hi"), F.col("step")))
    return rows.select("clip_id", r("step", 9).alias("step"), r("a.start").alias("start"), r("a.end").alias("end"), ticks.label_decimals(F.col("step")).alias("decimals"))


@register(
    "mask_centroids",
    """SELECT vec_id, round(avg(i % 8), 6) AS x, round(avg(i // 8), 6) AS y, least(1e0, count(*) / 64e0) AS confidence, CAST(min(i % 8) AS DOUBLE) AS x0, CAST(max(i // 8) AS DOUBLE) AS y1 FROM embeddings, range(64) g(i) WHERE embedding[i + 1] > 0 GROUP BY vec_id""",
)
def mask_centroids(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    c = e.select("vec_id", pixels.mask_centroid(pixels.mask_of(F.col("embedding")), 8).alias("c")).filter("c.visible")
    return c.select("vec_id", r("c.x").alias("x"), r("c.y").alias("y"), "c.confidence", "c.x0", "c.y1")


@register(
    "weighted_centroids",
    """SELECT vec_id, round(sum(w * (i % 8)) / sum(w), 6) AS x, round(sum(w * (i // 8)) / sum(w), 6) AS y FROM (SELECT vec_id, i, greatest(0e0, CAST(embedding[i + 1] AS DOUBLE)) AS w FROM embeddings, range(64) g(i)) GROUP BY vec_id""",
)
def weighted_centroids(spark, sf_dir):
    w = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), v.cast("double")))
    c = V.table(spark, sf_dir, "embeddings").select("vec_id", pixels.weighted_centroid(w, 8).alias("c"))
    return c.select("vec_id", r("c.x").alias("x"), r("c.y").alias("y"))


@register(
    "subpixel_minimum",
    """SELECT vec_id, m AS at, round(CASE WHEN b > 1e-9 THEN greatest(-1e0, least(1e0, 0.25e0 * (l - h) / b)) ELSE 0e0 END, 6) + 0.0 AS "offset", round(CASE WHEN b > 1e-9 THEN sqrt(greatest(2e0 * c / b, 0e0)) END, 6) AS width FROM (
      SELECT *, 0.5e0 * (l + h) - c AS b FROM (SELECT vec_id, m, list_extract(s, m) AS l, list_extract(s, m + 1) AS c, list_extract(s, m + 2) AS h FROM (
        SELECT vec_id, s, CAST(list_position(s, list_min(s[2:63])) - 1 AS INT) AS m FROM (SELECT vec_id, list_transform(embedding, lambda v: (CAST(v AS DOUBLE) + 1) ** 2) AS s FROM embeddings)) WHERE m BETWEEN 1 AND 62))""",
)
def subpixel_minimum(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.pow(v.cast("double") + 1, 2)).alias("s"))
    e = e.withColumn("at", (F.array_position("s", F.array_min(F.slice("s", 2, 62))) - 1).cast("int")).filter("at between 1 and 62")
    at = lambda d: F.get("s", F.col("at") + d)
    p = e.select("vec_id", "at", pixels.parabolic_offset(at(-1), at(0), at(1)).alias("p"))
    return p.select("vec_id", "at", r("p.offset").alias("offset"), r("p.width").alias("width"))


@register(
    "formula_lookup",
    with_ctes(
        "SELECT clip_id, formula_id FROM ranked JOIN (VALUES " + ", ".join(f"('{f}', '{k}')" for f, k, _ in CT.FORMULAS) + ") t(formula_id, k) ON k = kind WHERE auto",
        "mp_raw", "mp", "mdisp", *analysis_ctes("mp", "clip_id % 2 = 0", MOTION_LEN, False, "mdisp"),
    ),
)
def formula_lookup(spark, sf_dir):
    picked = _motion_analysis(spark, sf_dir).select("clip_id", F.col("selected.experiment_type").alias("experiment_type")).filter("experiment_type is not null")
    return CT.formulas_for(picked).select("clip_id", "formula_id")


@register("teaching_context")
def teaching_context(spark, sf_dir):
    points = V.motion_points(spark, sf_dir)
    samples = K.series(points, KEY, calibration=V.motion_calibrations(spark, sf_dir))
    return CT.teaching_context(CT.pick_candidate(_motion_analysis(spark, sf_dir), None), TL.representative_points(samples, KEY), KEY)


@register("report_markdown")
def report_markdown(spark, sf_dir):
    picked = CT.pick_candidate(_motion_analysis(spark, sf_dir), None)
    return CT.report_markdown(picked, KEY, F.lit("2024-01-01 00:00"))


@register(
    "chat_messages",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
    said AS (SELECT conv_id, turn, role, text FROM k WHERE back <= 12 AND role IN ('user', 'assistant') AND length(trim(text, ' \t\n\r')) > 0)
    SELECT c.conv_id, 2 + count(s.turn) AS n_messages, sha256('system' || chr(10) || 'Use local numbers only.' || chr(10) || coalesce(string_agg(s.role || chr(10) || s.text || chr(10), '' ORDER BY s.turn), '')
      || 'user' || chr(10) || 'Why is g not 9.8?' || chr(10)) AS messages_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN said s USING (conv_id) GROUP BY c.conv_id""",
)
def chat_messages(spark, sf_dir):
    talks = V.table(spark, sf_dir, "conversations")
    kept = TL.last_messages(talks, ["conv_id"], "turn", 12)
    said = F.col("role").isin("user", "assistant") & (F.length(F.trim(F.col("text"), F.lit(" \t\n\r"))) > 0)
    history = kept.filter(said).select("conv_id", "turn", "role", F.col("text").alias("content"))
    questions = talks.select("conv_id").distinct().withColumn("question", F.lit("Why is g not 9.8?"))
    out = CT.chat_messages(history, questions, ["conv_id"], "Use local numbers only.")
    whole = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["content"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.sha2(F.encode(whole, "utf-8"), 256).alias("messages_sha256"))


@register(
    "track_fingerprints",
    with_ctes(
        """SELECT clip_id, left(sha256(concat_ws('|', count(*)::VARCHAR, sum(('0x' || substr(h, 1, 12))::HUGEINT)::VARCHAR, sum(('0x' || substr(h, 13, 12))::HUGEINT)::VARCHAR, sum(('0x' || substr(h, 25, 12))::HUGEINT)::VARCHAR)), 24) AS fingerprint, TRUE AS edit_seen
        FROM (SELECT clip_id, sha256(concat_ws('|', frame::VARCHAR, printf('%.4f', x), printf('%.4f', y), visible::VARCHAR, printf('%.4f', confidence), manual::VARCHAR)) AS h FROM pt) GROUP BY clip_id""",
        "pt",
    ),
)
def track_fingerprints(spark, sf_dir):
    """Tokens of all tracks, and whether one changed confidence changes them."""
    points = V.event_points(spark, sf_dir)
    before = CT.fingerprint_points(points, KEY)
    edited = points.withColumn("confidence", F.when(F.col("frame") == 0, F.col("confidence") + 0.5).otherwise(F.col("confidence")))
    after = CT.fingerprint_points(edited, KEY).withColumnRenamed("fingerprint", "f2")
    return before.join(after, KEY).select("clip_id", "fingerprint", (F.col("fingerprint") != F.col("f2")).alias("edit_seen"))
