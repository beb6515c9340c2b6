"""The opN_ queries over the given tables and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import chat, decontaminate, fingerprint, lexical, line_dedup, lm_score, near_dup, packing, secrets, simhash, toxicity, turn_repair, url_filter
from .shared import inline_rows, table, text_digest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


#: (host, path, verdict): fixed values of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@register(
    "op5_url_filters",
    r"""
    WITH p AS (
        SELECT row_number() OVER () AS row, page_id,
               translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    r(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    m AS (SELECT p.row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(v, length(rule_host || rule_path)) AS v
          FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY p.row)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (row)
    """,
)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), inline_rows(spark, "host, path, verdict", RULES))


@register(
    "op2_chat_formatting",
    r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, length(regexp_replace(regexp_replace(replace(role || chr(0) || text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) - 1 + 20 AS size FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(size)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(inline_rows(spark, "conv_id, turn, role, text", [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]))
    read = chat.read_back(chat.render(chat.fold(chat.log_of_turns(turns))))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        text_digest(spoken).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        text_digest(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@register(
    "op3_line_dedup",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    l AS (SELECT row, doc_id, lines, list_transform(lines, lambda x: len(regexp_extract_all(x, '[^ ]+'))) AS words FROM d WHERE text IS NOT NULL),
    s(size) AS (VALUES (1), (2), (3)),
    w AS (SELECT row, doc_id, pos, size, array_to_string(lines[pos + 1 : pos + size], chr(10)) AS body, list_sum(words[pos + 1 : pos + size]) AS words
          FROM (SELECT l.*, size, unnest(range(0, len(lines) - size + 1)) AS pos FROM l, s)
          UNION ALL SELECT row, doc_id, 0, len(lines), array_to_string(lines, chr(10)), list_sum(words) FROM l WHERE len(lines) < 3),
    k AS (SELECT *, len(string_split(body, chr(10))) AS n FROM w),
    f AS (SELECT DISTINCT k.row, doc_id, pos, size, body, n FROM k JOIN (SELECT row, len(lines) AS total FROM l) USING (row)
          WHERE (size = 3 OR words >= 50 OR total < 3) AND words >= 1 AND (size = 3 OR words >= 50 OR (pos = 0 AND size = total))),
    b AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, pos) AS rank FROM f),
    c AS (SELECT row, list_distinct(flatten(list(range(pos, pos + size)))) AS covered FROM b WHERE rank > 1 GROUP BY row),
    o AS (SELECT d.doc_id, d.lines, coalesce(covered, []) AS covered, d.text FROM d LEFT JOIN c USING (row))
    SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, len(covered)::BIGINT AS n_removed,
           sha256(coalesce(array_to_string(list_transform(list_filter(range(0, len(lines)), lambda i: NOT list_contains(covered, i)), lambda i: lines[i + 1]), chr(10)), '')) AS clean_sha256
    FROM o
    """,
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_removed", text_digest(F.coalesce("text", F.lit(""))).alias("clean_sha256"))


@register(
    "op9_decontamination",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                      list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
    i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
    p AS (SELECT DISTINCT item_id, least(len(words), 13) AS size, array_to_string(words[s + 1 : s + 13], ' ') AS body
          FROM (SELECT *, unnest(range(0, greatest(len(words) - 12, 1))) AS s FROM i WHERE len(words) > 0)),
    z AS (SELECT DISTINCT size FROM p),
    w AS (SELECT row, s, size, array_to_string(words[s + 1 : s + size], ' ') AS body FROM (SELECT d.*, size, unnest(range(0, len(words) - size + 1)) AS s FROM d, z)),
    h AS (SELECT row, item_id, s, w.size FROM w JOIN p USING (size, body)),
    n AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(s, s + size)) AS pos FROM h) GROUP BY row),
    k AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h) GROUP BY row)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM d LEFT JOIN n USING (row) LEFT JOIN k USING (row)
    """,
)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_secret_scans")
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL side: the spans column also holds those of the fitted model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.report(secrets.scan(docs, secrets.train(docs)))


@register("op8_document_fingerprints")
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL side: DuckDB has not this hash."""
    return fingerprint.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL side: DuckDB has no tokenizer."""
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL side: the weights are learned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


@register("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of every document by the rest of the corpus; no SQL side at whole size."""
    return lm_score.score(table(spark, sf_dir, "documents"), order=3)


@register("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL side: all pairs are too slow on whole tables."""
    return near_dup.classes(table(spark, sf_dir, "documents"), k=4)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's faults by crc32 of `conv_id:turn`; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "utf-8")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = turns.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), draw.alias("draw"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("draw <> 0").select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


@register(
    "op11_turn_repair",
    r"""
    WITH RECURSIVE k AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    c AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)),
                 lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS draw FROM k),
    b AS (SELECT coalesce(conv_id, -9000000000000000000) AS conv, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
                 CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
          FROM c WHERE draw <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM b),
    f AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^ 	-
]') AS blank,
                 row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS seen,
                 regexp_extract(text, '(?s)([^ 	-
])[ 	-
]*\z', 1) NOT IN ('.', '!', '?') AS open,
                 lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY n) || left(role, 1) AS pair FROM o),
    ids AS (SELECT DISTINCT conv_id, coalesce(conv_id, -9000000000000000000) AS conv FROM conversations),
    m AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
                 count(*) FILTER (NOT blank AND NOT seen AND open) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM f GROUP BY conv),
    ins(p, more, fee, q) AS (VALUES (0, '', 0, 0), (1, '', 0, 1), (2, '', 0, 2), (3, '', 0, 3), (0, 'I', 5, 2), (1, 'I', 5, 2), (2, 'I', 5, 3), (3, 'I', 5, 2), (0, 'II', 10, 3), (1, 'II', 10, 3), (2, 'II', 10, 2), (3, 'II', 10, 3)),
    step(q, want, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
    e AS (SELECT conv, n, q, q AS r, 2 AS fee, 'D' AS letter FROM f, (VALUES (0), (1), (2), (3)) AS v(q)
          UNION ALL SELECT conv, n, q, r, CASE WHEN open THEN 5 ELSE 0 END + CASE WHEN ini = want THEN 0 ELSE 1 END, CASE WHEN ini = want THEN 'K' ELSE 'R' END
          FROM f, step WHERE NOT blank AND NOT seen AND (ini = want OR want <> 's')),
    walk AS (SELECT conv, 0::BIGINT AS n, 0 AS p, {'cost': 0::BIGINT, 'audit': ''} AS best FROM m
          UNION ALL SELECT w.conv, w.n + 1, e.r, min({'cost': w.best.cost + ins.fee + e.fee, 'audit': w.best.audit || ins.more || e.letter})
          FROM walk w JOIN ins ON ins.p = w.p JOIN e ON e.conv = w.conv AND e.n = w.n + 1 AND e.q = ins.q GROUP BY w.conv, w.n, e.r),
    a AS (SELECT w.conv, min({'cost': w.best.cost + ins.fee, 'audit': w.best.audit || ins.more}) AS best FROM walk w JOIN m ON m.conv = w.conv AND m.rows = w.n JOIN ins USING (p) WHERE ins.q IN (0, 3) GROUP BY w.conv),
    x AS (SELECT conv, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS i FROM a),
    y AS (SELECT conv, i, audit[i] AS letter, length(replace(left(audit, i), 'I', '')) AS n, length(replace(left(audit, i), 'D', '')) - 1 + length(replace(audit, 'D', '')) % 2 AS place FROM x),
    z AS (SELECT y.conv, sha256(string_agg(CASE letter WHEN 'K' THEN f.role ELSE CASE WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY i)) AS sha
          FROM y LEFT JOIN f ON f.conv = y.conv AND f.n = y.n AND letter <> 'I' WHERE letter <> 'D' GROUP BY y.conv)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM ids LEFT JOIN m USING (conv) LEFT JOIN a USING (conv) LEFT JOIN z USING (conv)
    """,
)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = damaged(conversations)
    found = stored(turn_repair.audits(turns))
    hashes = turn_repair.digests(turn_repair.repaired(turns, found)).select(F.col("conv_id").alias("_hashed"), "sha256")
    same = lambda other: F.col("conv_id").eqNullSafe(F.col(other))
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found.withColumnRenamed("conv_id", "_found"), same("_found"), "left").join(hashes, same("_hashed"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", text_digest(F.lit(""))).alias("repaired_sha256"))


@register(
    "op12_lexical_search",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
    i AS (SELECT row_number() OVER () AS item, item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark),
    s AS (SELECT count(*)::BIGINT AS nd, sum(len(words))::BIGINT AS nt FROM d WHERE len(words) > 0),
    q AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(words) AS term FROM i) GROUP BY ALL),
    p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, nd),
    c AS (SELECT row, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(words) * nd) // nt)) AS impact FROM p JOIN d USING (row), s),
    r AS (SELECT item, row, sum(times * weight * impact)::BIGINT AS score FROM q JOIN w USING (term) JOIN c USING (term) GROUP BY item, row),
    o AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r JOIN d USING (row) WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o JOIN i USING (item) WHERE rank <= 10
    """,
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_simhash_near_dedup")
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL side: DuckDB has not this hash."""
    return simhash.classes(table(spark, sf_dir, "documents"))
