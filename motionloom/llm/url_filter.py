"""URL verdicts from host and path rules.

A rule (host, path, verdict) fits its host and every subdomain if the url's path starts with the
rule's. Each url is expanded into host-suffix and path-prefix expressions, joined with the rules on
a short digest prefix, then full digests and the rule's whole path confirm; the longest rule wins,
a block before an allow of the same length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, small_side

SHORT_DIGITS = 8  # hex digits of the joined digest prefix


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def _folder(path: Column) -> Column:
    """Up to its last slash: the prefix under which a rule is indexed."""
    return F.regexp_extract(path, r"^(?s)(.*/|)", 1)


def indexed_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path); of equal rules a block wins."""
    rules = rules.filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull())
    rules = rules.groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    digest = _digest(F.col("rule_host"), _folder(F.col("rule_path")))
    return rules.withColumns({"rule_digest": digest, "short": F.substring(digest, 1, SHORT_DIGITS)})


def expressions(host: Column, path: Column, labels: int, folders: int) -> Column:
    """Host suffixes of up to `labels` labels, each with path prefixes of up to `folders` slashes.

    No rule is longer, so longer expressions could not match.
    """
    parts, steps = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    depth = F.least(F.size(steps) - 1, F.lit(folders))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.array_join(F.slice(steps, F.lit(1), n), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    prefixes = F.concat(F.array(F.lit("")), prefixes)
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of `pages`: id, host, path, rule, verdict.

    Null urls, or ones without `://`, have empty host and path and get `default`; repeated rows
    stay repeated; an empty rule table gives `default` everywhere. Other columns are not read.
    """
    known = indexed_rules(rules)
    most = known.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("rule_path", "/")) - 1)).first()
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("page_id"),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
    )
    looked = rows.withColumn("digest", F.explode(expressions(F.col("host"), F.col("path"), most[0] or 1, most[1] or 0)))
    found = looked.withColumn("short", F.substring("digest", 1, SHORT_DIGITS)).join(small_side(known), "short", "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path")
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.when(fits, F.struct(F.length(rule).alias("n"), F.col("rule_verdict").alias("v"), rule.alias("rule"))))
    judged = found.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
