"""Spans of secrets in texts: fixed patterns, and strings that look random.

The random look is the mean log-likelihood ratio of two character bigram models: one of strings
that the fixed patterns found, one of ordinary identifiers. Positions are code points: the pieces
between matches and the matches themselves are measured and summed in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import share_of

# Fixed patterns of the base kinds, in their listed order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
VALUE_CHARS = 8

RANDOM = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = 3

# Words of letters joined by _ or -, with a number of up to four digits behind, and nothing of a key around them.
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9_-]{6})[A-Za-z]+(?:[_-][A-Za-z]+)*+(?:[_-]?[0-9]{1,4})?(?![A-Za-z0-9+/_=-])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
TRAINING_DOCS = 20_000  # expected number of documents that the bigram models are fitted on
MIN_RATIO = 0.5  # mean log-likelihood ratio of a bigram from which a string counts as random
SMOOTHING = 0.5


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """Array of (kind, i, gap before the match, length, holds, body); null where nothing matches."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if pattern == ASSIGN:
        value = F.transform(found, lambda x: F.length(F.regexp_extract(x, pattern, 2)))
    else:
        value = F.transform(found, lambda x: F.lit(VALUE_CHARS))
    zipped = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), found.alias("body"), value.alias("value"))
    some = F.slice(zipped, F.lit(1), F.size(zipped) - 1)
    matches = F.transform(
        some,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), F.length(m["body"]).alias("len"), (m["value"] >= VALUE_CHARS).alias("holds"), m["body"].alias("body")
        ),
    )
    return F.when(text.rlike(pattern), matches)  # most texts hold no match and are read once


def _pairs(body: Column) -> Column:
    """Cell numbers of the bigrams of a string; characters outside the alphabet share cell row 0."""
    side = len(ALPHABET) + 1
    code = lambda i: F.instr(F.lit(ALPHABET), F.substr(body, i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.length(body) - 1), lambda i: code(i) * side + code(i + 1))


def train(docs: DataFrame, sample_docs: int = TRAINING_DOCS) -> list[float]:
    """Log-likelihood ratio of each bigram cell, random against ordinary.

    Labelled samples: what the fixed patterns find, and identifiers, in about `sample_docs`
    documents chosen by a hash of doc_id and text. The result is bounded by the alphabet squared.
    """
    cells = (len(ALPHABET) + 1) ** 2
    text = F.coalesce("text", F.lit(""))
    chosen = docs.filter(share_of(["doc_id", "text"], sample_docs, docs.count())).select(text.alias("text"))
    secret = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    samples = lambda label, bodies: F.transform(bodies, lambda b: F.struct(F.lit(label).alias("label"), b.alias("body")))
    plain = chosen.select(F.explode(F.concat(samples(1, secret), samples(0, F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))))).alias("s")).select("s.*")
    pairs = plain.filter(F.length("body") >= 6).select("label", F.explode(_pairs(F.col("body"))).alias("cell"))
    counts = {(r.label, r.cell): r.n for r in pairs.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [sum(n for (label, _), n in counts.items() if label == k) + SMOOTHING * cells for k in (0, 1)]
    rate = lambda label, cell: (counts.get((label, cell), 0) + SMOOTHING) / totals[label]
    return [math.log(rate(1, cell) / rate(0, cell)) for cell in range(cells)]


def ratio(body: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the bigrams of `body`."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    pairs = _pairs(body)
    return F.aggregate(pairs, F.lit(0.0), lambda total, cell: total + F.get(table, cell)) / (F.length(body) - 1)


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """Per row of `docs`: doc_id and spans, an array of (start, kind, end) in that order.

    `kind` indexes KINDS. Random strings that overlap a span of a fixed pattern are left out. Null
    texts are empty; repeated rows stay repeated; other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    every = F.flatten(F.array_compact(F.array(*[_matches(F.col("text"), k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, RANDOM))])))
    found = rows.select("row", "doc_id", F.explode_outer(every).alias("m")).select("row", "doc_id", "m.*")
    in_order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(in_order)).withColumn("start", F.col("end") - F.col("len"))
    looks_random = F.when(F.col("kind") == KINDS.index("random"), ratio(F.col("body"), model) >= MIN_RATIO).otherwise(F.lit(True))
    held = placed.withColumn("holds", F.col("holds") & looks_random).drop("body", "gap", "i", "len")
    base = F.col("holds") & (F.col("kind") < BASE_KINDS)
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    overlaps = (F.coalesce(before, F.lit(-1)) > F.col("start")) | (F.coalesce(after, F.col("end")) < F.col("end"))
    kept = held.withColumn("keep", F.col("holds") & ((F.col("kind") < BASE_KINDS) | ~overlaps))
    span = F.when(F.col("keep"), F.struct("start", "kind", "end"))
    return kept.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("row")


def report(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)
    return scanned.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
