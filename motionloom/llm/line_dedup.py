"""Removal of passages that repeat line for line.

Windows are runs of `width` consecutive lines that overlap; a shorter run counts too where it
holds `min_words` words, and so does a whole document of fewer lines. Window digests are counted
over the whole corpus, the first occurrence (lowest doc_id, then position) stays, and the lines
that any later occurrence covers are merged and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import indices, text_key

WIDTH, MIN_WORDS = 3, 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, width: int, min_words: int) -> DataFrame:
    """doc_id, key, pos, len, h1, h2: one row for each window; blank windows are none."""
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", text_key(F.col("text")).alias("key"), _lines(F.col("text")).alias("lines"))
    rows = rows.withColumn("words", F.transform("lines", lambda x: F.regexp_count(x, F.lit("[^ ]+"))))
    n = F.size("lines")

    def runs(size: int) -> Column:
        total = lambda i: sum((F.get(F.col("words"), i + k) for k in range(1, size)), F.get(F.col("words"), i))
        window = lambda i: F.struct(i.alias("pos"), F.lit(size).alias("len"), F.slice("lines", i + 1, size).alias("body"))
        least = 1 if size == width else min_words
        kept = F.filter(indices(n - (size - 1)), lambda i: (total(i) >= least) & (F.lit(size == width) | (F.lit(size) <= n)))
        return F.transform(kept, window)

    whole = F.when((n < width) & (F.aggregate("words", F.lit(0), lambda a, x: a + x) > 0), F.array(F.struct(F.lit(0).alias("pos"), n.alias("len"), F.col("lines").alias("body"))))
    found = F.concat(*[runs(size) for size in range(1, width + 1)], F.coalesce(whole, F.array().cast("array<struct<pos:int,len:int,body:array<string>>>")))
    digests = F.transform(found, lambda w: F.struct(w["pos"].alias("pos"), w["len"].alias("len"), F.xxhash64(w["body"]).alias("h1"), F.xxhash64(F.lit("second"), w["body"]).alias("h2")))
    return rows.select("doc_id", "key", F.explode(digests).alias("w")).select("doc_id", "key", "w.*")


def covered_lines(docs: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, covered: positions of lines inside any later occurrence of a window."""
    occurrences = windows(docs, width, min_words)
    where = F.struct("doc_id", "key", "pos", "len")
    firsts = occurrences.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = occurrences.join(firsts, ["h1", "h2"]).filter(~where.eqNullSafe(F.col("first")))
    ranges = later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("pos", "len")).alias("ranges"))
    lines = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["pos"], r["pos"] + r["len"] - 1))))
    return ranges.select("doc_id", "key", lines.alias("covered"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` with `text` cleaned, and n_lines, n_removed (null texts: 0).

    A text of which every line goes is empty. Rows that repeat both doc_id and text are one
    document and are treated alike; a null doc_id comes before all others.
    """
    taken = covered_lines(docs, width, min_words).withColumnsRenamed({"doc_id": "_doc", "key": "_key", "covered": "_covered"})
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_doc")) & (text_key(F.col("text")) == F.col("_key")), "left")
    lines = _lines(F.col("text"))
    kept = F.array_except(indices(F.size(lines)), F.col("_covered"))
    clean = F.when(F.col("_covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.coalesce(F.size("_covered"), F.lit(0)).cast("long")
    out = joined.withColumns({"_clean": clean, "_n": n, "_gone": removed}).select(*[F.col("_clean").alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")], F.col("_n").alias("n_lines"), F.col("_gone").alias("n_removed"))
    return out
