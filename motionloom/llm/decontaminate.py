"""Words of documents that lie inside a benchmark passage.

A passage is `width` consecutive words of an item, or all words of a shorter one. The words of a
passage are ordered by how rare they are in the documents; a document can contain the passage only
at places where the rarest word stands, so documents join on that word alone. Length and
positional bounds and the second rarest word thin the candidates, and the whole passage is then
compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .shared import ascii_lower, indices, small_side, text_digest, text_key

WIDTH = 13
PASSAGES_BROADCAST = 200_000  # passages up to which they are broadcast; beyond, the join shuffles
FILTER_CELLS = 1 << 20  # cells of the rare words' filter, which is broadcast
HOT_SHARE = 1000  # a rare word with more than this part of all rare words' places is split

# Fixed character class between words, after lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAPS), "")


def passages(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, passage, body: windows of each item; wordless items have none."""
    rows = items.filter(F.col("text").isNotNull()).select("item_id", words_of(F.col("text")).alias("words"))
    n = F.size("words")
    starts = F.when(n >= width, indices(n - (width - 1))).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    bodies = rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, F.least(n, F.lit(width))))).alias("body"))
    return bodies.select("item_id", F.sha2(F.array_join("body", " "), 256).alias("passage"), "body").distinct()


def document_words(docs: DataFrame, *after: str) -> DataFrame:
    """doc_id, key, words, pos, word; `after` stands behind the last word of each text."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), words_of(F.coalesce("text", F.lit(""))).alias("words"))
    spread = F.concat("words", F.array(*[F.lit(x) for x in after])) if after else F.col("words")
    return rows.select("doc_id", "key", "words", F.posexplode(spread).alias("pos", "word"))


def anchored(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """passage, body, size and its two rarest words with their offsets; n: how often the rarest stands in `docs`.

    Rarity is the count over all documents; ties go to the earlier word in code-point order.
    """
    spread = bodies.select("passage", F.posexplode("body").alias("offset", "word"))
    vocabulary = small_side(spread.select(F.xxhash64("word").alias("token")).distinct())
    counts = document_words(docs).select(F.xxhash64("word").alias("token")).join(vocabulary, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = spread.withColumn("token", F.xxhash64("word")).join(counts, "token", "left")
    order = Window.partitionBy("passage").orderBy(F.coalesce("n", F.lit(0)), "word", "offset")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    pick = lambda rank, name: F.max(F.when(F.col("rank") == rank, F.col(name)))
    heads = ranked.groupBy("passage").agg(
        pick(1, "token").alias("token"), F.coalesce(pick(1, "n"), F.lit(0)).alias("n"), pick(1, "offset").alias("offset"), pick(2, "word").alias("second"), pick(2, "offset").alias("second_offset")
    )
    return bodies.join(heads, "passage").withColumn("size", F.size("body"))


def _exact(met: DataFrame) -> DataFrame:
    """Rows of `met` whose passage stands there; `words` are those of the text from `base` on, n all of them."""
    start = F.col("pos") - F.col("offset")
    at = start - F.col("base")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    second = F.col("second").isNull() | (F.get(F.col("words"), at + F.col("second_offset")) == F.col("second"))
    exact = F.slice("words", F.when(fits, at + 1).otherwise(1), F.col("size")) == F.col("body")
    return met.filter(fits & second & exact).select("doc_id", "key", start.alias("start"), "size", "items")


def _by_shuffle(docs: DataFrame, heads: DataFrame, width: int) -> DataFrame:
    """Occurrences of passages too many to broadcast.

    Only places whose word falls in a filter cell of some rarest word go on, with the words a passage
    can reach from there, and no whole text. The filter has FILTER_CELLS rows at most. Rarest words
    that hold over 1 / HOT_SHARE of all places, HOT_SHARE words at most, are split by place.
    """
    cell = lambda token: F.pmod(token, F.lit(FILTER_CELLS)).alias("cell")
    rare = heads.groupBy("token").agg(F.max("n").alias("n"))
    total = rare.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(rare.filter(F.col("n") * HOT_SHARE > total).select("token", F.ceil(F.col("n") * HOT_SHARE / F.lit(total)).cast("int").alias("parts")))
    places = document_words(docs).withColumn("token", F.xxhash64("word")).withColumn("cell", cell(F.col("token")))
    places = places.join(F.broadcast(heads.filter("n > 0").select(cell(F.col("token"))).distinct()), "cell")
    base = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    around = places.select("doc_id", "key", "token", "pos", base.alias("base"), F.size("words").alias("n_words"), F.slice("words", base + 1, F.col("pos") + width - base).alias("words"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("key", "pos"), F.col("parts")).cast("int"))
    around = around.join(hot, "token", "left").withColumn("part", part).drop("parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    return _exact(around.join(heads.filter("n > 0").join(hot, "token", "left").withColumn("part", copies).drop("parts", "n"), ["token", "part"]))


def occurrences(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, key, start, size, items: every exact occurrence of a passage.

    Each text also gives one row of size 0 at its end, which counts its words.
    """
    found = passages(items, width)
    named = found.groupBy("passage", "body").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    heads = anchored(docs, named.select("passage", "body")).join(named.select("passage", "items"), "passage")
    heads = stored(heads.select("token", "n", "offset", "second", "second_offset", "size", "body", "items"))
    if heads.limit(PASSAGES_BROADCAST + 1).count() > PASSAGES_BROADCAST:
        ends = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(words_of(F.coalesce("text", F.lit("")))).alias("start"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("items"))
        return _by_shuffle(docs, heads, width).unionByName(ends)
    end = docs.sparkSession.range(1).select(F.xxhash64(F.lit("")), F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(0), F.array().cast("array<string>"), F.array().cast("array<string>"))
    heads = heads.drop("n")
    heads = F.broadcast(heads.unionByName(end.toDF(*heads.columns)))
    met = document_words(docs, "").withColumn("token", F.xxhash64("word")).join(heads, "token")
    return _exact(met.withColumns({"base": F.lit(0), "n_words": F.size("words")}))


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of `docs`: its doc_id and text key, n_words, n_hit, items (ids as sorted strings).

    Null texts have no words; an empty item table hits nothing; rows that repeat doc_id and text
    get the same result each. Words of an item without id count as hit, but it is not among the items.
    Other columns are not read.
    """
    inside, end = F.col("size") > 0, F.col("size") == 0
    per_doc = occurrences(docs, items, width).groupBy("doc_id", "key").agg(
        F.max(F.when(end, F.col("start"))).cast("long").alias("n_words"),
        F.count(F.when(end, F.lit(1))).cast("int").alias("rows"),
        F.collect_set(F.when(inside, F.struct("start", "size"))).alias("ranges"),
        F.collect_set(F.when(inside, F.col("items"))).alias("items"),
    )
    covered = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1))))
    each = F.explode(F.array_repeat(F.lit(1), F.col("rows"))).alias("each")
    return per_doc.select("doc_id", "key", "n_words", F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), each).drop("each")


def is_contaminated() -> Column:
    """At least a twentieth of the words lies inside a passage."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` that are not contaminated, all columns kept."""
    bad = hits(docs, items, width).filter(is_contaminated()).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_doc")) & (text_key(F.col("text")) == F.col("_key")), "left_anti")


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    found = hits(docs, items, width)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), text_digest(F.array_join("items", ",")).alias("items_sha256"), is_contaminated().alias("contaminated"))
