"""Order-sensitive document fingerprints (Order MinHash over word k-mers).

Each k-mer is numbered by its occurrence, so repeats differ. A hash deals the numbered k-mers into
cells; each cell keeps its `depth` smallest, puts them back in text order and hashes the tuple. A
cell that was dealt fewer takes the `depth` smallest of all k-mers under a hash of its own, so short
texts have whole tuples too. Texts share a cell's value only if the same k-mers were selected in the
same order, so the share of equal cells falls with edit distance and not only with set overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .shared import indices, small_side, text_digest, text_key

K, DEPTH, CELL_BITS = 3, 2, 6
PLACES = 1 << 32  # positions beside the hash bits of a long; no text has more words
ID_CELL, CELLS_ABOVE = 1024, 4096  # ids in a stretch, stretches up to which they are one range
RANGES = 256  # measured ranges of more stretches than that
BLANKS = r"[\x20\x09-\x0D]+"


def with_cells(df: DataFrame, text: str, out: str, k: int = K, depth: int = DEPTH) -> DataFrame:
    """`df` with `out`: array of cell * 2^32 + 32 bits of the tuple's hash, for all cells of a text of `depth` k-mers or more.

    A text of fewer than `k` words is one k-mer; a text of fewer than `depth` k-mers has one tuple, in
    the cell of its least; a text without words has no cells. All work stays inside the row and is
    linear in it, but for two sorts of long values: cells go short only in texts of a few hundred k-mers.
    """
    cells = 1 << CELL_BITS
    grams = df.withColumn("_w", F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), ""))
    n = F.size("_w")
    grams = grams.withColumn("_n", F.when(n >= k, n - (k - 1)).when(n > 0, 1).otherwise(0))
    # A long holds hash bits above and the position in the text below.
    place = lambda x: x.bitwiseAND(F.lit(PLACES - 1))
    bits = lambda x: x.bitwiseAND(F.lit(-PLACES))
    item = lambda a, i: F.get(F.col(a), i)
    gram = lambda i: F.xxhash64(*[item("_w", i + j) for j in range(k)])
    ordered = grams.withColumn("_s", F.sort_array(F.transform(indices(F.col("_n")), lambda i: bits(gram(i)) + i)))
    first = lambda i: (i == 0) | (bits(item("_s", i)) != bits(item("_s", i - 1)))
    runs = ordered.withColumn("_f", F.filter(indices(F.col("_n")), first))
    last = lambda j: F.coalesce(item("_f", j + 1), F.col("_n"))
    numbered = F.transform("_f", lambda s, j: F.transform(F.sequence(F.lit(0), last(j) - s - 1), lambda o: bits(F.xxhash64(bits(item("_s", s)), o)) + place(item("_s", s + o))))
    smallest = runs.withColumn("_t", F.sort_array(F.flatten(numbered)))
    cell = lambda x: F.shiftright(x, 64 - CELL_BITS).cast("int") + (cells >> 1)
    kept = smallest.withColumn("_k", F.filter("_t", lambda x, i: (i < depth) | (cell(x) != cell(item("_t", i - depth)))))
    full = kept.withColumn("_h", F.filter(indices(F.size("_k") - (depth - 1)), lambda i: ((i == 0) | (cell(item("_k", i)) != cell(item("_k", i - 1)))) & (cell(item("_k", i)) == cell(item("_k", i + depth - 1)))))
    dealt = full.withColumn("_d", F.transform("_h", lambda i: cell(item("_k", i))))
    in_text = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct(place(x).alias("p"), bits(x).alias("h"))))
    value = lambda c, xs: c.cast("long") * (1 << 32) + F.xxhash64(F.transform(in_text(xs), lambda x: x["h"])).bitwiseAND(F.lit((1 << 32) - 1))
    short = F.array_except(F.sequence(F.lit(0), F.lit(cells - 1)), "_d")
    drawn = lambda c: F.slice(F.sort_array(F.transform("_t", lambda x: bits(F.xxhash64(bits(x), c)) + place(x))), 1, depth)
    values = F.concat(F.transform("_h", lambda i, j: value(item("_d", j), F.slice("_k", i + 1, depth))), F.transform(short, lambda c: value(c, drawn(c))))
    few = F.when(F.col("_n") > 0, F.array(value(cell(item("_t", F.lit(0))), F.col("_t")))).otherwise(F.array().cast("array<bigint>"))
    return dealt.withColumn(out, F.when(F.col("_n") >= depth, F.sort_array(values)).otherwise(few)).drop("_w", "_n", "_s", "_f", "_t", "_k", "_h", "_d")


def written(cells: Column) -> Column:
    """Ten hex digits a cell."""
    return F.lower(F.array_join(F.transform(cells, lambda c: F.lpad(F.hex(c), 10, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Equal cells over the cells that either text has; 1 for two texts without words."""
    number = lambda cells: F.transform(cells, lambda c: F.shiftright(c, 32))
    either = F.size(F.array_union(number(a), number(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def _stretch(value: Column, width: int) -> Column:
    return (value - F.pmod(value, F.lit(width))) / width


def ranged(stretches: DataFrame) -> DataFrame:
    """stretch, above: the number of its range, of RANGES about equal ones measured on the stretches."""
    shares = [k / RANGES for k in range(1, RANGES)]
    n, cuts = stretches.agg(F.count(F.lit(1)), F.percentile_approx("stretch", shares)).first()
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if n > CELLS_ABOVE else F.array().cast("array<long>")
    return stretches.select("stretch", F.size(F.filter(cuts, lambda c: c <= F.col("stretch"))).alias("above"))


def before(stretches: DataFrame) -> DataFrame:
    """stretch, prev: the stretch before each, the last one before the first.

    Lags run inside ranges; only one row of each range is ordered as a whole, however the ids lie.
    """
    grouped = ranged(stretches)
    inner = grouped.withColumn("inner", F.lag("stretch").over(Window.partitionBy("above").orderBy("stretch")))
    tops = grouped.groupBy("above").agg(F.max("stretch").alias("last"))
    everything = Window.partitionBy(F.lit(0))
    tops = tops.select("above", F.coalesce(F.lag("last").over(everything.orderBy("above")), F.max("last").over(everything)).alias("outer"))
    return inner.join(tops, "above").select("stretch", F.coalesce("inner", "outer").alias("prev"))


def with_followers(docs: DataFrame) -> DataFrame:
    """Rows of `docs` and, for each stretch of ids, a copy of the row that follows its last one.

    Null ids come first; rows of one id are ordered by a hash of their text. Adds _stretch, _key
    and _copy, by which `with_next` orders each stretch apart.
    """
    rows = docs.withColumns({"_key": text_key(F.col("text")), "_stretch": F.coalesce(_stretch(F.col("doc_id"), ID_CELL).cast("long"), F.lit(-(1 << 62)))})
    slim = rows.select(F.col("_stretch").alias("stretch"), F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id"), F.coalesce("_key", F.lit(0)).alias("key"))
    heads = stored(slim.groupBy("stretch").agg(F.min(F.struct("id", "key")).alias("head")))
    heads = heads.join(before(heads.select("stretch")), "stretch").select(F.col("head.id").alias("_hid"), F.col("head.key").alias("_hkey"), F.col("prev").alias("_prev"))
    same = (F.coalesce("doc_id", F.lit(-(1 << 62))) == F.col("_hid")) & (F.coalesce("_key", F.lit(0)) == F.col("_hkey"))
    copies = rows.join(small_side(heads), same).withColumn("_stretch", F.col("_prev")).drop("_hid", "_hkey", "_prev")
    return rows.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))


def with_next(both: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of `with_followers` with next_<column> of the next document by doc_id; the copies go."""
    order = Window.partitionBy("_stretch").orderBy("_copy", "doc_id", "_key")
    led = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return led.filter("_copy = 0").drop("_copy", "_stretch", "_key")


def edited_text() -> Column:
    """The last half of `text` replaced by as many characters of `next_text`."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left("text", n - half), F.left("next_text", half))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: its fingerprint, that of its edited text, and likeness to that and to the next document.

    Null texts are empty; a single document is its own next one; repeated rows stay repeated.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(with_cells(with_followers(texts), "text", "cells"), ["text", "cells"])
    led = with_cells(led.withColumn("edited", edited_text()), "edited", "edited_cells")
    return led.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        text_digest(F.col("edited")).alias("edited_sha256"),
        written(F.col("cells")).alias("fingerprint"),
        written(F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("cells"), F.col("edited_cells")).alias("near_edited"),
        likeness(F.col("cells"), F.col("next_cells")).alias("near_next"),
    )
