"""Exact medians that do not need a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stored
from .tiling import hot_keys, mark_hot

CELLS = 4096


def exact_median(
    df: DataFrame, keys: Sequence[str], value: Column, out: str = "median", *, limit: int | None = None, split: bool = True
) -> DataFrame:
    """Mean of the middle two values per key, nulls ignored; no row for keys without values.

    ``split=False`` states that no key is hot, as in rows derived from an untiled table; else the
    rows of each key are counted first.
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("_v")).filter("_v is not null")
    hot = hot_keys(rows, keys, limit) if split else None
    if hot is None:
        return rows.groupBy(*keys).agg(F.median("_v").alias(out))
    marked = mark_hot(rows, keys, hot)
    cold = marked.filter("not _hot").groupBy(*keys).agg(F.median("_v").alias(out))
    return cold.unionByName(_select_middle(marked.filter("_hot").drop("_hot"), keys, out))


def _select_middle(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Both middle ranks at once, narrowed cell by cell.

    Values order as Spark orders them: -Infinity, finite, Infinity, NaN. A rank that falls among
    the infinities or NaN is answered from their counts; only finite values are searched.
    """
    v, n = F.col("_v"), F.col("_n")
    sort = F.when(F.isnan(v), 3).when(v == float("inf"), 2).when(v == float("-inf"), 0).otherwise(1)
    finite = F.when(sort == 1, v)
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"),
        *[F.count(F.when(sort == k, F.lit(1))).alias(f"_s{k}") for k in (0, 1, 2)],
    )
    side = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.floor((n + 1 + k) / 2).cast("long").alias("rank")) for k in (0, 1)]))
    asked = stats.withColumn("_r", side).select(*keys, F.col("_r.side").alias("_side"), (F.col("_r.rank") - F.col("_s0")).alias("_rank"), "_lo", "_hi", "_s1", "_s2")
    beyond = F.when(F.col("_rank") <= 0, float("-inf")).when(F.col("_rank") <= F.col("_s1"), F.lit(None)).when(F.col("_rank") <= F.col("_s1") + F.col("_s2"), float("inf")).otherwise(float("nan"))
    asked = stored(asked.withColumn("_odd", beyond))
    easy = asked.filter("_odd is not null").select(*keys, "_side", F.col("_odd").alias("_value"))
    inner = asked.filter("_odd is null").select(*keys, "_side", "_rank", "_lo", "_hi")
    found = easy.unionByName(_at_ranks(rows.filter(sort == 1), inner, keys))
    return found.groupBy(*keys).agg(((F.min("_value") + F.max("_value")) / 2).alias(out))


def _at_ranks(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Value at each asked rank of finite rows.

    A pass counts the rows of equal cells between the bounds and keeps the cell that holds the
    rank, with its own least and greatest value. These two always fall into different cells, so
    every pass drops a distinct value at least, and a thousandfold of the range as a rule.
    """
    at = [*keys, "_side"]
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_v")
    width = (hi / CELLS) - (lo / CELLS)
    plain = F.floor(v / width - lo / width)
    cell = F.when(width > 0, F.when(v == lo, 0).otherwise(F.least(F.greatest(plain, F.lit(1)), F.lit(CELLS)))).otherwise((v > lo).cast("long"))
    while True:
        inside = rows.join(bounds, keys).filter("_v >= _lo and _v <= _hi")
        cells = inside.groupBy(*at, "_rank", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        ends = cells.withColumn("_end", F.sum("_c").over(W.partitionBy(*at).orderBy("_cell")))
        hit = (F.col("_end") >= F.col("_rank")) & (F.col("_end") - F.col("_c") < F.col("_rank"))
        bounds = stored(ends.filter(hit).select(*at, (F.col("_rank") - F.col("_end") + F.col("_c")).alias("_rank"), "_lo", "_hi"))
        if bounds.filter("_lo < _hi").isEmpty():
            return bounds.select(*at, F.col("_lo").alias("_value"))
