"""Ordered-scan primitives that hold on tiled and untiled tracks alike.

Each one does its row-level work inside ``parts(df, keys)`` (one exchange, reused by every
later step on the same key) and moves only per-tile summaries between tiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tiling import COLD_TILE, SPLIT, hot_keys, is_tiled, parts

Keys = Sequence[str]
CROWD = 1_000_000  # marks of one group (track, or tile) from which they are dealt to several tasks


def running_max(df: DataFrame, keys: Keys, order: str | Sequence[str], values: Mapping[str, Column], *, inclusive: bool = True) -> DataFrame:
    """Largest value so far along ``order``; null before the first one."""
    group = parts(df, keys)
    order = [order] if isinstance(order, str) else list(order)
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = {name: F.max(value).over(w) for name, value in values.items()}
    if not is_tiled(df):
        return df.withColumns(local)
    tops = df.filter(SPLIT).groupBy(*group).agg(*[F.max(value).alias(f"_t_{name}") for name, value in values.items()])
    earlier = W.partitionBy(*keys).orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*group, *[F.max(f"_t_{name}").over(earlier).alias(f"_c_{name}") for name in values])
    joined = df.withColumns(local).join(carried, group, "left")
    return joined.withColumns({name: F.greatest(name, f"_c_{name}") for name in values}).drop(*[f"_c_{name}" for name in values])


def running_sum(
    df: DataFrame, keys: Keys, order: str | Sequence[str], values: Mapping[str, Column], *, inclusive: bool = True
) -> DataFrame:
    """Running totals of ``values`` along ``order``; 0 before the first row."""
    group = parts(df, keys)
    order = [order] if isinstance(order, str) else list(order)
    end = 0 if inclusive else -1
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    local = {name: F.coalesce(F.sum(value).over(w), F.lit(0)) for name, value in values.items()}
    if not is_tiled(df):
        return df.withColumns(local)
    totals = df.filter(SPLIT).groupBy(*group).agg(
        *[F.sum(value).alias(f"_t_{name}") for name, value in values.items()]
    )
    earlier = W.partitionBy(*keys).orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *group, *[F.sum(f"_t_{name}").over(earlier).alias(f"_c_{name}") for name in values]
    )
    joined = df.withColumns(local).join(carry, group, "left")
    out = {name: F.col(name) + F.coalesce(f"_c_{name}", F.lit(0)) for name in values}
    return joined.withColumns(out).drop(*[f"_c_{name}" for name in values])


def carry(
    df: DataFrame,
    keys: Keys,
    order: str,
    values: Mapping[str, Column],
    *,
    forward: bool = True,
    inclusive: bool = False,
) -> DataFrame:
    """Nearest non-null ``value`` before (``forward``) or after the row along ``order``.

    A stream of ``with_marks`` is scanned part by part.
    """
    group = parts(df, keys)
    end = 0 if inclusive else -1
    sort = F.col(order).asc() if forward else F.col(order).desc()
    w = W.partitionBy(*group, *_dealt(df)).orderBy(sort).rowsBetween(W.unboundedPreceding, end)
    local = {name: F.last(value, ignorenulls=True).over(w) for name, value in values.items()}
    if not is_tiled(df):
        return df.withColumns(local)
    pick = F.max_by if forward else F.min_by
    edges = df.filter(SPLIT).groupBy(*group).agg(
        *[
            pick(value, F.when(value.isNotNull(), F.col(order))).alias(f"_e_{name}")
            for name, value in values.items()
        ]
    )
    tile_sort = F.col("tile").asc() if forward else F.col("tile").desc()
    beyond = W.partitionBy(*keys).orderBy(tile_sort).rowsBetween(W.unboundedPreceding, -1)
    outside = edges.select(
        *group,
        *[F.last(f"_e_{name}", ignorenulls=True).over(beyond).alias(f"_o_{name}") for name in values],
    )
    joined = df.withColumns(local).join(outside, group, "left")
    return joined.withColumns(
        {name: F.coalesce(name, f"_o_{name}") for name in values}
    ).drop(*[f"_o_{name}" for name in values])


def with_halo(df: DataFrame, keys: Keys, order: str, *, before: int, after: int) -> DataFrame:
    """Add ``_halo``; tiles also receive the rows just outside them, flagged true.

    After this, ``lag``/``lead`` by up to ``before``/``after`` inside ``parts`` see the same
    neighbours as on the whole track. Callers drop the halo rows with ``drop_halo``.
    """
    if not is_tiled(df):
        return df.withColumn("_halo", F.lit(False))
    group = parts(df, keys)
    payload = [name for name in df.columns if name not in group]
    row = F.struct(F.col(order).alias("_o"), *payload)
    up = W.partitionBy(*group).orderBy(order)
    down = W.partitionBy(*group).orderBy(F.col(order).desc())
    edges = (
        df.filter(SPLIT)
        .select(*group, row.alias("_r"), F.row_number().over(up).alias("_a"), F.row_number().over(down).alias("_d"))
        .filter((F.col("_a") <= after) | (F.col("_d") <= before))
        .groupBy(*group)
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_a") <= after, F.col("_r")))).alias("_head"),
            F.array_sort(F.collect_list(F.when(F.col("_d") <= before, F.col("_r")))).alias("_tail"),
        )
    )
    track = W.partitionBy(*keys).orderBy("tile")
    prev = F.flatten(F.collect_list("_tail").over(track.rowsBetween(-max(before, 1), -1)))
    nxt = F.flatten(F.collect_list("_head").over(track.rowsBetween(1, max(after, 1))))
    near = edges.select(*group, prev.alias("_p"), nxt.alias("_n"))
    tail = F.when(F.size("_p") > before, F.slice("_p", F.size("_p") - before + 1, before)).otherwise(F.col("_p"))
    head = F.slice("_n", 1, max(after, 1)) if after else F.slice("_n", 1, 0)
    halo = near.select(*group, F.explode(F.concat(tail, head)).alias("_r")).select(
        *group, *[F.col("_r")[name].alias(name) for name in payload], F.lit(True).alias("_halo")
    )
    return df.withColumn("_halo", F.lit(False)).unionByName(halo)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_halo")


def per_key(df: DataFrame, keys: Keys, values: Mapping[str, Column]) -> DataFrame:
    """Attach aggregates of the whole key to each of its rows.

    Cold keys use an unordered window on the partitioning the caller already has. The aggregates
    of tiled keys are combined map-side; how they are joined is left to their measured size.
    """
    group = parts(df, keys)
    w = W.partitionBy(*group)
    local = {name: value.over(w) for name, value in values.items()}
    if not is_tiled(df):
        return df.withColumns(local)
    hot = df.filter(SPLIT).groupBy(*keys).agg(
        *[value.alias(f"_h_{name}") for name, value in values.items()]
    )
    joined = df.withColumns(local).join(hot, list(keys), "left")
    return joined.withColumns(
        {name: F.when(F.expr(SPLIT), F.col(f"_h_{name}")).otherwise(F.col(name)) for name in values}
    ).drop(*[f"_h_{name}" for name in values])


def _dealt(df: DataFrame) -> list[str]:
    return ["part"] if "part" in df.columns else []


def with_marks(rows: DataFrame, marks: DataFrame, group: Keys) -> DataFrame:
    """Rows and marks as one table, with the columns of both.

    A mark only reads the rows of its ``group``, which are bounded in number. Where a group has more
    than CROWD marks they are dealt by a hash of their columns to parts of about CROWD marks, and the
    group's rows are copied to each part; the column ``part`` is there only then. Marks that are
    equal in all columns stay together.
    """
    group = list(group)
    crowded = hot_keys(marks, group, CROWD, count="_marks", counted=True)
    if crowded is None:
        return rows.unionByName(marks, allowMissingColumns=True)
    sizes = crowded.select(*group, F.ceil(F.col("_marks") / CROWD).cast("int").alias("_parts"))
    n = F.coalesce("_parts", F.lit(1))
    plain = [c for c in marks.columns if c not in group]
    copied = rows.join(sizes, group, "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    dealt = marks.join(sizes, group, "left").withColumn("part", F.pmod(F.xxhash64(*plain), n).cast("int")).drop("_parts")
    return copied.unionByName(dealt, allowMissingColumns=True)


def file_marks(marks: DataFrame, keys: Keys, edges: DataFrame, *, forward: bool = True) -> DataFrame:
    """Add ``tile`` to marks (keys, ``_at``, ...): the last tile whose edge is at or before ``_at``.

    ``edges`` has keys, tile, ``_at``; backward, the first tile whose edge is at or after it. Marks
    beyond all edges go to the nearest tile, marks of keys without tiles to ``COLD_TILE``. Edges
    and marks are scanned as one ordered stream, crowded marks in parts beside the same edges.
    """
    both = with_marks(edges.withColumn("_mark", F.lit(False)), marks.withColumn("_mark", F.lit(True)), keys)
    by = [*keys, *_dealt(both)]
    at = F.col("_at").asc() if forward else F.col("_at").desc()
    scan = W.partitionBy(*by).orderBy(at, F.col("_mark").asc()).rowsBetween(W.unboundedPreceding, 0)
    nearest = (F.min if forward else F.max)("tile").over(W.partitionBy(*by))
    tile = F.coalesce(F.last("tile", ignorenulls=True).over(scan), nearest, F.lit(COLD_TILE))
    return both.withColumn("_tile", tile).filter("_mark").drop("_mark", "tile", *_dealt(both)).withColumnRenamed("_tile", "tile")


def run_ids(df: DataFrame, keys: Keys, usable: Column, *, order: str = "frame") -> DataFrame:
    """``run_id`` of every row: number of unusable rows before it, by list position.

    Usable rows that share an id form one contiguous run; a missing frame does not break it.
    """
    broken = F.when(usable, F.lit(0)).otherwise(F.lit(1))
    return running_sum(df, keys, order, {"run_id": broken})
