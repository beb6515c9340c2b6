"""Camera-shake estimation from anchor tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ANCHOR_MIN_DIST_SQ, ANCHORS_PER_CORNER, SHAKE_CLUSTER_PX
from ..functions.plane import let
from ..session import cut_lineage
from .joins import attach
from .scan import composed_scan, nearest
from .sequence import carry, run_ids

Keys = Sequence[str]
LIMIT_SQ = SHAKE_CLUSTER_PX**2


def pick_anchors(cells: DataFrame, keys: Keys, per_corner: int = ANCHORS_PER_CORNER) -> DataFrame:
    """Greedy choice per frame and corner: best score first, at least 8 px from those chosen.

    ``cells``: keys, frame, corner, score, x, y; one row per grid cell, so a group is at most 64 rows.
    """
    keys = list(keys)
    far = lambda p, q: F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2) >= ANCHOR_MIN_DIST_SQ
    ranked = F.sort_array(F.collect_list(F.struct("score", "x", "y")), asc=False)
    sets = cells.groupBy(*keys, "frame", "corner").agg(ranked.alias("_c"))

    def take(acc: Column, cell: Column) -> Column:
        free = (F.size(acc) < per_corner) & F.forall(acc, lambda p: far(p, cell))
        return F.when(free, F.concat(acc, F.array(cell))).otherwise(acc)

    picked = F.aggregate("_c", F.slice("_c", 1, 0), take)
    return sets.select(*keys, "frame", "corner", F.posexplode(picked).alias("rank", "p")).select(
        *keys, "frame", "corner", "rank", F.col("p.score").alias("score"), F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )


def _middle(values: Column) -> Column:
    def half(v: Column) -> Column:
        n = F.size(v["o"])
        return (F.get(v["o"], F.floor((n - 1) / 2).cast("int")) + F.get(v["o"], F.floor(n / 2).cast("int"))) * 0.5

    return let({"o": F.array_sort(values)}, half)


def consensus(pairs: Column) -> Column:
    """Medians of the largest consistent groups of a frame's anchor shifts, in anchor order.

    Works on the handful of anchors of one frame. One distinct median means the frame decides
    its shift alone; several mean the previous shift breaks the tie.
    """
    near = lambda p, q: F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2) <= LIMIT_SQ
    groups = F.transform(pairs, lambda c: F.filter(pairs, lambda p: near(p, c)))
    sized = F.transform(
        groups,
        lambda g: F.struct(
            F.size(g).alias("n"),
            _middle(F.transform(g, lambda p: p["x"])).alias("dx"),
            _middle(F.transform(g, lambda p: p["y"])).alias("dy"),
        ),
    )

    def largest(v: Column) -> Column:
        best = F.filter(v["s"], lambda g: g["n"] == v["top"])
        return F.array_distinct(F.transform(best, lambda g: F.struct(g["dx"].alias("dx"), g["dy"].alias("dy"))))

    # a lambda works out what it refers to again for each item, so the groups and their top size are bound first
    return let({"s": sized}, lambda v: let({"s": v["s"], "top": F.array_max(F.transform(v["s"], lambda g: g["n"]))}, largest))


def robust_shift(frames: DataFrame, keys: Keys) -> DataFrame:
    """Shift of every frame from its ``pairs`` array; keys, [tile], frame, dx, dy.

    Frames with one consensus are settled at once and frames without anchors take the last shift
    before them. Only a stretch that starts at a settled frame and contains a tie is scanned,
    as composed maps of blocks.
    """
    keys = list(keys)
    tile = ["tile"] if "tile" in frames.columns else []
    rows = frames.select(*keys, *tile, "frame", consensus(F.col("pairs")).alias("_c"))
    n = F.size("_c")
    settled = n == 1
    # read three times below, so the consensus is worked out once and its lineage cut
    rows = cut_lineage(run_ids(rows, keys, ~settled))
    tied = rows.filter(n > 1).select(*keys, "run_id").distinct()
    clear = rows.join(tied, [*keys, "run_id"], "left_anti")
    value = F.when(settled, F.get("_c", F.lit(0)))
    held = carry(clear, keys, "frame", {"_s": value}, forward=True, inclusive=True)
    plain = held.select(*keys, "frame", F.coalesce("_s.dx", F.lit(0.0)).alias("dx"), F.coalesce("_s.dy", F.lit(0.0)).alias("dy"))
    loose = rows.join(tied, [*keys, "run_id"], "left_semi").select(*keys, "run_id", F.col("frame").cast("int").alias("frame"), "_c")
    still = F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    walked = composed_scan(loose, [*keys, "run_id"], "_c", still, nearest())
    return plain.unionByName(walked.select(*keys, "frame", "state.dx", "state.dy"))


def estimate_shake(anchors: DataFrame, keys: Keys) -> DataFrame:
    """Shift per frame from tracked anchors (keys, [tile], frame, k, x, y; x null = not found).

    Shifts count from frame 0. Anchors more than 24 px off the first consensus are dropped and
    the consensus is taken again. Clips with fewer than two anchors do not move.
    """
    keys = list(keys)
    tile = ["tile"] if "tile" in anchors.columns else []
    per_frame = anchors.groupBy(*keys, *tile, "frame").agg(
        F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("_a")
    )
    seeds = anchors.filter("frame = 0 and x is not null").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("k", F.struct("x", "y")))).alias("_ref")
    )
    rows = attach(per_frame, seeds, keys, "left")
    ref = lambda a: F.try_element_at("_ref", a["k"])
    seen = F.filter("_a", lambda a: a["x"].isNotNull() & ref(a).isNotNull())
    shifts = F.transform(seen, lambda a: F.struct((a["x"] - ref(a)["x"]).alias("x"), (a["y"] - ref(a)["y"]).alias("y")))
    still = F.coalesce(F.size(F.map_keys("_ref")), F.lit(0)) < 2
    rows = rows.withColumn("pairs", F.when(still, F.slice(F.coalesce(shifts, F.array().cast("array<struct<x:double,y:double>>")), 1, 0)).otherwise(shifts))
    first = robust_shift(rows, keys).withColumnsRenamed({"dx": "_dx", "dy": "_dy"})
    kept = F.filter("pairs", lambda p: F.pow(p["x"] - F.col("_dx"), 2) + F.pow(p["y"] - F.col("_dy"), 2) <= LIMIT_SQ)
    again = rows.select(*keys, *tile, "frame", "pairs").join(first, [*keys, "frame"]).withColumn(
        "pairs", F.when(F.col("frame") == 0, F.col("pairs")).otherwise(kept)
    )
    return robust_shift(again, keys)
