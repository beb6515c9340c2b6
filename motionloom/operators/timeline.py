"""Frame-timeline operators: densify, sampling grids, neighbours, prediction, representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import MAX_REPRESENTATIVE_POINTS, PREDICTION_LOOKBACK
from ..functions.geometry import lerp
from .sequence import carry, drop_halo, per_key, running_sum, with_halo
from .tiling import is_tiled, parts

Keys = Sequence[str]
CHUNK = 1 << 16


def explode_range(df: DataFrame, start: Column, end: Column, out: str, step: Column | int = 1) -> DataFrame:
    """One row per start, start+step, .. <= end, without building an array longer than CHUNK."""
    step = F.lit(step) if isinstance(step, int) else step
    rows = df.withColumns({"_s": start.cast("long"), "_e": end.cast("long"), "_d": step.cast("long")}).filter("_s <= _e")
    rows = rows.withColumn("_s", F.explode(F.sequence("_s", "_e", F.col("_d") * CHUNK)))
    stop = F.least(F.col("_e"), F.col("_s") + F.col("_d") * (CHUNK - 1))
    rows = rows.withColumn(out, F.explode(F.sequence(F.col("_s"), stop, F.col("_d"))))
    return rows.withColumn(out, F.col(out).cast("int")).drop("_s", "_e", "_d")


def interpolate_at(points: DataFrame, keys: Keys) -> DataFrame:
    """Add ``px, nx``-style neighbours: the previous and next point of each row as structs."""
    w = W.partitionBy(*parts(points, keys)).orderBy("frame")
    here = F.struct("frame", "x", "y", "visible", "confidence")
    rows = with_halo(points, keys, "frame", before=1, after=1).withColumn("_h", here)
    rows = rows.withColumns({"prev": F.lag("_h").over(w), "next": F.lead("_h").over(w)})
    return drop_halo(rows).drop("_h")


def densify(sampled: DataFrame, bounds: DataFrame, keys: Keys) -> DataFrame:
    """A point for every frame of [start, last]; gaps are interpolated between visible ends only.

    Each sampled point fills the gap that follows it, so work spreads with the points. ``sampled``
    has unique frames; ``bounds`` has keys, start, last.
    """
    from .joins import attach

    keys = list(keys)
    limits = bounds.select(*keys, F.col("start").alias("_from"), F.col("last").alias("_to"))
    rows = attach(interpolate_at(sampled, keys), limits, keys, "inner")
    cols = [*keys, "frame", "x", "y", "visible", "confidence", "manual", "interpolated"]
    kept = rows.filter("frame between _from and _to").withColumn("interpolated", F.lit(False)).select(*cols)

    after = explode_range(
        rows,
        F.greatest(F.col("frame") + 1, F.col("_from")),
        F.least(F.coalesce(F.col("next.frame") - 1, F.col("_to")), F.col("_to")),
        "f",
    )
    both = F.coalesce(F.col("visible") & F.col("next.visible"), F.lit(False))
    moved = lambda axis: F.when(both, lerp(F.col(axis), F.col(f"next.{axis}"), F.col("frame"), F.col("next.frame"), F.col("f"))).otherwise(F.col(axis))
    filled = after.select(
        *keys, F.col("f").alias("frame"), moved("x").alias("x"), moved("y").alias("y"), both.alias("visible"),
        F.when(both, F.least("confidence", "next.confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.lit(False).alias("manual"), both.alias("interpolated"),
    )
    hidden = [F.lit(False).alias("visible"), F.lit(0.0).alias("confidence"), F.lit(False).alias("manual"), F.lit(False).alias("interpolated")]
    lead = explode_range(rows.filter("prev is null"), F.col("_from"), F.least(F.col("frame") - 1, F.col("_to")), "f")
    leading = lead.select(*keys, F.col("f").alias("frame"), "x", "y", *hidden)
    bare = limits.join(sampled.select(*keys).distinct(), keys, "left_anti")
    empty = explode_range(bare, F.col("_from"), F.col("_to"), "f").select(
        *keys, F.col("f").alias("frame"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), *hidden
    )
    return kept.unionByName(filled).unionByName(leading).unionByName(empty)


def sample_grid(bounds: DataFrame, keys: Keys, stride: int = 1, extra: DataFrame | None = None) -> DataFrame:
    """Frames to sample: every stride-th from start, the last one, and in-range extra frames."""
    keys = list(keys)
    valid = bounds.filter("start <= last")
    grid = explode_range(valid, F.col("start"), F.col("last"), "frame", max(1, int(stride))).select(*keys, "frame")
    ends = valid.select(*keys, F.col("last").cast("int").alias("frame"))
    out = grid.unionByName(ends)
    if extra is not None:
        inside = extra.join(valid, keys).filter("frame between start and last").select(*keys, F.col("frame").cast("int").alias("frame"))
        out = out.unionByName(inside)
    return out.distinct()


# prompts of a layer: a short array of structs with a frame


def shift_prompts(prompts: Column, start: Column, last: Column) -> Column:
    """Prompts inside [start, last], counted from start."""
    inside = F.filter(prompts, lambda p: (p["frame"] >= start) & (p["frame"] <= last))
    return F.transform(inside, lambda p: p.withField("frame", p["frame"] - start))


def window_prompts(prompts: Column, start: Column, last: Column, seed: Column) -> Column:
    """Shifted prompts, or one positive prompt at the seed when none is inside."""
    shifted = shift_prompts(prompts, start, last)
    return F.when(F.size(shifted) > 0, shifted).otherwise(F.array(seed))


def remap_prompts(prompts: DataFrame, sampled: DataFrame, keys: Keys, *, hot: DataFrame | None = None) -> DataFrame:
    """Prompt rows renumbered to the ordinal of their frame among the sampled ones; others drop."""
    from .tiling import number_rows

    ordinal = number_rows(sampled, keys, ["frame"], F.floor(F.col("frame") / CHUNK), "ordinal", hot=hot)
    return prompts.join(ordinal, [*keys, "frame"]).withColumn("frame", F.col("ordinal")).drop("ordinal")


def visible_neighbours(points: DataFrame, keys: Keys) -> DataFrame:
    """Frames of the nearest visible point before and after each point."""
    shown = {"prev_visible": F.when(F.col("visible"), F.col("frame"))}
    rows = carry(points, keys, "frame", shown, forward=True)
    return carry(rows, keys, "frame", {"next_visible": F.when(F.col("visible"), F.col("frame"))}, forward=False)


def predict_next(points: DataFrame, keys: Keys, fallback: tuple[Column, Column]) -> DataFrame:
    """Where each point was expected from the four rows before it (visible ones only).

    Second-order extrapolation when the change of acceleration is small, else first-order when
    the change of speed is small, else the newest position.
    """
    n = PREDICTION_LOOKBACK
    w = W.partitionBy(*parts(points, keys)).orderBy("frame")
    here = F.struct("x", "y", "visible")
    rows = with_halo(points, keys, "frame", before=n, after=0).withColumn("_p", here)
    rows = rows.withColumn("_seen", F.array(*[F.lag("_p", i).over(w) for i in range(1, n + 1)]))
    rows = drop_halo(rows).withColumn("_seen", F.filter("_seen", lambda p: p.isNotNull() & p["visible"]))
    at = lambda i, axis: F.get("_seen", F.lit(i))[axis]
    size = F.size("_seen")
    out: dict[str, Column] = {}
    for axis, spare in zip(("x", "y"), fallback):
        p = [at(i, axis) for i in range(n)]
        v = [p[i] - p[i + 1] for i in range(n - 1)]
        a = [v[i] - v[i + 1] for i in range(n - 2)]
        # the mean speed over k steps is the end-to-end change divided by k
        mean_v = F.abs(F.when(size == 2, v[0]).when(size == 3, (p[0] - p[2]) / 2).otherwise((p[0] - p[3]) / 3))
        mean_a = F.abs((v[0] - v[2]) / 2)
        smooth_v = (size < 3) | (F.abs(v[0] - v[1]) < mean_v)
        smooth_a = (size >= 3) & ((size < 4) | (F.abs(a[0] - a[1]) < mean_a))
        out[f"pred_{axis}"] = (
            F.when(size == 0, spare)
            .when(size == 1, p[0])
            .when(smooth_a, p[0] + v[0] + a[0])
            .when(smooth_v, p[0] + v[0])
            .otherwise(p[0])
        )
    return rows.withColumns(out).drop("_p", "_seen")


def representative_points(samples: DataFrame, keys: Keys, limit: int = MAX_REPRESENTATIVE_POINTS) -> DataFrame:
    """At most ``limit`` visible samples per track: ends, extremes, then an even stride.

    Rows are picked by their position against per-track facts; only rows that can be chosen
    (a few dozen per track) reach the final ranking.
    """
    keys = list(keys)
    seen = samples.filter(F.col("visible") & F.col("x").isNotNull() & F.col("y").isNotNull())
    first_max = lambda c: F.max(F.struct(F.col(c), (-F.col("frame")).alias("f")))["f"]
    facts = {
        "_n": F.count(F.lit(1)),
        "_a": F.min("frame"),
        "_z": F.max("frame"),
        "_lx": F.min(F.struct("x", "frame"))["frame"],
        "_hx": first_max("x"),
        "_ly": F.min(F.struct("y", "frame"))["frame"],
        "_hy": first_max("y"),
    }
    structs = {k: v for k, v in facts.items() if k in ("_n", "_a", "_z")}
    structs |= {
        "_slx": F.min(F.struct("x", "frame")), "_shx": F.max(F.struct("x", (-F.col("frame")).alias("f"))),
        "_sly": F.min(F.struct("y", "frame")), "_shy": F.max(F.struct("y", (-F.col("frame")).alias("f"))),
    }
    rows = per_key(seen, keys, structs)
    rows = running_sum(rows, keys, "frame", {"_pos": F.lit(1)}, inclusive=False)
    marks = F.array_distinct(F.array("_a", "_z", F.col("_slx.frame"), -F.col("_shx.f"), F.col("_sly.frame"), -F.col("_shy.f")))
    rows = rows.withColumn("_e", marks)
    room = F.lit(limit) - F.size("_e")
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / F.greatest(room, F.lit(1))))
    rows = rows.withColumns({"_edge": F.array_contains("_e", F.col("frame")), "_room": room, "_stride": stride})
    able = rows.filter((F.col("_n") <= limit) | F.col("_edge") | (F.col("_pos") % F.col("_stride") == 0))
    w = W.partitionBy(*keys).orderBy("_edge", "frame")
    ranked = able.withColumn("_rk", F.row_number().over(w))
    chosen = ranked.filter((F.col("_n") <= limit) | F.col("_edge") | (F.col("_rk") <= F.col("_room")))
    return chosen.select(*samples.columns)


def trailing_hidden(points: DataFrame, keys: Keys, lost_after: int = 8) -> DataFrame:
    """Length of the hidden tail of each track and the failure it implies."""
    keys = list(keys)
    rows = per_key(points, keys, {"_last": F.max(F.when(F.col("visible"), F.col("frame")))})
    tail = F.sum(F.when(F.col("frame") > F.coalesce("_last", F.lit(-1)), 1).otherwise(0))
    return rows.groupBy(*keys).agg(tail.alias("lost_streak")).withColumn(
        "failure_reason", F.when(F.col("lost_streak") >= lost_after, "target_lost").otherwise("none")
    )


def last_messages(messages: DataFrame, keys: Keys, order: str, kept: int) -> DataFrame:
    """The newest ``kept`` rows per conversation; the row limit is applied before the shuffle too."""
    w = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return messages.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= kept).drop("_rk")
