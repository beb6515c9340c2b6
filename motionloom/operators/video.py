"""Frame index of clips from packet or frame tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .scan import composed_scan, raised
from .sequence import drop_halo, per_key, run_ids, running_max, with_halo
from .tiling import hot_keys, number_rows, parts, tile_tracks
from .timeline import explode_range

Keys = Sequence[str]


def index_packets(packets: DataFrame, keys: Keys, time_base: float, *, cell: int = 1_000_000) -> DataFrame:
    """keys, [tile], frame, pts, pts_ms from packets (pts, size).

    Empty packets and missing pts are skipped, pts are sorted and unique, milliseconds count from
    the first one and are rounded half to even. ``cell`` is the pts width that splits hot clips.
    """
    keys = list(keys)
    usable = packets.filter("size > 0 and pts is not null")
    unique = usable.select(*keys, "pts").distinct()
    hot = hot_keys(unique, keys)
    numbered = number_rows(unique, keys, ["pts"], F.floor(F.col("pts") / cell), "frame", hot=hot)
    tiled = tile_tracks(numbered, keys, hot=hot)
    rows = per_key(tiled, keys, {"_first": F.min("pts")})
    ms = F.bround((F.col("pts") - F.col("_first")) * F.lit(time_base) * 1000.0).cast("long")
    return rows.withColumn("pts_ms", ms).drop("_first")


def needs_decoding(packets: DataFrame, keys: Keys) -> DataFrame:
    """Clips whose packets have duplicate or no usable timestamps."""
    kept = F.when((F.col("size") > 0) & F.col("pts").isNotNull(), F.col("pts"))
    per_pts = packets.select(*keys, kept.alias("_p")).groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))
    return per_pts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_p").isNotNull(), F.col("_c"))), F.lit(0)).alias("n_usable"),
        F.count("_p").alias("n_unique"),
    ).withColumn("fallback", (F.col("n_usable") == 0) | (F.col("n_usable") != F.col("n_unique")))


def repair_pts(frames: DataFrame, keys: Keys, step: int) -> DataFrame:
    """Strictly increasing pts for decoded frames: missing -> position * step, late -> previous + step.

    A frame above the largest value any history could have reached resets the repair, so each
    stretch between resets is repaired on its own; stretches with a late frame are scanned as
    composed maps of blocks.
    """
    keys = list(keys)
    raw = frames.withColumn("_v", F.coalesce(F.col("pts"), F.col("frame") * F.lit(step)))
    lead = running_max(raw, keys, "frame", {"_u": F.col("_v") - F.col("frame") * F.lit(step)}, inclusive=False)
    ceiling = F.col("_u") + (F.col("frame") - 1) * F.lit(step)
    fresh = F.col("_u").isNull() | (F.col("_v") > ceiling)
    marked = run_ids(lead, keys, ~fresh).withColumn("_fresh", fresh)
    late = marked.filter("not _fresh").select(*keys, "run_id").distinct()
    fine = marked.join(late, [*keys, "run_id"], "left_anti").select(*keys, "frame", F.col("_v").cast("long").alias("pts"))
    broken = marked.join(late, [*keys, "run_id"], "left_semi").select(*keys, "run_id", F.col("frame").cast("int").alias("frame"), F.col("_v").cast("long").alias("_v"))
    repaired = composed_scan(broken, [*keys, "run_id"], "_v", F.lit(-(2**62)).cast("long"), raised(step))
    return fine.unionByName(repaired.select(*keys, "frame", F.col("state").alias("pts")))


def index_clips(packets: DataFrame, frames: DataFrame, keys: Keys, time_base: float, step: int, *, cell: int = 1_000_000) -> DataFrame:
    """keys, frame, pts, pts_ms of every clip: from its packets where they are sound, else from its decoded frames.

    ``frames``: keys, frame (position), pts as the decoder gave them. Packets with repeated
    timestamps, or none, send a clip the other way; each row is read by one of the two ways only,
    after the clips were judged. Milliseconds count from a clip's first frame, half to even.
    """
    keys = list(keys)
    judged = cut_lineage(needs_decoding(packets, keys).select(*keys, "fallback"))
    sound = index_packets(packets.join(judged.filter("NOT fallback"), keys, "left_semi"), keys, time_base, cell=cell)
    broken = frames.join(judged.filter("NOT fallback"), keys, "left_anti")
    repaired = repair_pts(broken, keys, step)
    first = repaired.groupBy(*keys).agg(F.min("pts").alias("_first"))
    ms = F.bround((F.col("pts") - F.col("_first")) * F.lit(time_base) * 1000.0).cast("long")
    decoded = repaired.join(first, keys).select(*keys, "frame", "pts", ms.alias("pts_ms"))
    return sound.select(*keys, F.col("frame").cast("int").alias("frame"), F.col("pts").cast("long").alias("pts"), "pts_ms").unionByName(decoded)


def constant_rate_index(points: DataFrame, keys: Keys, fps: Column | float) -> DataFrame:
    """Frame index of clips known only by their rate: frames 0..max(frame) on a 1 ms base."""
    rate = F.greatest(fps if isinstance(fps, Column) else F.lit(float(fps)), F.lit(1e-6))
    last = points.groupBy(*keys).agg(F.coalesce(F.max("frame"), F.lit(0)).alias("_last"))
    rows = explode_range(last, F.lit(0), F.col("_last"), "frame")
    return rows.select(*keys, "frame", F.col("frame").cast("long").alias("pts"), F.bround(F.col("frame") * 1000.0 / rate).cast("long").alias("pts_ms"))


def clip_facts(frame_time: DataFrame, keys: Keys) -> DataFrame:
    """frame_count, fps and duration of every clip."""
    keys = list(keys)
    w = W.partitionBy(*parts(frame_time, keys)).orderBy("frame")
    gaps = with_halo(frame_time, keys, "frame", before=1, after=0)
    gaps = drop_halo(gaps.withColumn("_gap", F.col("pts_ms") - F.lag("pts_ms").over(w)))
    facts = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.min("pts_ms").alias("_a"),
        F.max("pts_ms").alias("_z"),
        F.max_by("_gap", "frame").alias("_gap"),
    )
    span = F.col("_z") - F.col("_a")
    timed = (F.col("frame_count") >= 2) & (span > 0)
    fps = F.when(timed, (F.col("frame_count") - 1) * 1000.0 / F.when(timed, span)).otherwise(F.lit(30.0))
    length = F.when(F.col("frame_count") == 1, F.col("_a")).otherwise(F.col("_z") + F.greatest("_gap", F.lit(0)))
    return facts.select(*keys, "frame_count", fps.alias("fps"), length.alias("duration_ms"))


def frame_delays(frame_time: DataFrame, keys: Keys) -> DataFrame:
    """How long each frame stays on screen; the last one repeats the gap before it."""
    keys = list(keys)
    w = W.partitionBy(*parts(frame_time, keys)).orderBy("frame")
    rows = with_halo(frame_time, keys, "frame", before=1, after=1)
    rows = rows.withColumns({"_n": F.lead("pts_ms").over(w), "_p": F.lag("pts_ms").over(w)})
    gap = F.coalesce(F.col("_n") - F.col("pts_ms"), F.col("pts_ms") - F.col("_p"))
    delay = F.coalesce(F.greatest(gap, F.lit(1)), F.lit(33)).cast("long")
    return drop_halo(rows).withColumn("delay_ms", delay).drop("_n", "_p")


def index_of_pts(frame_time: DataFrame, wanted: DataFrame, keys: Keys) -> DataFrame:
    """First frame at or after each wanted pts of its clip, or the last frame.

    ``wanted``: keys, query_id, value. Frames and wanted values form one ordered stream per clip,
    so the lookup is a scan, not a range join.
    """
    from .sequence import carry, file_marks, with_marks
    from .tiling import SPLIT, is_tiled

    keys = list(keys)
    tile = ["tile"] if is_tiled(frame_time) else []
    null_long = F.lit(None).cast("long")
    frames = frame_time.select(*keys, *tile, F.col("pts").alias("_at"), F.lit(1).alias("_side"), F.col("frame").alias("_f"), null_long.alias("query_id"))
    asked = wanted.select(*keys, F.col("value").cast("long").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("int").alias("_f"), F.col("query_id").cast("long"))
    ends = frame_time.groupBy(*keys).agg(F.max("frame").alias("_last"))
    if tile:
        tops = frame_time.filter(SPLIT).groupBy(*keys, "tile").agg(F.max("pts").cast("long").alias("_at"))
        asked = file_marks(asked, keys, tops, forward=False)
    stream = with_marks(frames, asked, parts(frames, keys)).withColumn("_ord", F.struct("_at", "_side", F.coalesce("query_id", F.col("_f").cast("long"))))
    found = carry(stream, keys, "_ord", {"frame": F.col("_f")}, forward=False).filter("query_id is not null")
    return found.select(*keys, "query_id", "frame").join(ends, keys).select(*keys, "query_id", F.coalesce("frame", "_last").alias("frame"))
