"""Scoring of predictions against ground truth, as one long metric table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..constants import POSE_BONES
from .quantiles import exact_median
from .sequence import drop_halo, run_ids, running_sum, with_halo
from .tiling import is_tiled, parts

Keys = Sequence[str]
HARD = "hard"


def judged(value: Column, threshold: Column, higher: Column) -> Column:
    """True, false, or null when there is nothing to judge."""
    return F.when(value.isNotNull() & threshold.isNotNull(), F.when(higher, value >= threshold).otherwise(value <= threshold))


def gate(normal: float | None, hard: float | None) -> Column:
    """Threshold by difficulty."""
    as_double = lambda v: F.lit(v).cast("double")
    return F.when(F.col("difficulty") == HARD, as_double(hard)).otherwise(as_double(normal))


def long_metrics(wide: DataFrame, keys: Keys, specs: Sequence[tuple[str, Column, Column, bool]]) -> DataFrame:
    """(name, value, threshold, higher_is_better) columns turned into rows and judged."""
    items = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), value.cast("double").alias("value"), limit.cast("double").alias("threshold"),
                F.lit(higher).alias("higher_is_better"),
            )
            for name, value, limit, higher in specs
        ]
    )
    rows = wide.select(*keys, F.explode(items).alias("m")).select(*keys, "m.*")
    return rows.withColumn("passed", judged(F.col("value"), F.col("threshold"), F.col("higher_is_better")))


def one_per_frame(df: DataFrame, keys: Keys, position: str) -> DataFrame:
    """Rows of equal frame resolved: the one of highest ``position``, or without it the greatest row."""
    rest = [c for c in df.columns if c not in (*keys, "frame", position)]
    order = [position] if position in df.columns else []
    best = F.max(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*keys, "frame").agg(best).select(*keys, "frame", *[F.col("_r")[c].alias(c) for c in rest])


def match_frames(gt: DataFrame, pred: DataFrame, keys: Keys, position: str = "position") -> DataFrame:
    """Ground-truth frames with the prediction of the same frame; the frame is part of the key.

    Of rows that repeat a frame, on either side, the one of highest ``position`` counts.
    """
    keys = list(keys)
    tile = ["tile"] if is_tiled(gt) else []
    place = lambda df: [position] if position in df.columns else []
    truth = gt.select(*keys, *tile, "frame", *place(gt), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("visible").alias("g_vis"))
    guess = pred.select(*keys, "frame", *place(pred), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("visible").alias("q_vis"))
    truth, guess = (one_per_frame(side, keys, position) for side in (truth, guess))
    rows = truth.join(guess, [*keys, "frame"], "left").withColumn("q_vis", F.coalesce("q_vis", F.lit(False)))
    hit = F.col("g_vis") & F.col("q_vis")
    return rows.withColumns(
        {"hit": hit, "miss": F.col("g_vis") & ~F.col("q_vis"), "err": F.when(hit, F.hypot(F.col("qx") - F.col("gx"), F.col("qy") - F.col("gy")))}
    )


def recovery_gaps(matched: DataFrame, keys: Keys) -> DataFrame:
    """keys, gap: frames from the first miss up to the hit that ends an island of misses.

    An island is what lies between two hits. Hidden ground truth counts once a miss has been
    seen. Islands are aggregated by (key, hit count), so a hot track spreads over its islands.
    """
    keys = list(keys)
    rows = running_sum(matched, keys, "frame", {"island": F.col("hit").cast("int")}, inclusive=False)
    rows = running_sum(rows, keys, "frame", {"pos": F.lit(1)}, inclusive=False)
    islands = rows.groupBy(*keys, "island").agg(
        F.min(F.when(F.col("miss"), F.col("pos"))).alias("_first"),
        F.max(F.when(F.col("hit"), F.col("pos"))).alias("_end"),
    )
    return islands.filter("_first is not null and _end is not null").select(*keys, (F.col("_end") - F.col("_first")).cast("double").alias("gap"))


def identity_swaps(matched: DataFrame, keys: Keys) -> DataFrame:
    """Frames where the prediction jumps while the truth of the frame before (by number) is near."""
    keys = list(keys)
    w = W.partitionBy(*parts(matched, keys)).orderBy("frame")
    rows = with_halo(matched, keys, "frame", before=1, after=0)
    prev = {f"_{c}": F.lag(c).over(w) for c in ("frame", "gx", "gy", "qx", "qy", "hit")}
    rows = drop_halo(rows.withColumns(prev))
    jump = F.hypot(F.col("qx") - F.col("_qx"), F.col("qy") - F.col("_qy"))
    moved = F.hypot(F.col("gx") - F.col("_gx"), F.col("gy") - F.col("_gy"))
    swap = F.col("hit") & F.col("_hit") & (F.col("_frame") == F.col("frame") - 1) & (jump > 40) & (moved < 15)
    return rows.withColumn("swap", F.coalesce(swap, F.lit(False)))


def _track_facts(matched: DataFrame, keys: list[str]) -> DataFrame:
    """All figures of untiled clips from windows on one partitioning and one aggregate."""
    w = W.partitionBy(*keys).orderBy("frame")
    before, so_far = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    hit = F.col("hit").cast("int")
    rows = matched.withColumns({
        "_island": F.coalesce(F.sum(hit).over(before), F.lit(0)), "_rank": F.sum(hit).over(so_far),
        "_all": F.sum(hit).over(W.partitionBy(*keys)), "_pos": F.row_number().over(w),
    })
    inside = W.partitionBy(*keys, "_island").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_lost", F.min(F.when(F.col("miss"), F.col("_pos"))).over(inside))
    tail = F.col("hit") & (F.col("_rank") > F.col("_all") - F.greatest(F.lit(1), F.floor(F.col("_all") / 5)))
    return rows.groupBy(*keys).agg(
        *_counts(), F.avg(F.when(tail, F.col("err"))).alias("_drift"), F.median("err").alias("_median"),
        F.median(F.when(F.col("hit"), (F.col("_pos") - F.col("_lost")).cast("double"))).alias("_recovery"),
    )


def _counts() -> list[Column]:
    return [
        F.sum(F.col("g_vis").cast("int")).alias("_seen"),
        F.sum(F.col("hit").cast("int")).alias("_hits"),
        F.sum((F.col("err") <= 10.0).cast("int")).alias("_near"),
        F.sum(F.col("swap").cast("int")).alias("_swaps"),
    ]


def _split_track_facts(matched: DataFrame, keys: list[str]) -> DataFrame:
    """The same figures where tracks are split: each from mergeable parts of the tiles."""
    from .joins import attach

    scored = running_sum(matched, keys, "frame", {"_rank": F.col("hit").cast("int")})
    facts = scored.groupBy(*keys).agg(*_counts())
    tails = attach(scored.filter("hit"), facts.select(*keys, "_hits"), keys)
    tail = tails.filter(F.col("_rank") > F.col("_hits") - F.greatest(F.lit(1), F.floor(F.col("_hits") / 5))).groupBy(*keys).agg(F.avg("err").alias("_drift"))
    median = exact_median(matched, keys, F.col("err"), "_median")
    gaps = exact_median(recovery_gaps(matched, keys), keys, F.col("gap"), "_recovery")
    for part in (tail, median, gaps):
        facts = facts.join(part, keys, "left")
    return facts


def track_metrics(gt: DataFrame, pred: DataFrame, clips: DataFrame, keys: Keys = ("clip_id",)) -> DataFrame:
    """Six metrics per clip. ``clips`` has keys and difficulty; clips without frames are kept.

    The drift is over the last fifth of the hits, at least one.
    """
    keys = list(keys)
    matched = identity_swaps(match_frames(gt, pred, keys), keys)
    facts = (_split_track_facts if is_tiled(matched) else _track_facts)(matched, keys)
    wide = clips.select(*keys, "difficulty").join(facts, keys, "left")
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return long_metrics(
        wide,
        keys,
        [
            ("center_median_px", F.col("_median"), gate(3.0, 8.0), False),
            ("success_at_10px", share("_near", "_hits"), gate(0.95, 0.80), True),
            ("trajectory_completeness", share("_hits", "_seen"), gate(0.98, 0.90), True),
            ("drift_tail_mean_px", F.col("_drift"), F.lit(None), False),
            ("occlusion_recovery_frames", F.coalesce("_recovery", F.lit(0.0)), gate(None, 10.0), False),
            ("identity_swaps", F.coalesce("_swaps", F.lit(0)), F.lit(1.0), False),
        ],
    )


# --- pose -----------------------------------------------------------------------------------


def by_name(points: Column) -> Column:
    """Keypoint array (17 entries) as a map; the last of equal names wins."""
    backwards = F.reverse(F.transform(points, lambda k: k["name"]))
    kept = F.filter(points, lambda k, i: F.array_position(backwards, k["name"]) == F.size(points) - i)
    return F.map_from_arrays(F.transform(kept, lambda k: k["name"]), kept)


def _dist(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def match_poses(gt: DataFrame, pred: DataFrame, keys: Keys, position: str = "position") -> DataFrame:
    """Ground-truth frames with their prediction: ``g`` and ``q`` are maps name -> keypoint.

    Of rows that repeat a frame, on either side, the one of highest ``position`` counts.
    """
    keys = list(keys)
    tile = ["tile"] if is_tiled(gt) else []
    place = lambda df: [position] if position in df.columns else []
    truth = one_per_frame(gt.select(*keys, *tile, "frame", *place(gt), "keypoints"), keys, position)
    guess = one_per_frame(pred.select(*keys, "frame", *place(pred), "keypoints"), keys, position)
    truth = truth.select(*keys, *tile, "frame", by_name(F.col("keypoints")).alias("g"))
    return truth.join(guess.select(*keys, "frame", by_name(F.col("keypoints")).alias("q")), [*keys, "frame"], "left")


def pck_counts(matched: DataFrame, keys: Keys, fallback: float = 50.0) -> DataFrame:
    """Visible keypoints, hits and misses per clip; counted inside the frame, then summed."""
    at = lambda name: F.try_element_at("g", F.lit(name))
    torso = F.coalesce(F.greatest(F.lit(1.0), _dist(at("left_shoulder"), at("left_hip"))), F.lit(fallback))
    seen = F.filter(F.map_values("g"), lambda k: k["visible"])
    good = F.filter(
        seen,
        lambda k: F.coalesce(
            F.try_element_at("q", k["name"])["visible"] & (_dist(F.try_element_at("q", k["name"]), k) <= torso * 0.05), F.lit(False)
        ),
    )
    return matched.groupBy(*keys).agg(F.sum(F.size(seen)).alias("_total"), F.sum(F.size(good)).alias("_hits"))


def _joint_moves(a: Column, b: Column) -> Column:
    """Displacements of keypoints visible in both maps."""
    shared = F.filter(F.map_values(a), lambda k: F.coalesce(k["visible"] & F.try_element_at(b, k["name"])["visible"], F.lit(False)))
    return F.transform(shared, lambda k: _dist(k, F.try_element_at(b, k["name"])))


def static_jitter(matched: DataFrame, keys: Keys) -> DataFrame:
    """Predicted displacements between neighbouring frames whose truth hardly moves."""
    keys = list(keys)
    w = W.partitionBy(*parts(matched, keys)).orderBy("frame")
    rows = with_halo(matched, keys, "frame", before=1, after=0)
    rows = drop_halo(rows.withColumns({"_g": F.lag("g").over(w), "_q": F.lag("q").over(w)}))
    rows = rows.withColumn("_m", _joint_moves(F.col("_g"), F.col("g")))
    mean = F.aggregate("_m", F.lit(0.0), lambda s, v: s + v) / F.when(F.size("_m") > 0, F.size("_m"))
    still = rows.filter(mean <= 1.0).filter(F.col("_q").isNotNull() & F.col("q").isNotNull())
    return still.select(*keys, F.explode(_joint_moves(F.col("_q"), F.col("q"))).alias("move"))


def bone_cv(pred: DataFrame, keys: Keys) -> DataFrame:
    """Mean coefficient of variation of the bone lengths of a clip."""
    keys = list(keys)
    place = ["position"] if "position" in pred.columns else []
    single = one_per_frame(pred.select(*keys, "frame", *place, "keypoints"), keys, "position")
    rows = single.select(*keys, by_name(F.col("keypoints")).alias("q"))
    ends = [(F.try_element_at("q", F.lit(a)), F.try_element_at("q", F.lit(b))) for a, b in POSE_BONES]
    lengths = F.array(*[F.when(a["visible"] & b["visible"], _dist(a, b)) for a, b in ends])
    bones = rows.select(*keys, F.posexplode(lengths).alias("bone", "len")).filter("len is not null")
    per_bone = bones.groupBy(*keys, "bone").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mu"), F.stddev_pop("len").alias("sd"))
    return per_bone.filter("n >= 3 and mu > 1e-6").groupBy(*keys).agg(F.avg(F.col("sd") / F.col("mu")).alias("_cv"))


def pose_recovery(matched: DataFrame, keys: Keys) -> DataFrame:
    """keys, gap: frames from the latest loss of the truth to the first frame seen again by both."""
    keys = list(keys)
    any_seen = lambda m: F.coalesce(F.exists(F.map_values(m), lambda k: k["visible"]), F.lit(False))
    tile = ["tile"] if is_tiled(matched) else []
    rows = matched.select(*keys, *tile, "frame", any_seen(F.col("g")).alias("gv"), any_seen(F.col("q")).alias("qv"))
    w = W.partitionBy(*parts(rows, keys)).orderBy("frame")
    rows = with_halo(rows, keys, "frame", before=1, after=0)
    rows = drop_halo(rows.withColumn("onset", F.coalesce(F.lag("gv").over(w) & ~F.col("gv"), F.lit(False))))
    rows = run_ids(rows, keys, ~F.col("onset"))
    rows = running_sum(rows, keys, "frame", {"pos": F.lit(1)}, inclusive=False)
    spans = rows.filter("run_id > 0").groupBy(*keys, "run_id").agg(
        F.min("pos").alias("_a"), F.min(F.when(F.col("gv") & F.col("qv"), F.col("pos"))).alias("_z")
    )
    return spans.filter("_z is not null").select(*keys, (F.col("_z") - F.col("_a")).cast("double").alias("gap"))


def pose_metrics(gt: DataFrame, pred: DataFrame, clips: DataFrame, keys: Keys = ("clip_id",)) -> DataFrame:
    keys = list(keys)
    matched = match_poses(gt, pred, keys)
    pieces = [
        pck_counts(matched, keys),
        exact_median(static_jitter(matched, keys), keys, F.col("move"), "_jitter", split=is_tiled(matched)),
        bone_cv(pred, keys),
        exact_median(pose_recovery(matched, keys), keys, F.col("gap"), "_recovery", split=is_tiled(matched)),
    ]
    wide = clips.select(*keys, "difficulty")
    for piece in pieces:
        wide = wide.join(piece, keys, "left")
    total = F.when(F.col("_total") > 0, F.col("_total"))
    return long_metrics(
        wide,
        keys,
        [
            ("pck_at_0_05", F.coalesce(F.col("_hits") / total, F.lit(0.0)), gate(0.95, 0.85), True),
            ("keypoint_miss_rate", F.coalesce((F.col("_total") - F.col("_hits")) / total, F.lit(0.0)), F.lit(None), False),
            ("static_jitter_px", F.col("_jitter"), F.lit(2.0), False),
            ("bone_length_cv", F.col("_cv"), F.lit(0.03), False),
            ("occlusion_recovery_frames", F.coalesce("_recovery", F.lit(0.0)), gate(None, 10.0), False),
        ],
    )


# --- calibration and physics: one row per clip on both sides ---------------------------------


def calibration_metrics(gt: DataFrame, pred: DataFrame, keys: Keys = ("clip_id",)) -> DataFrame:
    """``gt``: ruler ends, length, origin, angle, has_reliable_ruler, difficulty. ``pred``: automatic result."""
    keys = list(keys)
    rows = gt.join(pred, keys, "inner")
    reliable = F.coalesce(F.col("has_reliable_ruler"), F.lit(True))
    refused = F.col("rejected") | F.col("failure_reason").isin("no_ruler", "low_confidence")
    length = F.hypot(F.col("ruler_b.x") - F.col("ruler_a.x"), F.col("ruler_b.y") - F.col("ruler_a.y"))
    ppm = F.when(F.col("length_m") > 0, length / F.col("length_m"))
    failed = F.col("rejected") | F.col("pixels_per_meter").isNull() | ppm.isNull()
    rows = rows.withColumns({"_ppm": ppm, "_failed": failed, "_refused": refused, "_ok": reliable})
    turned = F.abs(F.pmod(F.col("axis_angle") - F.col("gt_axis_angle_deg") + 180.0, F.lit(360.0)) - 180.0)
    shift = F.hypot(F.col("origin_x") - F.col("gt_origin.x"), F.col("origin_y") - F.col("gt_origin.y"))
    keep = [*keys, "difficulty"]
    no_ruler = long_metrics(
        rows.filter("not _ok"), keep, [("rejection_when_no_ruler", F.when(F.col("_refused"), 1.0).otherwise(0.0), F.lit(1.0), True)]
    )
    lost = long_metrics(
        rows.filter("_ok and _failed"), keep,
        [("scale_relative_error", F.lit(None), F.lit(None), True), ("false_reject", F.lit(1.0), F.lit(0.0), False)],
    )
    found = long_metrics(
        rows.filter("_ok and not _failed"), keep,
        [
            ("scale_relative_error", F.abs(F.col("pixels_per_meter") - F.col("_ppm")) / F.col("_ppm"), gate(0.01, 0.03), False),
            ("axis_angle_error_deg", turned, gate(1.0, 3.0), False),
            ("origin_error_px", shift, gate(3.0, 8.0), False),
        ],
    )
    return no_ruler.unionByName(lost).unionByName(found).drop("difficulty")


def physics_metrics(gt: DataFrame, pred: DataFrame, keys: Keys = ("clip_id",)) -> DataFrame:
    """Relative errors of derived quantities; a missing or zero truth is never judged."""
    keys = list(keys)
    limits = {"period_s": 0.02, "gravity_ms2": 0.05, "velocity_ms": 0.05, "acceleration_ms2": 0.05}
    truth = gt.select(*keys, *[F.col(c).alias(f"g_{c}") for c in limits])
    rows = truth.join(pred.select(*keys, *limits, "trajectory_fit_error"), keys, "inner")

    def relative(c: str) -> Column:
        t = F.col(f"g_{c}")
        return F.when(F.abs(t) >= 1e-9, F.abs(F.col(c) - t) / F.abs(t))

    specs = [(f"{c.rsplit('_', 1)[0]}_relative_error", relative(c), F.lit(v), False) for c, v in limits.items()]
    out = long_metrics(rows, keys, specs)
    fit = long_metrics(rows.filter("trajectory_fit_error is not null"), keys, [("trajectory_fit_error", F.col("trajectory_fit_error"), F.lit(0.05), False)])
    return out.unionByName(fit)


def clip_passed(metrics: DataFrame, keys: Keys) -> DataFrame:
    """A clip passes when something was judged and everything judged passed."""
    return metrics.groupBy(*keys).agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))
