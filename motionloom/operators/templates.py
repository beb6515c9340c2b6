"""Anchors and templates on frames held as arrays: from pixels to the tables that `stabilize` reads.

Frames: key columns, frame, width and `planes`, an array of row-major channel arrays. A clip's
frames pass one task in order, as a stream: what is held is a handful of templates, never a clip.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CORNER_GRID, CORNER_MIN_PX, DEFAULT_TEMPLATE, EVOLVE_RATE, EXPANDED_SEARCH_RADIUS, GOOD_MATCH, LOST_AFTER, MAX_TEMPLATE, MIN_TEMPLATE, NCC_COARSE_SCALE, NCC_MIN, NCC_SEARCH, PATCH_PX, SEARCH_RADIUS, SHAKE_CLUSTER_PX, TETHER_RATE
from ..functions import images

Keys = Sequence[str]


def gray_of(planes: Column) -> Column:
    """The single plane, or the luma of three."""
    plane = lambda k: F.get(planes, F.lit(k))
    return F.when(F.size(planes) == 1, plane(0)).otherwise(images.luma(plane(0), plane(1), plane(2)))


def corner_grid(frames: DataFrame, keys: Keys, *, least: int = CORNER_MIN_PX, grid: int = CORNER_GRID, pad: int = PATCH_PX // 2 + 1) -> DataFrame:
    """keys, frame, corner, score, x, y: cells of high gradient energy in the frame corners, for `pick_anchors`."""
    gray = frames.select(*keys, "frame", "width", gray_of(F.col("planes")).alias("_gray"))
    height = F.floor(F.size("_gray") / F.col("width")).cast("int")
    staged = gray.withColumns({"_energy": images.gradient_energy(F.col("_gray"), F.col("width")), "_rois": images.corner_rois(F.col("width"), height, least)})
    cells = images.corner_cells(F.col("_energy"), F.col("width"), F.col("_rois"), pad, grid)
    return staged.select(*keys, "frame", F.inline(cells)).select(*keys, "frame", "corner", "score", F.col("x").cast("double"), F.col("y").cast("double"))


def _image(flat: np.ndarray, width: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, int(width))


def ncc_match(pairs: DataFrame, keys: Keys, *, side: int = PATCH_PX, searches: Sequence[int] = NCC_SEARCH, scale: int = NCC_COARSE_SCALE, accept: float = NCC_MIN) -> DataFrame:
    """Finds the square around (x, y) of gray array `source` in `gray`, both of one width.

    Gives keys, frame, found_x, found_y, score and accepted; a square without texture or beyond the
    border has no row.
    """
    keys = list(keys)
    ids = [pairs.schema[c] for c in (*keys, "frame")]
    schema = T.StructType([*ids, *[T.StructField(c, T.DoubleType()) for c in ("found_x", "found_y", "score")], T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                template = images.patch_at(_image(r.source, r.width), r.x, r.y, side)
                if template is not None:
                    x, y, score = images.ncc_seek(_image(r.gray, r.width), template, r.x, r.y, searches, scale, accept)
                    rows.append((*(getattr(r, c) for c in (*keys, "frame")), x, y, score, score >= accept))
            yield pd.DataFrame(rows, columns=schema.names)

    return pairs.select(*keys, "frame", "width", "gray", "source", "x", "y").mapInPandas(run, schema)


def ssd_match(pairs: DataFrame, keys: Keys, *, template: tuple[int, int], radius: int = SEARCH_RADIUS, rectangular: bool = False) -> DataFrame:
    """Finds the rectangle around (x, y) of `source` in `planes` (arrays of channel arrays of one width).

    Gives keys, frame, found_x, found_y (sub-pixel) and confidence; a rectangle without texture or
    beyond the border has no row.
    """
    keys = list(keys)
    ids = [pairs.schema[c] for c in (*keys, "frame")]
    schema = T.StructType([*ids, *[T.StructField(c, T.DoubleType()) for c in ("found_x", "found_y", "confidence")]])
    tw, th = template
    mask = np.ones((th, tw)) if rectangular else images.ellipse_mask(tw, th)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                before, now = (np.stack([_image(p, r.width) for p in planes]) for planes in (r.source, r.planes))
                patch = images.rectangle_at(before, r.x, r.y, tw, th)
                if patch is not None:
                    x, y, peak = images.ssd_match(now, patch, mask, r.x, r.y, radius)
                    rows.append((*(getattr(r, c) for c in (*keys, "frame")), x, y, images.quality(peak)))
            yield pd.DataFrame(rows, columns=schema.names)

    return pairs.select(*keys, "frame", "width", "planes", "source", "x", "y").mapInPandas(run, schema)


def _streamed(frames: DataFrame, seeds: DataFrame, keys: Keys) -> DataFrame:
    """Each clip's seed row, then its frames in order, in one partition."""
    heads = seeds.withColumn("_frame_row", F.lit(False))
    rows = frames.select(*keys, "frame", "width", "planes").withColumn("_frame_row", F.lit(True))
    return heads.unionByName(rows, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "_frame_row", "frame")


def track_anchors(frames: DataFrame, anchors: DataFrame, keys: Keys, *, side: int = PATCH_PX, searches: Sequence[int] = NCC_SEARCH) -> DataFrame:
    """keys, frame, k, x, y for `stabilize.estimate_shake`: anchors of the first frame found again in each frame.

    `anchors`: keys, x, y, in any order. The search starts from the anchor moved by the last
    consensus shift, so it follows the camera; an anchor below the correlation NCC_MIN, or over 24 px
    off the consensus, has null x and y there. Anchors without texture are left out.
    """
    keys = list(keys)
    seeds = anchors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("seeds"))  # at most eight a clip
    schema = T.StructType([*[frames.schema[k] for k in keys], frames.schema["frame"], T.StructField("k", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, spots, held, last = None, [], None, (0.0, 0.0)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                if key != clip:
                    clip, spots, held, last = key, [], None, (0.0, 0.0)
                if not r.frame_row:
                    spots = [(p["x"], p["y"]) for p in r.seeds]
                    continue
                gray = _image(r.gray, r.width)
                if held is None:
                    held = [(spot, patch) for spot in spots if (patch := images.patch_at(gray, *spot, side)) is not None]
                    found = [spot for spot, _ in held]
                else:
                    seen = [images.ncc_seek(gray, patch, x + last[0], y + last[1], searches) for (x, y), patch in held]
                    moves = [(fx - x, fy - y) if score >= NCC_MIN else None for (fx, fy, score), ((x, y), _) in zip(seen, held, strict=True)]
                    last = consensus_shift([m for m in moves if m], last)
                    kept = [m is not None and (m[0] - last[0]) ** 2 + (m[1] - last[1]) ** 2 <= SHAKE_CLUSTER_PX**2 for m in moves]
                    found = [(fx, fy) if k else None for (fx, fy, _), k in zip(seen, kept, strict=True)]
                rows += [(*key, r.frame, k, *(spot or (None, None))) for k, spot in enumerate(found)]
            yield pd.DataFrame(rows, columns=schema.names).astype({"x": float, "y": float})

    staged = _streamed(frames, seeds, keys)
    gray = F.when(F.col("_frame_row"), gray_of(F.col("planes")))
    return staged.select(*keys, "frame", "width", gray.alias("gray"), "seeds", F.col("_frame_row").alias("frame_row")).mapInPandas(run, schema)


def consensus_shift(moves: list[tuple[float, float]], last: tuple[float, float]) -> tuple[float, float]:
    """Medians of the largest group of moves within 24 px of one of them; the last shift decides ties and stands in for none."""
    if not moves:
        return last
    points = np.array(moves)
    near = ((points[:, None] - points[None]) ** 2).sum(axis=2) <= SHAKE_CLUSTER_PX**2
    centres = np.array([np.median(points[group], axis=0) for group in near])
    away = ((centres - last) ** 2).sum(axis=1)
    best = min(range(len(points)), key=lambda k: (-near[k].sum(), away[k], k))
    return float(centres[best][0]), float(centres[best][1])


def template_seeds(prompts: DataFrame, keys: Keys) -> DataFrame:
    """keys, x, y, tw, th, rectangular from prompts (keys, ord, kind, x, y, x2, y2); the last one that is not negative counts.

    A whole box gives its centre and its size within 15 and 72 px, any other prompt a round template of 31 px.
    """
    boxed = (F.col("kind") == "box") & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    size = lambda a, b: F.bround(F.least(F.lit(float(MAX_TEMPLATE)), F.greatest(F.lit(float(MIN_TEMPLATE)), F.abs(F.col(b) - F.col(a))))).cast("int")
    default = F.lit(DEFAULT_TEMPLATE)
    spec = F.struct(
        F.when(boxed, (F.col("x") + F.col("x2")) / 2).otherwise(F.col("x")).alias("x"), F.when(boxed, (F.col("y") + F.col("y2")) / 2).otherwise(F.col("y")).alias("y"),
        F.when(boxed, size("x", "x2")).otherwise(default).alias("tw"), F.when(boxed, size("y", "y2")).otherwise(default).alias("th"), boxed.alias("rectangular"),
    )
    return prompts.filter("kind <> 'negative'").groupBy(*keys).agg(F.max_by(spec, "ord").alias("_s")).select(*keys, "_s.*")


def autotrack(frames: DataFrame, seeds: DataFrame, keys: Keys, *, radii: tuple[int, int] = (SEARCH_RADIUS, EXPANDED_SEARCH_RADIUS)) -> DataFrame:
    """keys, frame, x, y, visible, confidence, lost_streak of one template per clip that follows its target.

    `seeds` as from `template_seeds`. Each frame is searched around the extrapolated place, wider if
    the match is poor; a good match moves the template a fifth towards what it found and a
    twentieth back to its first form. Clips whose seed has no texture or crosses the border have no rows.
    """
    keys = list(keys)
    schema = T.StructType([*[frames.schema[k] for k in keys], frames.schema["frame"], *[T.StructField(c, t) for c, t in (("x", T.DoubleType()), ("y", T.DoubleType()), ("visible", T.BooleanType()), ("confidence", T.DoubleType()), ("lost_streak", T.IntegerType()))]])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, walker = None, None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                if key != clip:
                    clip, walker = key, None
                if not r.frame_row:
                    walker = TemplateWalk(r.x, r.y, int(r.tw), int(r.th), r.rectangular, radii)
                elif walker is not None and (point := walker.step(np.stack([_image(p, r.width) for p in r.planes]))) is not None:
                    rows.append((*key, r.frame, *point))
            yield pd.DataFrame(rows, columns=schema.names)

    return _streamed(frames, seeds, keys).select(*keys, "frame", "width", "planes", "x", "y", "tw", "th", "rectangular", F.col("_frame_row").alias("frame_row")).mapInPandas(run, schema)


class TemplateWalk:
    """State of one clip: the template, its first form and the last few places."""

    def __init__(self, x: float, y: float, width: int, height: int, rectangular: bool, radii: tuple[int, int]):
        self.at, self.size, self.radii = (x, y), (width, height), radii
        self.mask = np.ones((height, width)) if rectangular else images.ellipse_mask(width, height)
        self.first = self.template = None
        self.started, self.lost, self.recent = False, 0, []

    def step(self, image: np.ndarray) -> tuple | None:
        if not self.started:
            self.started = True
            self.first = self.template = images.rectangle_at(image, *self.at, *self.size)
            place, peak = self.at, float("inf")
        elif self.first is not None:
            seen = np.array([p for p in self.recent if p is not None]).reshape(-1, 2)
            guess = images.extrapolated(seen, self.at)
            for radius in self.radii:
                *place, peak = images.ssd_match(image, self.template, self.mask, *guess, radius)
                if peak >= GOOD_MATCH:
                    break
        if self.first is None:
            return None
        visible = peak >= GOOD_MATCH
        if visible:
            self.at, self.lost = tuple(place), 0
            now = images.rectangle_at(image, *self.at, *self.size)
            if now is not None:
                moved = (1 - EVOLVE_RATE) * self.template + EVOLVE_RATE * now
                self.template = (1 - TETHER_RATE) * moved + TETHER_RATE * self.first
        else:
            self.lost += 1
            place = guess
        self.recent = [*self.recent[-3:], self.at if visible else None]
        return float(place[0]), float(place[1]), bool(visible), images.quality(peak), self.lost


def target_lost(points: DataFrame, keys: Keys) -> DataFrame:
    """keys, lost: whether a clip of `autotrack` ends with eight or more frames without its target."""
    return points.groupBy(*keys).agg((F.max_by("lost_streak", "frame") >= LOST_AFTER).alias("lost"))


def plane_corners(points: DataFrame, keys: Keys, squares: tuple[int, int], *, order: str = "ord") -> DataFrame:
    """keys, corner (0..3), x, y, by_id: outer inner corners of a board, by their ids or else of the bounding box.

    ``points``: keys, ``order``, id, x, y. Corners go lower left, lower right, upper right, upper
    left of the board's ids. If any of the four ids lacks, all four are those of the bounding
    box; of points with one id the last counts.
    """
    keys = list(keys)
    nx, ny = (max(side - 1, 1) for side in squares)
    wanted = (0, nx - 1, ny * nx - 1, (ny - 1) * nx)
    place = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    named = [F.max_by(place, F.when(F.col("id") == w, F.col(order))).alias(f"_c{k}") for k, w in enumerate(wanted)]
    ends = [fn(c).cast("double").alias(f"_{name}_{c}") for name, fn in (("low", F.min), ("high", F.max)) for c in ("x", "y")]
    found = points.groupBy(*keys).agg(*named, *ends)
    whole = F.lit(True)
    for k in range(4):
        whole = whole & F.col(f"_c{k}").isNotNull()
    boxed = [("_low_x", "_high_y"), ("_high_x", "_high_y"), ("_high_x", "_low_y"), ("_low_x", "_low_y")]
    corners = F.array(*[F.when(whole, F.col(f"_c{k}")).otherwise(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))) for k, (x, y) in enumerate(boxed)])
    return found.select(*keys, whole.alias("by_id"), F.posexplode(corners).alias("corner", "_p")).select(*keys, "corner", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), "by_id")
