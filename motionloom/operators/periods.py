"""Periods of runs: autocorrelation on an even grid, and zero crossings.

A run is resampled interval by interval on a grid of its median spacing. A grid of up to GRID_TILE
points is answered in one row. The lag products of a longer one are the inverse transform of its
power spectrum, taken in four steps: the grid is laid out as a matrix, its columns are transformed,
turned and exchanged for its rows, and the way back goes through the same blocks. That is three
exchanges and n log n work; no task holds more than one block of whole columns or rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import stored
from .fitting import zero_crossing_period
from .quantiles import exact_median
from .sequence import drop_halo, with_halo
from .tiling import is_tiled, parts
from .timeline import explode_range

Keys = Sequence[str]
GRID_TILE = 1 << 14
AXES = ("x", "y")
MIN_SAMPLES = 8
SHORTEST_S = 0.08
CLEAR_SHARE = 0.25  # of the product at lag 0
FLAT = 1e-9
TOLERANCE = 1e-9  # of the product at lag 0, for rounding in the Fourier products


def periods(rows: DataFrame, keys: Keys) -> DataFrame:
    """keys + ``period_s``: from x, or from y where x gives none. ``rows``: one run per key.

    A coordinate's period is the mean of its correlation and its crossing estimate, or the one
    there is. Runs that stand still along a coordinate have none there; runs without a period have
    no row.
    """
    keys = list(keys)
    found = correlation_periods(rows, keys).unionByName(crossing_periods(rows, keys))
    means = found.groupBy(*keys).agg(*[F.avg(F.when(F.col("axis") == a, F.col("period_s"))).alias(a) for a in AXES])
    return means.select(*keys, F.coalesce(*AXES).alias("period_s"))


def _swing(axis: str) -> Column:
    """Greatest distance from the mean, as an aggregate."""
    return F.greatest(F.max(axis) - F.avg(axis), F.avg(axis) - F.min(axis))


def crossing_periods(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis, period_s from zero crossings of both coordinates."""
    if is_tiled(rows):
        moving = rows.groupBy(*keys).agg(*[_swing(a).alias(f"_s{a}") for a in AXES])
        made = [zero_crossing_period(rows, keys, a).join(moving.filter(F.col(f"_s{a}") >= FLAT), keys).select(*keys, F.lit(a).alias("axis"), "period_s") for a in AXES]
        return made[0].unionByName(made[1])
    values = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in AXES]))
    long = rows.select(*keys, "frame", "time_s", values.alias("_p")).select(*keys, "frame", "time_s", "_p.*")
    w = W.partitionBy(*keys, "axis")
    centred = long.withColumn("v", F.col("v") - F.avg("v").over(w)).withColumn("_swing", F.max(F.abs("v")).over(w)).filter(F.col("_swing") >= FLAT).withColumn("_before", F.lag("v").over(w.orderBy("frame")))
    turned = centred.filter(((F.col("_before") <= 0) & (F.col("v") > 0)) | ((F.col("_before") >= 0) & (F.col("v") < 0)))
    gaps = turned.withColumn("_gap", F.col("time_s") - F.lag("time_s").over(w.orderBy("frame")))
    halves = gaps.groupBy(*keys, "axis").agg(F.count(F.lit(1)).alias("_n"), F.median(F.when(F.col("_gap") > 1e-6, F.col("_gap"))).alias("_half"))
    return halves.filter("_n >= 3 and _half is not null").select(*keys, "axis", (F.col("_half") * 2.0).alias("period_s"))


def even_grid(rows: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """(keys, g, x, y and the facts) on the grid of each run, and its facts: keys, dt, size, swing of each axis.

    A grid runs from the first sample to within half a step of the last one and needs eight
    points; each gap between samples fills its own grid points by linear interpolation. The facts,
    one row per run, are stored.
    """
    keys = list(keys)
    rows = rows.select(*parts(rows, keys), "frame", "time_s", *AXES)
    w = W.partitionBy(*parts(rows, keys)).orderBy("frame")
    here = F.struct("time_s", *AXES)
    gaps = drop_halo(with_halo(rows, keys, "frame", before=0, after=1).withColumn("_n", F.lead(here).over(w)))
    step = F.col("_n.time_s") - F.col("time_s")
    spans = [F.min("time_s").alias("_t0"), F.max("time_s").alias("_t1"), F.count(F.lit(1)).alias("_rows"), *[_swing(a).alias(f"_s{a}") for a in AXES]]
    if is_tiled(rows):
        spans = rows.groupBy(*keys).agg(*spans).join(exact_median(gaps.filter("_n is not null"), keys, step, "dt"), keys)
    else:
        spans = gaps.groupBy(*keys).agg(*spans, F.median(step).alias("dt"))
    size = F.ceil((F.col("_t1") - F.col("_t0")) / F.col("dt") + 0.5).cast("long")
    grids = spans.filter("dt > 1e-9").withColumn("size", size).filter((F.col("size") >= MIN_SAMPLES) & (F.col("_rows") >= MIN_SAMPLES))
    facts = ["dt", "size", *[f"_s{a}" for a in AXES]]
    grids = stored(grids.select(*keys, "_t0", *facts))
    placed = gaps.join(grids, keys)
    cell = lambda t: F.ceil((t - F.col("_t0")) / F.col("dt") - 1e-9).cast("long")
    last = F.col("_n").isNull()
    stop = F.when(last, F.col("size")).otherwise(cell(F.col("_n.time_s")))
    filled = explode_range(placed, cell(F.col("time_s")), stop - 1, "g")
    share = F.greatest(F.lit(0.0), (F.col("_t0") + F.col("g") * F.col("dt") - F.col("time_s")) / (F.col("_n.time_s") - F.col("time_s")))
    value = lambda a: F.when(last, F.col(a)).otherwise(F.col(a) + (F.col(f"_n.{a}") - F.col(a)) * share)
    return filled.select(*keys, F.col("g").cast("long").alias("g"), *[value(a).alias(a) for a in AXES], *facts), grids.drop("_t0")


def layout(size: int, block: int) -> tuple[int, int, int, int]:
    """(rows, columns, rows of a block, columns of a block) of the matrix for a grid of `size` points.

    It holds twice the points, all but the first ones zero, so no lag wraps around. Every number is
    a power of two; a block holds `block` values, or one whole column or row if that is more.
    """
    bits = (2 * size - 1).bit_length()
    rows, columns = 1 << (bits - bits // 2), 1 << bits // 2
    return rows, columns, min(rows, max(1, block // columns)), min(columns, max(1, block // rows))


def _column_block(block: int) -> Column:
    """Number of the column block that a grid point lies in, as ``layout`` has them."""
    bits = F.length(F.bin(2 * F.col("size") - 1))
    power = lambda b: F.pow(F.lit(2.0), b).cast("long")
    half = F.floor(bits / 2)
    columns, rows = power(half), power(bits - half)
    width = F.least(columns, F.greatest(F.lit(1), F.floor(F.lit(block) / rows))).cast("long")
    return F.floor((F.col("g") % columns) / width).cast("long")


def lag_products(centred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lag, cx, cy: sums of products at each lag of whole grids (keys, g, x, y, size)."""
    block = 4 * GRID_TILE
    named = [centred.schema[k] for k in keys]
    number = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    cells = T.StructType([*named, *number("size", "row", "column"), T.StructField("body", T.BinaryType())])
    lags = T.StructType([*named, *number("lag"), *[T.StructField(f"c{a}", T.DoubleType()) for a in AXES]])

    def turns(k: np.ndarray, c: np.ndarray, total: int, sign: int) -> np.ndarray:
        return np.exp(sign * 2j * np.pi * (k[:, None] * c[None, :] % total) / total)

    def labelled(made: pd.DataFrame, names: Sequence, schema: T.StructType) -> pd.DataFrame:
        for name, value in zip(keys, names, strict=True):
            made[name] = value
        return made[schema.names]

    def columns_in(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *names, column = key
        size = int(pdf["size"].iloc[0])
        rows, columns, deep, wide = layout(size, block)
        g = pdf["g"].to_numpy()
        lines = np.zeros((len(AXES), rows, wide))
        lines[:, g // columns, g % columns - column * wide] = pdf[list(AXES)].to_numpy().T
        spectra = np.fft.fft(lines, axis=1) * turns(np.arange(rows), column * wide + np.arange(wide), rows * columns, -1)
        bodies = [spectra[:, at : at + deep].tobytes() for at in range(0, rows, deep)]
        return labelled(pd.DataFrame({"size": size, "row": range(len(bodies)), "column": column, "body": bodies}), names, cells)

    def rows_through(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *names, row = key
        size = int(pdf["size"].iloc[0])
        rows, columns, deep, wide = layout(size, block)
        lines = np.empty((len(AXES), deep, columns), dtype=complex)
        for column, body in zip(pdf["column"], pdf["body"], strict=True):
            lines[:, :, column * wide : (column + 1) * wide] = np.frombuffer(body, dtype=complex).reshape(len(AXES), deep, wide)
        power = np.abs(np.fft.fft(lines, axis=2)) ** 2
        both = np.fft.ifft(power[0] + 1j * power[1], axis=1)  # two real answers share one way back
        both *= turns(row * deep + np.arange(deep), np.arange(columns), rows * columns, 1)
        bodies = [both[:, at : at + wide].tobytes() for at in range(0, columns, wide)]
        return labelled(pd.DataFrame({"size": size, "row": row, "column": range(len(bodies)), "body": bodies}), names, cells)

    def columns_out(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *names, column = key
        size = int(pdf["size"].iloc[0])
        rows, columns, deep, wide = layout(size, block)
        lines = np.empty((rows, wide), dtype=complex)
        for row, body in zip(pdf["row"], pdf["body"], strict=True):
            lines[row * deep : (row + 1) * deep] = np.frombuffer(body, dtype=complex).reshape(deep, wide)
        lines = np.fft.ifft(lines, axis=0)
        lag = np.arange(rows)[:, None] * columns + column * wide + np.arange(wide)[None, :]
        inside = lag < size
        return labelled(pd.DataFrame({"lag": lag[inside], "cx": lines.real[inside], "cy": lines.imag[inside]}), names, lags)

    points = centred.select(*keys, "g", *AXES, "size", _column_block(block).alias("column"))
    turned = points.groupBy(*keys, "column").applyInPandas(columns_in, cells)
    back = turned.groupBy(*keys, "row").applyInPandas(rows_through, cells)
    return back.groupBy(*keys, "column").applyInPandas(columns_out, lags)


def first_peaks(products: DataFrame, grids: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis, period_s: the first lag at least as high as both neighbours and clear enough.

    Each lag meets its neighbours by an aggregate over the three lags around it, so a long run's
    lags stay spread.
    """
    zero = products.filter("lag = 0").select(*keys, *[F.col(f"c{a}").alias(f"_z{a}") for a in AXES])
    heads = grids.join(zero, keys)
    about = products.select(*keys, *[f"c{a}" for a in AXES], F.explode(F.array(*[F.struct((F.col("lag") + d).alias("lag"), F.lit(d).alias("d")) for d in (-1, 0, 1)])).alias("_p"))
    value = lambda a, d: F.max(F.when(F.col("_p.d") == d, F.col(f"c{a}"))).alias(f"{a}{d + 1}")
    near = about.groupBy(*keys, F.col("_p.lag").alias("lag")).agg(*[value(a, d) for a in AXES for d in (-1, 0, 1)])
    tried = near.join(heads, keys).filter((F.col("lag") >= F.greatest(F.lit(2), F.floor(F.lit(SHORTEST_S) / F.col("dt")))) & (F.col("lag") < F.col("size") - 1))
    hit = lambda a: (F.col(f"_s{a}") >= FLAT) & (F.col(f"_z{a}") > 0) & (F.col(f"{a}1") > F.col(f"_z{a}") * CLEAR_SHARE) & (F.col(f"{a}1") >= F.greatest(f"{a}0", f"{a}2") - F.col(f"_z{a}") * TOLERANCE)
    firsts = tried.groupBy(*keys, "dt").agg(*[F.min(F.when(hit(a), F.col("lag"))).alias(a) for a in AXES])
    long = firsts.select(*keys, "dt", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("lag")) for a in AXES])).alias("_p"))
    return long.filter("_p.lag is not null").select(*keys, "_p.axis", (F.col("_p.lag") * F.col("dt")).alias("period_s"))


@F.pandas_udf(T.StructType([T.StructField(axis, T.DoubleType()) for axis in AXES]))
def tile_periods(x: pd.Series, y: pd.Series, dt: pd.Series) -> pd.DataFrame:
    """Period of each coordinate of whole grids, null where no lag is clear."""
    out = np.full((len(dt), len(AXES)), np.nan)
    for row, (*lines, step) in enumerate(zip(x, y, dt, strict=True)):
        line = np.stack(lines)
        line = line - line.mean(axis=1, keepdims=True)
        size = line.shape[1]
        products = np.fft.irfft(np.abs(np.fft.rfft(line, 2 * size)) ** 2, 2 * size)[:, :size]
        inner, top = products[:, 1:-1], products[:, :1]
        crest = (inner > CLEAR_SHARE * top) & (inner >= np.maximum(products[:, :-2], products[:, 2:]) - TOLERANCE * top) & (top > 0)
        crest[:, : max(2, int(SHORTEST_S / step)) - 1] = False
        out[row] = np.where(crest.any(axis=1), (crest.argmax(axis=1) + 1) * step, np.nan)
    made = pd.DataFrame(out, columns=list(AXES)).astype(object)
    return made.where(made.notna(), None)


def short_periods(even: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis, period_s of runs whose grid is one tile: its points, at most GRID_TILE, are one row."""
    swings = [f"_s{a}" for a in AXES]
    whole = even.groupBy(*keys, "dt", *swings).agg(F.sort_array(F.collect_list(F.struct("g", *AXES))).alias("_p"))
    found = whole.select(*keys, *swings, tile_periods("_p.x", "_p.y", "dt").alias("_t"))
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.when(F.col(f"_s{a}") >= FLAT, F.col(f"_t.{a}")).alias("period_s")) for a in AXES])
    return found.select(*keys, F.explode(axes).alias("_a")).select(*keys, "_a.*").filter("period_s is not null")


def correlation_periods(rows: DataFrame, keys: Keys) -> DataFrame:
    """keys, axis, period_s of the runs and coordinates whose autocorrelation has a clear peak.

    Grids of up to GRID_TILE points are one row each; the longer ones, where there are any, are
    stored and transformed in blocks. Both give the first clear peak over all lags of a run.
    """
    keys = list(keys)
    even, grids = even_grid(rows, keys)
    short = short_periods(even.filter(F.col("size") <= GRID_TILE), keys)
    grids = grids.filter(F.col("size") > GRID_TILE)
    if grids.isEmpty():
        return short
    long = stored(even.filter(F.col("size") > GRID_TILE))
    means = long.groupBy(*keys).agg(*[F.avg(a).alias(f"_m{a}") for a in AXES])
    centred = long.join(means, keys).withColumns({a: F.col(a) - F.col(f"_m{a}") for a in AXES})
    products = stored(lag_products(centred, keys))  # read for lag 0 and for all lags
    return short.unionByName(first_peaks(products, grids, keys))
