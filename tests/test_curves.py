"""Fitted curves and the extents of charts."""

import pytest

from motionloom.operators import curves

SAMPLES = [("a", 0.0, 1.0, None), ("a", 2.0, 5.0, 3.0), ("one", 4.0, 7.0, None), ("flat", 0.0, 2.0, 2.0), ("flat", 1.0, 2.0, None), ("bare", 0.0, None, None), ("bare", 9.0, None, None), ("line", 0.0, 0.0, 0.0), ("line", 10.0, 1.0, 1.0)]
FITS = [("a", [0.0, 6.0, -3.0]), ("line", [-2.0, 1.0]), ("flat", [2.0, 0.0, 0.0])]


def test_curves_and_extents(spark):
    samples = spark.createDataFrame(SAMPLES, "clip string, time_s double, x double, y double")
    fits = spark.createDataFrame(FITS, "clip string, coeffs array<double>")
    got = {r.clip: (r.t0, r.t1, r.low, r.high) for r in curves.fit_axes(samples, fits, ["clip"], ["x", "y"]).collect()}
    assert got == {"a": (0.0, 2.0, 0.0, 5.0), "one": (4.0, 5.0, 6.0, 8.0), "flat": (0.0, 1.0, 1.0, 3.0), "bare": (0.0, 9.0, -1.0, 1.0), "line": (0.0, 10.0, -2.0, 8.0)}
    rows = curves.fit_curve(samples, fits, ["clip"]).collect()
    assert {r.clip for r in rows} == {"a", "line", "flat"} and len(rows) == 3 * 81
    middle = next(r for r in rows if r.clip == "a" and r.step == 40)
    assert (middle.time_s, middle.value) == (1.0, 3.0)


@pytest.mark.parametrize("coeffs", [[1.0, -7.3, 2.9], [0.5, 3.0, -0.21], [4.0, -1.0], [1.0, 100.0, -1.0]])
def test_extents_are_those_of_the_even_grid(spark, coeffs):
    t0, t1 = 0.3, 5.9
    grid = [sum(c * (t0 + (t1 - t0) * k / 20) ** p for p, c in enumerate(coeffs)) for k in range(21)]
    samples = spark.createDataFrame([("c", t0, grid[0]), ("c", t1, grid[0])], "clip string, time_s double, x double")
    row = curves.fit_axes(samples, spark.createDataFrame([("c", coeffs)], "clip string, coeffs array<double>"), ["clip"], ["x"]).first()
    assert (row.low, row.high) == pytest.approx((min(grid), max(grid)))
