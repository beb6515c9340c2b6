"""Small polynomials and linear systems on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIVOT = 1e-14


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def solve2(a: list[Column], b: list[Column]) -> list[Column]:
    """[[a0,a1],[a1,a2]] c = b; null when singular."""
    det = a[0] * a[2] - a[1] * a[1]
    ok = F.abs(det) > F.abs(a[0] * a[2]) * 1e-15
    return [F.when(ok, (b[0] * a[2] - b[1] * a[1]) / det), F.when(ok, (a[0] * b[1] - a[1] * b[0]) / det)]


def solve3(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """3x3 system by successive elimination of a symmetric positive matrix; null when singular."""
    l21, l31 = safe_div(a[1][0], a[0][0]), safe_div(a[2][0], a[0][0])
    m22 = a[1][1] - l21 * a[0][1]
    m23 = a[1][2] - l21 * a[0][2]
    m32 = a[2][1] - l31 * a[0][1]
    r2 = b[1] - l21 * b[0]
    l32 = F.when(F.abs(m22) > F.abs(a[1][1]) * 1e-15, m32 / m22)
    m33 = a[2][2] - l31 * a[0][2] - l32 * m23
    r3 = b[2] - l31 * b[0] - l32 * r2
    c3 = F.when(F.abs(m33) > F.abs(a[2][2]) * 1e-15, r3 / m33)
    c2 = safe_div(r2 - m23 * c3, m22)
    c1 = safe_div(b[0] - a[0][1] * c2 - a[0][2] * c3, a[0][0])
    return [c1, c2, c3]


def shift_to_t(coeffs: list[Column], t0: Column) -> list[Column]:
    """Coefficients in (t - t0) rewritten as powers of t, up to degree two."""
    if len(coeffs) == 2:
        c0, c1 = coeffs
        return [c0 - c1 * t0, c1]
    c0, c1, c2 = coeffs
    return [c0 - c1 * t0 + c2 * t0 * t0, c1 - c2 * t0 * 2.0, c2]


def evaluate(coeffs: Column, t: Column) -> Column:
    """Polynomial with ascending coefficients, by Horner's rule."""
    return F.aggregate(F.reverse(coeffs), F.lit(0.0), lambda acc, c: acc * t + c)


def _three_digits(value: Column) -> Column:
    """Three significant digits without trailing zeros, for magnitudes below ten."""
    mag = F.abs(value)
    exp = F.when(mag > 0, F.floor(F.log10(mag))).otherwise(F.lit(0))
    # rounding may carry into the next power of ten
    up = F.when(F.round(mag / F.pow(F.lit(10.0), exp), 2) >= 10, exp + 1).otherwise(exp)
    digits = F.when(up == 0, F.format_string("%.2f", value))
    for power in range(-4, 0):
        digits = F.when(up == power, F.format_string(f"%.{2 - power}f", value)).otherwise(digits)
    mantissa = F.format_string("%.2e", value)
    plain = F.when(up == 1, F.format_string("%.1f", value)).otherwise(digits)
    trimmed = F.regexp_replace(plain, r"\.?0+$", "")
    sci = F.regexp_replace(mantissa, r"\.?0+e", "e")
    return F.when(mag == 0, "0").when(up < -4, sci).otherwise(trimmed)


def format_coef(value: Column) -> Column:
    mag = F.abs(value)
    text = (
        F.when(mag >= 100, F.format_string("%.1f", value))
        .when(mag >= 10, F.format_string("%.2f", value))
        .otherwise(_three_digits(value))
    )
    return F.regexp_replace(text, r"\.0$", "")


def equation(df: DataFrame, name: str, degree: int, out: str = "equation") -> DataFrame:
    """Add a readable equation of ``coeffs`` and ``r2``; vanishing terms are left out.

    Coefficients and their texts are projected first, so neither is evaluated per use.
    """
    rows = df.withColumns({f"_c{i}": F.get("coeffs", F.lit(i)) for i in range(degree + 1)})
    rows = rows.withColumns({f"_m{i}": format_coef(F.abs(F.col(f"_c{i}"))) for i in range(degree + 1)})
    shown = [F.abs(F.col(f"_c{i}")) >= 1e-12 for i in range(degree + 1)]
    minus = [F.col(f"_c{i}") < 0 for i in range(degree + 1)]
    terms = [F.when(shown[0], F.concat(F.when(minus[0], "-").otherwise(""), F.col("_m0")))]
    for i in range(1, degree + 1):
        var = "t" if i == 1 else f"t^{i}"
        first = ~F.greatest(*shown[:i]) if i > 1 else ~shown[0]
        lead = F.when(first, F.when(minus[i], "−").otherwise("")).otherwise(F.when(minus[i], " − ").otherwise(" + "))
        bare = (F.col(f"_m{i}") == "1") & ~(first & minus[i])
        terms.append(F.when(shown[i], F.concat(lead, F.when(bare, var).otherwise(F.concat(F.col(f"_m{i}"), F.lit(f" {var}"))))))
    body = F.concat_ws("", *terms)
    rows = rows.withColumn(out, body)
    text = F.concat(F.lit(f"{name} = "), F.when(F.col(out) == "", "0").otherwise(F.col(out)), F.format_string("    R²=%.3f", F.col("r2")))
    return rows.withColumn(out, text).drop(*[f"_{p}{i}" for p in "cm" for i in range(degree + 1)])
