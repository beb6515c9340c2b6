"""Plane geometry on columns. Angles are degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def col(value: Num) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def dlit(value: float | None) -> Column:
    return F.lit(value).cast("double")


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def rotate(x: Column, y: Column, angle_deg: Column) -> tuple[Column, Column]:
    rad = F.radians(angle_deg)
    return x * F.cos(rad) - y * F.sin(rad), x * F.sin(rad) + y * F.cos(rad)


def wrap_degrees(diff: Column) -> Column:
    """Difference of two directions in [-180, 180)."""
    return F.pmod(diff + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def acute_angle(a: Column, b: Column) -> Column:
    diff = F.abs(wrap_degrees(a - b))
    return F.least(diff, F.lit(180.0) - diff)


def snap_angle(angle_deg: Column) -> Column:
    """Nearest quarter turn in [0, 360)."""
    return F.pmod(F.floor(angle_deg / 90.0 + 0.5) * F.lit(90.0), F.lit(360.0))


def pointer_angle(ox: Column, oy: Column, x: Column, y: Column, y_up: Column) -> Column:
    dy = F.when(y_up, oy - y).otherwise(y - oy)
    # with y up, a point level with the origin on its left reads -180
    level = y_up & (y == oy) & (x < ox)
    return F.when(level, F.lit(-180.0)).otherwise(F.degrees(F.atan2(dy, x - ox)))


def axis_arms(ox: Column, oy: Column, length: Num, angle_deg: Column, y_up: Column) -> Column:
    """End points of the +x and +y arms in image pixels."""
    rad = F.radians(angle_deg)
    along, across = F.cos(rad) * col(length), F.sin(rad) * col(length)
    flip = F.when(y_up, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.struct(
        (ox + along).alias("x_x"),
        (oy + flip * across).alias("x_y"),
        (ox - across).alias("y_x"),
        (oy + flip * along).alias("y_y"),
    )


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    length2 = dx * dx + dy * dy
    raw = F.when(length2 >= 1e-9, ((px - x0) * dx + (py - y0) * dy) / length2).otherwise(F.lit(0.0))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return F.hypot(px - (x0 + along * dx), py - (y0 + along * dy))


def lerp(x0: Column, x1: Column, f0: Column, f1: Column, at: Column) -> Column:
    """Value at ``at`` on the segment (f0, x0)-(f1, x1); callers keep f0 < at < f1."""
    share = (at - f0) / F.when(f1 != f0, f1 - f0).otherwise(F.lit(1))
    return x0 + (x1 - x0) * share


def corners4(quad: Column) -> list[tuple[Column, Column]]:
    return [(F.get(quad, F.lit(i))["x"], F.get(quad, F.lit(i))["y"]) for i in range(4)]


def point_in_quad(x: Column, y: Column, quad: Column) -> Column:
    """Inside or on the border: the four edge products do not disagree in sign."""
    pts = corners4(quad)
    left = right = F.lit(False)
    for (x0, y0), (x1, y1) in zip(pts, pts[1:] + pts[:1]):
        product = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
        left = left | (product > 1e-9)
        right = right | (product < -1e-9)
    return F.coalesce((F.size(quad) >= 4) & ~(left & right), F.lit(False))


def quad_measures(quad: Column) -> Column:
    """Area, smallest interior angle and convexity of a four-corner polygon."""
    pts = corners4(quad)
    ring = list(zip(pts[-1:] + pts[:-1], pts, pts[1:] + pts[:1]))
    area = F.abs(sum((x0 * y1 - y0 * x1 for (x0, y0), (x1, y1) in zip(pts, pts[1:] + pts[:1])), F.lit(0.0))) * 0.5
    angles, turns = [], []
    for (px, py), (cx, cy), (nx, ny) in ring:
        ax, ay, bx, by = px - cx, py - cy, nx - cx, ny - cy
        na, nb = F.hypot(ax, ay), F.hypot(bx, by)
        cos = F.when((na >= 1e-9) & (nb >= 1e-9), (ax * bx + ay * by) / (na * nb))
        angles.append(F.coalesce(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))), F.lit(0.0)))
        turns.append((cx - px) * (ny - cy) - (cy - py) * (nx - cx))
    convex = (F.least(*turns) >= 1e-9) | (F.greatest(*turns) <= -1e-9)
    return F.struct(area.alias("area_px"), F.least(*angles).alias("min_angle_deg"), convex.alias("convex"))


def bbox_center(box: Column) -> Column:
    return F.struct((box["x"] + box["w"] / 2).alias("x"), (box["y"] + box["h"] / 2).alias("y"))
