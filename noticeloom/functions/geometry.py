"""Rectangles, points and directions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_area(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    wide = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    high = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0))


def overlap_share(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Common area as a share of the larger rectangle."""
    larger = F.greatest(aw * ah, bw * bh)
    return F.when(larger > 0, overlap_area(ax, ay, aw, ah, bx, by, bw, bh) / larger).otherwise(F.lit(0.0))


def rectangles_touch(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Whether closed rectangles have a point in common."""
    return ax.between(bx, bx + bw) & ay.between(by, by + bh) | bx.between(ax, ax + aw) & by.between(ay, ay + ah) | (
        (ax <= bx + bw) & (bx <= ax + aw) & (ay <= by + bh) & (by <= ay + ah))


def square_distance(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return (x - x2) * (x - x2) + (y - y2) * (y - y2)


def unit_direction(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Direction of length one that points right, or up where it is vertical; null without a length."""
    size = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    sign = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1.0).otherwise(1.0)
    return sign * dx / size, sign * dy / size


def directions_equal(ax: Column, ay: Column, bx: Column, by: Column, tolerance: float = 0.08) -> Column:
    return (F.abs(ax - bx) < tolerance) & (F.abs(ay - by) < tolerance)


def line_crossing(x1, y1, x2, y2, x3, y3, x4, y4, least: float = 1e-8) -> Column:
    """(x, y) where two lines through two points each cross; null if they are parallel."""
    d = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    a, b = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    return F.when(F.abs(d) > least, F.struct(((a * (x3 - x4) - (x1 - x2) * b) / d).alias("x"), ((a * (y3 - y4) - (y1 - y2) * b) / d).alias("y")))


def mirrored(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """The place opposite to c about the middle of a and b."""
    return ax + bx - cx, ay + by - cy


def square_crossing(x1, y1, x2, y2, x3, y3, x4, y4, tolerance: float = 0.5) -> Column:
    """line_crossing of lines with different directions; null for those that run nearly alike."""
    alike = directions_equal(*unit_direction(x2 - x1, y2 - y1), *unit_direction(x4 - x3, y4 - y3), tolerance)
    return F.when(~F.coalesce(alike, F.lit(True)), line_crossing(x1, y1, x2, y2, x3, y3, x4, y4, 0.0))


def end_crossing(x1, y1, x2, y2, x3, y3, x4, y4, outside: float = 10.0, reach: float = 20.0, far: bool = False) -> Column:
    """square_crossing where it lies within both segments' bounds, give or take outside, and at an end
    (within reach) of both; with far, where it is at an end of both or of neither."""
    p = square_crossing(x1, y1, x2, y2, x3, y3, x4, y4)
    within = lambda v, a, b: v.between(F.least(a, b) - outside, F.greatest(a, b) + outside)
    near = lambda a, b, c, d: F.floor(F.sqrt(F.least(square_distance(p["x"], p["y"], a, b), square_distance(p["x"], p["y"], c, d)))) <= reach
    one, two = near(x1, y1, x2, y2), near(x3, y3, x4, y4)
    good = within(p["x"], x1, x2) & within(p["y"], y1, y2) & within(p["x"], x3, x4) & within(p["y"], y3, y4)
    return F.when(good & ((one == two) if far else (one & two)), p)


def corners_in_order(corners: Column) -> Column:
    """An array of four corners (x, y) as top left, top right, bottom right, bottom left; null unless some lie above their centre and some do not."""
    middle = F.aggregate(corners, F.lit(0.0), lambda t, c: t + c["y"]) / F.size(corners)
    side = lambda keep: F.array_sort(F.filter(corners, keep))
    top, bottom = side(lambda c: c["y"] < middle), side(lambda c: c["y"] >= middle)
    made = F.array(F.get(top, F.lit(0)), F.element_at(top, -1), F.element_at(bottom, -1), F.get(bottom, F.lit(0)))
    return F.when((F.size(top) > 0) & (F.size(bottom) > 0), made)


def nearest_point(points: DataFrame, x: Column, y: Column, keys: tuple[str, ...], point: str = "point") -> DataFrame:
    """(keys, point): of each group the point (x, y) nearest to a place; of equally near ones the least."""
    by = F.struct(square_distance(F.col(point)["x"], F.col(point)["y"], x, y).alias("d"), F.col(point).alias("p"))
    return points.where(F.col(point).isNotNull()).groupBy(*keys).agg(F.min(by)["p"].alias(point))


def shifted(x: Column, y: Column, origin_x: Column, origin_y: Column, border: int = 15) -> tuple[Column, Column]:
    """Places in a group's own picture moved to the page's: its origin less a border."""
    return x + origin_x - border, y + origin_y - border
