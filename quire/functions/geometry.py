"""Box and polygon expressions over flat coordinate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    """Shared area; zero where the boxes only touch or lie apart."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def touches(a: Box, b: Box) -> Column:
    """Closed rectangles share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def overlap_ratio(a: Box, b: Box, mode: str = "union") -> Column:
    """Shared area over that of the union, the smaller or the larger box; zero where that is zero. Coordinates are widened first."""
    a, b = (tuple(c.cast("double") for c in x) for x in (a, b))
    shared = intersection(a, b)
    below = {"union": area(a) + area(b) - shared, "small": F.least(area(a), area(b)), "large": F.greatest(area(a), area(b))}
    if mode not in below:
        raise ValueError(f"mode {mode!r}: union, small or large")
    return F.when(below[mode] > 0, shared / below[mode]).otherwise(F.lit(0.0))


def hull_area(a: Box, b: Box) -> Column:
    """Area of the convex hull of two rectangles: that of the box around both, less a triangle at each corner that neither fills alone."""
    whole = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    for i, j, turned in ((0, 1, -1), (2, 3, -1), (0, 3, 1), (2, 1, 1)):
        both = (a[i] - b[i]) * (a[j] - b[j]) * turned
        whole = whole - F.greatest(both, F.lit(0.0)) / 2
    return whole


def hull_ratio(a: Box, b: Box) -> Column:
    """Shared area over that of the convex hull of both; zero where that is zero."""
    below = hull_area(a, b)
    return F.when(below > 0, intersection(a, b) / below).otherwise(F.lit(0.0))


def corner_distance(a: Box, b: Box) -> Column:
    """Sum of the corners' L1 distances, and the lesser of the two corners' own."""
    first, last = F.abs(b[0] - a[0]) + F.abs(b[1] - a[1]), F.abs(b[2] - a[2]) + F.abs(b[3] - a[3])
    return first + last + F.least(first, last)


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def holds_centre(outer: Box, inner: Box) -> Column:
    x, y = centre(inner)
    return (x >= outer[0]) & (x <= outer[2]) & (y >= outer[1]) & (y <= outer[3])


def to_xywh(b: Box) -> Box:
    """Centre, width and height."""
    return (*centre(b), b[2] - b[0], b[3] - b[1])


def from_xywh(b: Box) -> Box:
    return b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2


def enclosing(points: Column) -> Column:
    """The least box around an array of boxes (arrays of four); zeros for none."""
    def side(i: int, f) -> Column:
        return F.coalesce(f(F.transform(points, lambda p: p[i])), F.lit(0))

    return F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))


def unclip_distance(b: Box, ratio: float) -> Column:
    around = 2 * ((b[2] - b[0]) + (b[3] - b[1]))
    return F.when(around > 0, area(b) * ratio / around).otherwise(F.lit(0.0))


def clockwise(points: Column) -> Column:
    """Four corners from the top left: least and greatest x + y, then least and greatest y - x among the others."""
    ranked = F.array_sort(points, lambda a, b: F.signum((a[0] + a[1]) - (b[0] + b[1])).cast("int"))
    middle = F.array_sort(F.slice(ranked, 2, 2), lambda a, b: F.signum((a[1] - a[0]) - (b[1] - b[0])).cast("int"))
    return F.array(ranked[0], middle[0], ranked[3], middle[1])


def clip_to(b: Box, wide: float, high: float) -> Box:
    """Inside the image, in whole pixels."""
    x = [F.floor(F.least(F.greatest(c, F.lit(0)), F.lit(wide - 1))) for c in (b[0], b[2])]
    y = [F.floor(F.least(F.greatest(c, F.lit(0)), F.lit(high - 1))) for c in (b[1], b[3])]
    return x[0], y[0], x[1], y[1]


def convex_clip(subject: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """What a convex polygon (in either direction) leaves of another, edge by edge."""
    def turn(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    sign = 1 if polygon_area(clip) >= 0 else -1
    out = subject
    for a, b in zip(clip, clip[1:] + clip[:1]):
        given, out = out, []
        for p, q in zip(given[-1:] + given[:-1], given):
            u, v = sign * turn(a, b, p), sign * turn(a, b, q)
            if (u >= 0) != (v >= 0):
                t = u / (u - v)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if v >= 0:
                out.append(q)
    return out


def polygon_area(points: list[tuple[float, float]]) -> float:
    """Signed: positive where the corners run from x to y."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2


def polygon_iou(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    shared = abs(polygon_area(convex_clip(a, b)))
    total = abs(polygon_area(a)) + abs(polygon_area(b)) - shared
    return shared / total if total > 0 else 0.0
