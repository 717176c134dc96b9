"""Polygon and point expressions over ``array<array<double>>`` contours."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _next_points(contour: Column) -> Column:
    """The ring shifted by one, so zipping it with the ring gives the edges."""
    return F.concat(F.slice(contour, 2, F.size(contour) - 1), F.slice(contour, 1, 1))


def _edge_sum(contour: Column, term) -> Column:
    edges = F.zip_with(contour, _next_points(contour), term)
    total = F.aggregate(edges, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(contour) > 0, total)


def polygon_area(contour: Column) -> Column:
    return F.abs(_edge_sum(contour, lambda a, b: a[0] * b[1] - b[0] * a[1])) / 2


def polygon_perimeter(contour: Column) -> Column:
    return _edge_sum(contour, lambda a, b: F.hypot(b[0] - a[0], b[1] - a[1]))


def polygon_width(contour: Column) -> Column:
    xs = F.transform(contour, lambda p: p[0])
    return F.array_max(xs) - F.array_min(xs)


def polygon_height(contour: Column) -> Column:
    ys = F.transform(contour, lambda p: p[1])
    return F.array_max(ys) - F.array_min(ys)


def polygon_bounds(contour: Column) -> Column:
    xs = F.transform(contour, lambda p: p[0])
    ys = F.transform(contour, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("min_x"),
        F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"),
        F.array_max(ys).alias("max_y"),
    )


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi A / P^2; NULL for a polygon without perimeter."""
    return F.try_divide(F.lit(4 * math.pi) * area, perimeter * perimeter)


def aspect_ratio(width: Column, height: Column) -> Column:
    """Short side over long side; NULL for a point."""
    return F.try_divide(F.least(width, height), F.greatest(width, height))


def truncated(x: Column) -> Column:
    """Coordinate cut towards zero, the position every lookup and distance uses."""
    return x.cast("bigint")


def to_pixel(x: Column, down: int) -> Column:
    """Slide coordinate -> mask index: cut to an integer, scale, cut again."""
    return F.floor(truncated(x) / F.lit(down)).cast("int")


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = truncated(ax) - truncated(bx), truncated(ay) - truncated(by)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def log_ratio(a: Column, b: Column, eps: float = 0.001) -> Column:
    return F.ln((a + F.lit(eps)) / (b + F.lit(eps)))
