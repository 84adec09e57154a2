"""Column functions on points, rectangles, segments and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Linear map from the planar trip coordinates (metres) to degrees.
PLANAR_X0 = -780761.760862528
PLANAR_X1 = 67978.2421158527
PLANAR_X2 = -2285.59137120724
PLANAR_Y0 = -5844741.03397902
PLANAR_Y1 = 1214.24447469596
PLANAR_Y2 = 111217.945663725

# Vertical tolerance of the point-on-line test; geographic bounds
# (lat_min, lat_max, lng_min, lng_max).
LINE_TOLERANCE = 0.05
WORLD_BOUNDS = (-90.0, 90.0, -180.0, 180.0)
US_BOUNDS = (25.562265014427492, 49.26780455063753, -125.33203125, -66.445312500)


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def in_rect(x: Column, y: Column, x1, y1, x2, y2) -> Column:
    """Point in the closed rectangle spanned by any two opposite corners."""
    x1, y1, x2, y2 = _c(x1), _c(y1), _c(x2), _c(y2)
    return x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(
        F.least(y1, y2), F.greatest(y1, y2)
    )


def rect_filter(x: Column, y: Column, rect: Sequence[float]) -> Column:
    """``in_rect`` for a literal rectangle; plain comparisons reach the file scan."""
    x1, y1, x2, y2 = rect
    return x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))


def in_bounds_box(x: Column, y: Column, x_min, y_min, x_max, y_max) -> Column:
    """Point in a closed box with named bounds; an inverted box holds nothing."""
    return (x >= _c(x_min)) & (x <= _c(x_max)) & (y >= _c(y_min)) & (y <= _c(y_max))


def in_box(x: Column, y: Column, points: Column) -> Column:
    """Point in the closed box of a corner list (north-east, south-west).

    Any other number of corners holds nothing.
    """
    ne, sw = F.get(points, F.lit(0)), F.get(points, F.lit(1))
    inside = in_bounds_box(
        x, y, sw.getField("x"), sw.getField("y"), ne.getField("x"), ne.getField("y")
    )
    return F.coalesce((F.size(points) == 2) & inside, F.lit(False))


def mbr_contains(lat: Column, lng: Column, lat_min, lat_max, lng_min, lng_max) -> Column:
    return in_bounds_box(lat, lng, lat_min, lng_min, lat_max, lng_max)


def in_bounds(lat: Column, lng: Column, bounds: Sequence[float] = WORLD_BOUNDS) -> Column:
    return mbr_contains(lat, lng, *bounds)


def dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def within(d: Column, r) -> Column:
    return d < _c(r)


def slope(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Slope of a segment, null when it is vertical."""
    run = x2 - x1
    return F.when(run != 0, (y2 - y1) / F.nullif(run, F.lit(0.0)))


def has_slope(x1: Column, x2: Column) -> Column:
    return x1 != x2


def on_line(
    px: Column,
    py: Column,
    x1: Column,
    y1: Column,
    x2: Column,
    y2: Column,
    eps: float = LINE_TOLERANCE,
    bounded: bool = False,
) -> Column:
    """Point on the line through a segment.

    A sloped line is tested by vertical distance and runs past its ends unless
    ``bounded``; a vertical one needs the exact x and a y between its ends.
    """
    a = slope(x1, y1, x2, y2)
    near = F.abs(py - (a * px + (y1 - a * x1))) < eps
    if bounded:
        near = near & px.between(F.least(x1, x2), F.greatest(x1, x2))
    upright = (px == x1) & py.between(F.least(y1, y2), F.greatest(y1, y2))
    return F.when(has_slope(x1, x2), near).otherwise(upright)


def planar_to_lat(x: Column, y: Column) -> Column:
    det = PLANAR_X2 * PLANAR_Y1 - PLANAR_X1 * PLANAR_Y2
    return ((x - PLANAR_X0) * PLANAR_Y1 - (y - PLANAR_Y0) * PLANAR_X1) / F.lit(det)


def planar_to_lng(x: Column, y: Column) -> Column:
    det = PLANAR_X1 * PLANAR_Y2 - PLANAR_Y1 * PLANAR_X2
    return ((x - PLANAR_X0) * PLANAR_Y2 - (y - PLANAR_Y0) * PLANAR_X2) / F.lit(det)


def planar_to_latlng(x: Column, y: Column) -> Column:
    return F.struct(planar_to_lat(x, y).alias("lat"), planar_to_lng(x, y).alias("lng"))


def trunc_int(c: Column) -> Column:
    """Integer part, toward zero."""
    return c.cast("int")
