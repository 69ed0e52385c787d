"""Coordinates, distances, directions and polygons as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
# Fixed values of the GCJ-02 datum: axis, eccentricity, and the box outside of which nothing is shifted.
GCJ_AXIS, GCJ_ECCENTRICITY = 6378245.0, 0.006693421622965823
GCJ_LNG, GCJ_LAT = (73.66, 135.05), (3.86, 53.55)
#: Metres to a degree of longitude (at the equator) and latitude, by convention.
FLAT, SCALED, PAIRED = (111_000.0, 111_000.0), (111_320.0, 111_320.0), (111_320.0, 110_540.0)


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    h = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng2 - lng1)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def equirect_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column, scale=SCALED, at_lat: Column | None = None) -> Column:
    """Planar metres; longitude shrinks with the cosine of at_lat (of lat1 by default)."""
    dx = (lng2 - lng1) * F.cos(F.radians(lat1 if at_lat is None else at_lat)) * scale[0]
    dy = (lat2 - lat1) * scale[1]
    return F.sqrt(dx * dx + dy * dy)


def degrees_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Planar degrees times 111,000: the backfill for edges without a length."""
    return F.sqrt((lng2 - lng1) * (lng2 - lng1) + (lat2 - lat1) * (lat2 - lat1)) * 111_000.0


def _waves(*terms: tuple[float, Column]) -> Column:
    total = F.lit(0.0)
    for factor, turns in terms:
        total = total + factor * F.sin(turns * math.pi)
    return total * (2.0 / 3.0)


def gcj_offset(lng: Column, lat: Column) -> tuple[Column, Column]:
    """What the GCJ-02 datum adds to a WGS-84 position, in degrees."""
    x, y = lng - 105.0, lat - 35.0
    common = 0.1 * x * y
    # The published series of the datum.
    east = 300.0 + x + 2.0 * y + 0.1 * x * x + common + 0.1 * F.sqrt(F.abs(x))
    east = east + _waves((20.0, 6.0 * x), (20.0, 2.0 * x)) + _waves((20.0, x), (40.0, x / 3.0)) + _waves((150.0, x / 12.0), (300.0, x / 30.0))
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + common + 0.2 * F.sqrt(F.abs(x))
    north = north + _waves((20.0, 6.0 * x), (20.0, 2.0 * x)) + _waves((20.0, y), (40.0, y / 3.0)) + _waves((160.0, y / 12.0), (320.0, y / 30.0))
    phi = F.radians(lat)
    curve = 1 - GCJ_ECCENTRICITY * F.sin(phi) * F.sin(phi)
    root = F.sqrt(curve)
    d_lat = F.degrees(north / (GCJ_AXIS * (1 - GCJ_ECCENTRICITY) / (curve * root)))
    d_lng = F.degrees(east / (GCJ_AXIS / root * F.cos(phi)))
    return d_lng, d_lat


def in_gcj_box(lng: Column, lat: Column) -> Column:
    return lng.between(*GCJ_LNG) & lat.between(*GCJ_LAT)


def wgs84_to_gcj02(lng: Column, lat: Column) -> tuple[Column, Column]:
    d_lng, d_lat = gcj_offset(lng, lat)
    inside = in_gcj_box(lng, lat)
    return F.when(inside, lng + d_lng).otherwise(lng), F.when(inside, lat + d_lat).otherwise(lat)


def gcj02_to_wgs84(df, lng: str, lat: str, out: tuple[str, str] = ("lng_wgs", "lat_wgs"), rounds: int = 3):
    """The inverse by fixed-point rounds, each a projection of its own so that expressions stay small.

    The offset changes by less than a thousandth over its own size: three rounds reach 1e-9 degrees.
    """
    step = df.withColumns({out[0]: F.col(lng), out[1]: F.col(lat)})
    for _ in range(rounds):
        d_lng, d_lat = gcj_offset(F.col(out[0]), F.col(out[1]))
        inside = in_gcj_box(F.col(lng), F.col(lat))
        step = step.withColumns({out[0]: F.when(inside, F.col(lng) - d_lng).otherwise(F.col(lng)), out[1]: F.when(inside, F.col(lat) - d_lat).otherwise(F.col(lat))})
    return step


def bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Degrees clockwise from north in [0, 360); 0 for a segment without length."""
    dx, dy = lng2 - lng1, lat2 - lat1
    still = (F.abs(dx) < 1e-12) & (F.abs(dy) < 1e-12)
    return F.when(still, 0.0).otherwise(F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0)))


def turn_delta(into: Column, out: Column) -> Column:
    """Signed angle in [-180, 180); positive turns right."""
    return F.pmod(out - into + 540.0, F.lit(360.0)) - 180.0


def turn_class(delta: Column) -> Column:
    a, right = F.abs(delta), delta > 0
    side = lambda name: F.when(right, f"{name}right").otherwise(f"{name}left")
    return F.when(a < 10, "straight").when(a < 25, side("slight_")).when(a < 120, side("")).when(a < 170, side("sharp_")).otherwise("uturn")


def crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray to the right of (x, y) crosses the polygon side from 1 to 2."""
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule against a polygon known when the query is written."""
    count = F.lit(0)
    for (x1, y1), (x2, y2) in zip([polygon[-1], *polygon[:-1]], polygon):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            count = count + hit.cast("int")
    return count % 2 == 1


def segment_projection(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Place along a planar segment (0 to 1), and distance from it."""
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return t, F.sqrt(ex * ex + ey * ey)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of [x1, y1, x2, y2] boxes; 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda box: F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])
    shared = side(0, 2) * side(1, 3)
    return ratio_or_zero(shared, area(a) + area(b) - shared)


def interval_iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    shared = F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))
    return ratio_or_zero(shared, F.greatest(end_a, end_b) - F.least(start_a, start_b))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def homography(m: Column, x: Column, y: Column) -> Column:
    """[x', y'] under a 3 x 3 matrix; null where the point goes to infinity."""
    row = lambda k: m[k][0] * x + m[k][1] * y + m[k][2]
    return F.when(F.abs(row(2)) >= 1e-9, F.array(row(0) / row(2), row(1) / row(2)))


def tile_origins(extent: Column, tile: int, step: int) -> Column:
    """Starts of overlapping tiles that cover an extent; the last one is moved back to end with it."""
    last = F.greatest(extent - tile, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
