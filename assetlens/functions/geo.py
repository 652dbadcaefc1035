"""Coordinates: projection, centroids, boxes, bearings, map links."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: half the web-mercator world in metres, the mean Earth radius
HALF_WORLD = 20037508.34
EARTH_RADIUS = 6371000.0

RINGS = "array<array<array<array<double>>>>"


def mercator_lon(x: Column) -> Column:
    return x / HALF_WORLD * 180.0


def mercator_lat(y: Column) -> Column:
    return F.atan(F.sinh(y / HALF_WORLD * math.pi)) * 180.0 / math.pi


def is_mercator(x: Column, y: Column, crs: Column | None = None) -> Column:
    by_range = (F.abs(x) > 180) | (F.abs(y) > 90)
    return by_range if crs is None else by_range | F.coalesce(crs.contains("3857"), F.lit(False))


def to_wgs84(x: Column, y: Column, crs: Column | None = None) -> Column:
    """(lon, lat) struct; degrees pass, web-mercator metres are converted."""
    m = is_mercator(x, y, crs)
    return F.struct(
        F.when(m, mercator_lon(x)).otherwise(x).alias("lon"),
        F.when(m, mercator_lat(y)).otherwise(y).alias("lat"),
    )


def reproject(polygons: Column, crs: Column) -> Column:
    """Every vertex of polygons -> rings -> [x, y] to [lon, lat]."""

    def vertex(p: Column) -> Column:
        ll = to_wgs84(F.get(p, F.lit(0)), F.get(p, F.lit(1)), crs)
        return F.array(ll["lon"], ll["lat"])

    return F.transform(polygons, lambda poly: F.transform(poly, lambda ring: F.transform(ring, vertex)))


def ring_centroid(polygons: Column) -> Column:
    """Plain mean of the first ring's vertices, the closing one included."""
    ring = F.get(F.get(polygons, F.lit(0)), F.lit(0))

    def mean(axis: int) -> Column:
        total = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(axis)))
        return total / F.size(ring)

    return F.when(F.size(ring) > 0, F.struct(mean(0).alias("x"), mean(1).alias("y")))


def bounding_box(polygons: Column) -> Column:
    """Box over all vertices of all rings."""
    vertices = F.flatten(F.flatten(polygons))
    axis = lambda i: F.transform(vertices, lambda p: F.get(p, F.lit(i)))
    return F.when(
        F.size(vertices) > 0,
        F.struct(
            F.array_min(axis(0)).alias("min_lon"),
            F.array_min(axis(1)).alias("min_lat"),
            F.array_max(axis(0)).alias("max_lon"),
            F.array_max(axis(1)).alias("max_lat"),
        ),
    )


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, -180..180."""
    a, b = F.radians(lat1), F.radians(lat2)
    d = F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def offset_point(lat: Column, lon: Column, bearing_deg: Column, metres: Column) -> Column:
    """Point a few metres away (flat-earth step)."""
    br = F.radians(bearing_deg)
    return F.struct(
        (lat + F.degrees(metres * F.cos(br) / EARTH_RADIUS)).alias("lat"),
        (lon + F.degrees(metres * F.sin(br) / (EARTH_RADIUS * F.cos(F.radians(lat))))).alias("lon"),
    )


def map_link(base: str, key: Column, lat: Column, lon: Column) -> Column:
    """Map page for a key, centred when there is a point."""
    centre = F.when(
        lat.isNotNull() & lon.isNotNull(),
        F.concat(F.lit("&zoom=18&lat="), lat.cast("string"), F.lit("&lon="), lon.cast("string")),
    ).otherwise("")
    return F.concat(F.lit(base), centre, F.lit("&cadastralNumber="), F.url_encode(key))
