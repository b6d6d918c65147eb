"""Geometry as Spark expressions: points and polygons as rings of ``struct<x, y>``, longitude first.

Distances are great-circle distances on a sphere of mean radius.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
CELL = 1.0  # degrees


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def parse_gps(text: Column) -> Column:
    """``"lat,lon"`` as ``struct<x, y>``; null if malformed or out of range."""
    parts = F.split(text, ",")
    lat = F.trim(parts[0]).try_cast("double")
    lon = F.trim(F.get(parts, F.lit(1))).try_cast("double")
    return F.when((F.size(parts) == 2) & lat.between(-90, 90) & lon.between(-180, 180), F.struct(lon.alias("x"), lat.alias("y")))


def parse_geojson(value: Column) -> Column:
    """A variant GeoJSON Point or Polygon (outer ring, four positions or more) as ``struct<kind, ring>``."""
    kind = F.try_variant_get(value, "$.type", "string")
    at = F.try_variant_get(value, "$.coordinates", "array<double>")
    ring = F.try_variant_get(value, "$.coordinates[0]", "array<array<double>>")
    x, y = (lambda p, n=n: F.get(p, F.lit(n)) for n in (0, 1))
    xy = lambda p: F.struct(x(p).alias("x"), y(p).alias("y"))
    point_ok = (F.size(at) >= 2) & x(at).between(-180, 180) & y(at).between(-90, 90)
    return F.when((kind == "Point") & point_ok, F.struct(kind.alias("kind"), F.array(xy(at)).alias("ring"))).when(
        (kind == "Polygon") & (F.size(ring) >= 4), F.struct(kind.alias("kind"), F.transform(ring, xy).alias("ring"))
    )


def box(ring: Column) -> Column:
    """Bounds of a ring as ``struct<x1, y1, x2, y2>``."""
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def cells_of_circle(lon: Column, lat: Column, metres: Column, cell: float = CELL) -> Column:
    """Grid cells ``struct<cx, cy>`` that a circle can touch. The longitude step widens towards the poles; a
    circle that reaches one covers all longitudes, and cells wrap at 180 degrees."""
    reach = F.degrees(metres / F.lit(EARTH_M))
    top = F.least(F.lit(90.0), F.abs(lat) + reach)
    wide = F.when(top > 89.0, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(F.least(F.abs(lat), F.lit(89.9)))))))))
    wide = F.when(F.abs(lat) + reach >= 90.0, F.lit(180.0)).otherwise(wide)
    n = math.ceil(360 / cell)
    floor = lambda c: F.floor(c / cell).cast("int")
    first_x, last_x = floor(lon - wide), F.least(floor(lon + wide), floor(lon - wide) + n - 1)
    xs = F.transform(F.sequence(first_x, last_x), lambda x: F.pmod(x + n // 2, F.lit(n)) - n // 2)
    ys = F.sequence(floor(F.greatest(F.lit(-90.0), lat - reach)), floor(F.least(F.lit(90.0), lat + reach)))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.cast("int").alias("cx"), y.alias("cy")))))


def cell_of(lon: Column, lat: Column, cell: float = CELL) -> Column:
    n = math.ceil(360 / cell)
    return F.struct((F.pmod(F.floor(lon / cell).cast("int") + n // 2, F.lit(n)) - n // 2).cast("int").alias("cx"), F.floor(lat / cell).cast("int").alias("cy"))


def cells_of_box(b: Column, cell: float = CELL) -> Column:
    span = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("int"), F.floor(hi / cell).cast("int"))
    return F.flatten(F.transform(span(b["x1"], b["x2"]), lambda x: F.transform(span(b["y1"], b["y2"]), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def first_shared_cell(a: Column, b: Column, cell: float = CELL) -> Column:
    """The one cell at which two boxes that meet count as met: both cover the smallest corner of what they share."""
    at = lambda n: F.floor(F.greatest(a[n], b[n]) / cell).cast("int")
    return F.struct(at("x1").alias("cx"), at("y1").alias("cy"))


def segment_m(lon: Column, lat: Column, a: Column, b: Column) -> Column:
    """Metres from a point to the stretch from ``a`` to ``b`` (``struct<x, y>``), in the plane that touches the sphere
    at the point: exact enough for stretches of some degrees around it."""
    scale = F.cos(F.radians(lat))
    ax, ay, bx, by = (a["x"] - lon) * scale, a["y"] - lat, (b["x"] - lon) * scale, b["y"] - lat
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    along = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size))).otherwise(F.lit(0.0))
    x, y = ax + along * dx, ay + along * dy
    return F.radians(F.sqrt(x * x + y * y)) * EARTH_M


def chain_m(lon: Column, lat: Column, chain: Column) -> Column:
    """Metres from a point to a chain of two corners or more."""
    steps = F.sequence(F.lit(1), F.size(chain) - 1)
    return F.array_min(F.transform(steps, lambda i: segment_m(lon, lat, F.get(chain, i - 1), F.get(chain, i))))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is inside a closed ring, by crossings of a ray to the right."""

    def crossed(i: Column) -> Column:
        a, b = F.get(ring, i - 1), F.get(ring, i)
        return ((a["y"] > lat) != (b["y"] > lat)) & (lon < (b["x"] - a["x"]) * (lat - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(1), F.size(ring) - 1), crossed)) % 2 == 1


def wider(b: Column, lat: Column, metres: Column) -> Column:
    """Bounds that reach so many metres farther; ``lat`` is the largest absolute latitude in play."""
    up = F.degrees(metres / F.lit(EARTH_M))
    side = up / F.cos(F.radians(F.least(F.lit(89.0), lat + up)))
    return F.struct((b["x1"] - side).alias("x1"), (b["y1"] - up).alias("y1"), (b["x2"] + side).alias("x2"), (b["y2"] + up).alias("y2"))
