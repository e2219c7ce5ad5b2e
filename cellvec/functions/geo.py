"""Local projection, great-circle distance and hexagons, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M_PER_LON, M_PER_LAT = 111_320.0, 110_540.0
EARTH_KM = 6371.0
KM_TO_MILES = 0.621371
MIN_RADIUS, MAX_RADIUS = 250.0, 1200.0
AREA_OF_R2 = 2.598076


def project(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return (lon - lon0) * F.lit(M_PER_LON) * F.cos(F.radians(lat0)), (lat - lat0) * F.lit(M_PER_LAT)


def unproject(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return lon0 + x / (F.lit(M_PER_LON) * F.cos(F.radians(lat0))), lat0 + y / F.lit(M_PER_LAT)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def hex_radius(land_m2: Column, target_cells: int) -> Column:
    return F.least(F.lit(MAX_RADIUS), F.greatest(F.lit(MIN_RADIUS), F.sqrt(land_m2 / (target_cells * 2.598))))


def hex_ring(cx: Column, cy: Column, r: Column) -> Column:
    """The six corners (x, y) of a pointy-top hexagon."""
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((cx + r * F.cos(F.radians(i * 60.0 - 30.0))).alias("x"), (cy + r * F.sin(F.radians(i * 60.0 - 30.0))).alias("y")))


def locate(x: Column, y: Column) -> Column:
    """struct(row, col) of the nearest of the four centres around a point, given the grid's r, w,
    minx0 and miny0 as columns; the first wins ties."""
    r, w, minx0, miny0 = (F.col(c) for c in ("r", "w", "minx0", "miny0"))
    row0 = F.floor((y - miny0) / (F.lit(1.5) * r))
    options = []
    for order, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        row = row0 + dr
        shift = F.when(F.pmod(row, F.lit(2)) == 1, w / 2).otherwise(F.lit(0.0))
        col = F.floor((x - minx0 - shift) / w) + dc
        cx, cy = minx0 + col * w + shift, miny0 + row * F.lit(1.5) * r
        d = (cx - x) * (cx - x) + (cy - y) * (cy - y)
        options.append(F.struct(d.alias("d"), F.lit(order).alias("o"), row.cast("int").alias("row"), col.cast("int").alias("col")))
    return F.least(*options)


SQRT3 = math.sqrt(3)
