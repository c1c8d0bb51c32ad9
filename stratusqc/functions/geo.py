"""Column expressions on latitude and longitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratusqc.constants import EARTH_RADIUS_KM


def cartesian(lat: Column, lon: Column, radius: float = EARTH_RADIUS_KM) -> tuple[Column, Column, Column]:
    """Point on a sphere as x, y, z kilometres."""
    la, lo = F.radians(lat), F.radians(lon)
    r = F.lit(radius)
    return r * F.cos(la) * F.cos(lo), r * F.cos(la) * F.sin(lo), r * F.sin(la)


def chord(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def tile_x(lon: Column, zoom: int) -> Column:
    """Slippy-map tile column; truncation towards zero."""
    return ((lon + 180.0) / 360.0 * F.lit(float(2**zoom))).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    """Slippy-map tile row."""
    merc = F.asinh(F.tan(F.radians(lat))) / F.lit(math.pi)
    return ((F.lit(1.0) - merc) / 2.0 * F.lit(float(2**zoom))).cast("int")
