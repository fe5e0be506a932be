"""Planar and map-projection expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_to_lonlat(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees, by the third-order inverse series."""
    zone, south = epsg % 100, F.floor(epsg / 100) == 327
    xi = (north - F.when(south, 10_000_000.0).otherwise(0.0)) / (_K0 * _RADIUS)
    eta = (east - 500_000.0) / (_K0 * _RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.atan2(F.sinh(eta1), F.cos(xi1)) * (180 / math.pi) + zone * 6 - 183
    return lon, lat * (180 / math.pi)


def pixel_centre(x0: Column, y0: Column, col: Column, row: Column, size: Column) -> tuple[Column, Column]:
    return x0 + (col + 0.5) * size, y0 - (row + 0.5) * size


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Length of the common part of two intervals, 0 if there is none."""
    return F.greatest(F.lit(0.0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def grid_level(kilometres: Column, edges: list[tuple[int, float, float]]) -> Column:
    """Level whose shortest or longest edge is nearest; the first wins a tie. ``edges``: (level, low km, high km)."""
    near = [F.struct(F.abs(kilometres - F.lit(e)).alias("d"), F.lit(k).alias("k"), F.lit(level).alias("level")) for k, (level, e) in enumerate((level, e) for level, lo, hi in edges for e in (lo, hi))]
    return F.array_min(F.array(*near))["level"]
