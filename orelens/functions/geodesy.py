"""WGS84 and UTM by the Krüger series (published constants of the ellipsoid), as Column math; points in polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_K0 = 0.9996
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_zone(epsg: int) -> tuple[int, bool]:
    """(zone, whether north of the equator) of a WGS84 UTM code."""
    if 32601 <= epsg <= 32660:
        return epsg - 32600, True
    if 32701 <= epsg <= 32760:
        return epsg - 32700, False
    raise ValueError(f"EPSG:{epsg} is neither WGS84 nor WGS84 UTM")


def to_projected(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """(x, y) of degrees; 4326 is the identity."""
    if epsg == 4326:
        return lon, lat
    zone, north = utm_zone(epsg)
    lam, phi = F.radians(lon - (6 * zone - 183)), F.radians(lat)
    ecc = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - ecc * F.atanh(ecc * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, up = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        up = up + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + _K0 * _RECT * east, (0.0 if north else 10000000.0) + _K0 * _RECT * up


def to_degrees(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """(lon, lat) of projected coordinates."""
    if epsg == 4326:
        return x, y
    zone, north = utm_zone(epsg)
    xi, eta = (y - (0.0 if north else 10000000.0)) / (_K0 * _RECT), (x - 500000.0) / (_K0 * _RECT)
    xi0, eta0 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return (6 * zone - 183) + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(phi)


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a polygon (array of closed rings, each an array of struct<x, y>) contains a point, by the even-odd
    rule over the edges of all rings: holes need no special case."""

    def crossings(ring):
        edges = F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))).alias("p"), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))).alias("q"))

        def step(acc, e):
            p, q = e["p"], e["q"]
            spans = (p["y"] > y) != (q["y"] > y)
            at = F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"]
            return acc + F.when(spans & (x < at), 1).otherwise(0)

        return F.aggregate(edges, F.lit(0), step)

    return F.aggregate(rings, F.lit(0), lambda acc, ring: acc + crossings(ring)) % 2 == 1
