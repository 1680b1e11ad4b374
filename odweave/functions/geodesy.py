"""Latitude and longitude to the British national grid, as column expressions (the Ordnance Survey's published formulas).

A seven-parameter shift between the two datums is exact to about 5 m; areas are far larger.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoids (semi-axes in metres), the shift of datums (metres, seconds of arc, parts per million) and the projection.
WGS84, AIRY = (6378137.0, 6356752.3142), (6377563.396, 6356256.909)
SHIFT, TURN, SCALE = (-446.448, 125.157, -542.060), (-0.1502, -0.2470, -0.8421), 20.4894e-6
LAT0, LON0, EAST0, NORTH0, FACTOR = math.radians(49.0), math.radians(-2.0), 400000.0, -100000.0, 0.9996012717


def _eccentricity(axes: tuple[float, float]) -> float:
    return 1 - axes[1] ** 2 / axes[0] ** 2


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shift_datum(lat: Column, lon: Column) -> Column:
    """(lat, lon) in radians on the grid's datum of radians on WGS84."""
    e2 = _eccentricity(WGS84)
    rx, ry, rz = (math.radians(s / 3600) for s in TURN)
    k, e = 1 + SCALE, _eccentricity(AIRY)

    def cartesian(q: Column) -> Column:
        nu = WGS84[0] / F.sqrt(1 - e2 * q["s"] * q["s"])
        return F.struct((nu * q["c"] * F.cos(q["lon"])).alias("x"), (nu * q["c"] * F.sin(q["lon"])).alias("y"), (nu * (1 - e2) * q["s"]).alias("z"))

    def moved(q: Column) -> Column:
        u = SHIFT[0] + k * q["x"] - rz * q["y"] + ry * q["z"]
        v = SHIFT[1] + rz * q["x"] + k * q["y"] - rx * q["z"]
        w = SHIFT[2] - ry * q["x"] + rx * q["y"] + k * q["z"]
        return F.struct(F.sqrt(u * u + v * v).alias("p"), w.alias("w"), F.atan2(v, u).alias("lon"))

    def angles(q: Column) -> Column:
        out = F.atan2(q["w"], q["p"] * (1 - e))
        for _ in range(4):  # each step gains about three digits
            out = bound(F.sin(out), lambda s: F.atan2(q["w"] + e * AIRY[0] / F.sqrt(1 - e * s * s) * s, q["p"]))
        return F.struct(out.alias("lat"), q["lon"].alias("lon"))

    start = F.struct(F.sin(lat).alias("s"), F.cos(lat).alias("c"), lon.alias("lon"))
    return bound(bound(bound(start, cartesian), moved), angles)


def project(lat: Column, lon: Column) -> Column:
    """(x easting, y northing) of radians on the grid's datum: a transverse Mercator projection."""
    a, b = AIRY
    e2, n = _eccentricity(AIRY), (a - b) / (a + b)
    p = lambda x, k: F.pow(x, F.lit(float(k)))

    def radii(q: Column) -> Column:
        d, m = q["lat"] - LAT0, q["lat"] + LAT0
        arc = b * FACTOR * (
            (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(m)
            + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * m) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * m)
        )
        one = 1 - e2 * q["s"] * q["s"]
        return F.struct(*(q[f].alias(f) for f in ("s", "c", "t", "w")), arc.alias("arc"), (a * FACTOR / F.sqrt(one)).alias("nu"), (a * FACTOR * (1 - e2) / F.pow(one, 1.5)).alias("rho"))

    def place(q: Column) -> Column:
        s, c, t, w, nu = (q[f] for f in ("s", "c", "t", "w", "nu"))
        ratio, tt = nu / q["rho"], t * t
        eta = ratio - 1
        north = q["arc"] + NORTH0 + nu / 2 * s * c * p(w, 2) + nu / 24 * s * p(c, 3) * (5 - tt + 9 * eta) * p(w, 4) + nu / 720 * s * p(c, 5) * (61 - 58 * tt + tt * tt) * p(w, 6)
        east = EAST0 + nu * c * w + nu / 6 * p(c, 3) * (ratio - tt) * p(w, 3) + nu / 120 * p(c, 5) * (5 - 18 * tt + tt * tt + 14 * eta - 58 * tt * eta) * p(w, 5)
        return F.struct(east.alias("x"), north.alias("y"))

    start = F.struct(lat.alias("lat"), F.sin(lat).alias("s"), F.cos(lat).alias("c"), F.tan(lat).alias("t"), (lon - LON0).alias("w"))
    return bound(bound(start, radii), place)


def national_grid(lat: Column, lon: Column) -> Column:
    """(x easting, y northing) in metres of degrees of latitude and longitude."""
    return bound(shift_datum(F.radians(lat), F.radians(lon)), lambda q: project(q["lat"], q["lon"]))


def ring_to_grid(ring: Column) -> Column:
    """A ring of (x longitude, y latitude) on the national grid."""
    return F.transform(ring, lambda v: national_grid(v["y"], v["x"]))
