"""Coordinates: affine grids, UTM zone 27N, rings and KML text, as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the transverse Mercator frame of zone 27N (fixed values).
A, INVERSE_FLATTENING, SCALE, CENTRAL_DEGREES, FALSE_EASTING = 6378137.0, 298.257223563, 0.9996, -21.0, 500000.0
_N = 1 / INVERSE_FLATTENING / (2 - 1 / INVERSE_FLATTENING)
_E = math.sqrt(1 - (1 - 1 / INVERSE_FLATTENING) ** 2)
RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the fourth order in n.
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def to_utm(lat, lon, m=F) -> tuple:
    """(easting, northing) of a point in degrees: column expressions, or arrays with ``m`` numpy."""
    phi, lam = m.radians(lat), m.radians(lon - CENTRAL_DEGREES)
    s = m.sin(phi)
    t = m.sinh(m.atanh(s) - _E * m.atanh(_E * s))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(ALPHA, 1):
        x = x + a * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
        y = y + a * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
    return FALSE_EASTING + SCALE * RADIUS * x, SCALE * RADIUS * y


def from_utm(x, y, m=F) -> tuple:
    """(lat, lon) in degrees of a point of the zone; latitude by fixed-point iteration of the conformal latitude."""
    xi0, eta0 = y / (SCALE * RADIUS), (x - FALSE_EASTING) / (SCALE * RADIUS)
    xi, eta = xi0, eta0
    for k, b in enumerate(BETA, 1):
        xi = xi - b * m.sin(2 * k * xi0) * m.cosh(2 * k * eta0)
        eta = eta - b * m.cos(2 * k * xi0) * m.sinh(2 * k * eta0)
    tau0 = m.sin(xi) / m.sqrt(m.sinh(eta) * m.sinh(eta) + m.cos(xi) * m.cos(xi))
    psi = m.asinh(tau0)

    def refine(s, _):
        return m.tanh(psi + _E * m.atanh(_E * s))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.tanh(psi), refine) if m is F else reduce(refine, range(8), m.tanh(psi))
    return m.degrees(m.asin(s)), CENTRAL_DEGREES + m.degrees(m.atan2(m.sinh(eta), m.cos(xi)))


def to_cell(x: Column, y: Column, a, c, e, f) -> tuple[Column, Column]:
    """(row, col) of a point under a north-up affine transform."""
    return F.floor((y - f) / e).cast("int"), F.floor((x - c) / a).cast("int")


def to_point(row: Column, col: Column, a, c, e, f, offset: float = 0.5) -> tuple[Column, Column]:
    """(x, y) at an offset into a cell: 0 its upper left corner, 0.5 its centre, 1 its lower right corner."""
    return c + (col + offset) * a, f + (row + offset) * e


def ring_mean(row: Column, col: Column, a, c, e, f, parity: bool = True) -> tuple[Column, Column]:
    """Mean of a pixel's five ring points, the first of which repeats: 0.9 cells in; without parity, the centre."""
    return to_point(row, col, a, c, e, f, 0.9 if parity else 0.5)


def rectangle(x: Column, y: Column, width, height) -> Column:
    """Closed ring of a rectangle around a centre, as text of x,y pairs."""
    points = [(x - width / 2, y - height / 2), (x + width / 2, y - height / 2), (x + width / 2, y + height / 2), (x - width / 2, y + height / 2), (x - width / 2, y - height / 2)]
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in points])


def coordinates(ring: Column) -> Column:
    """A ring's points as ``x,y,0`` with blanks between."""
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"), F.lit("0"))), " ")


def placemark(name: Column, ring: Column) -> Column:
    """A KML placemark with one polygon."""
    return F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), coordinates(ring), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))


def document(placemarks: Column) -> Column:
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), placemarks, F.lit("</Document></kml>"))
