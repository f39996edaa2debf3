"""Geographic to transverse Mercator coordinates and back (Krueger series, WGS84)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

# WGS84 ellipsoid and UTM constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = (FLATTENING * (2 - FLATTENING)) ** 0.5

# Published series coefficients to fourth order in the third flattening.
FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def to_utm(lon, lat, central_meridian: float = 75.0) -> tuple[Column, Column]:
    """(easting, northing) in metres on the northern hemisphere."""
    phi = F.radians(as_col(lat))
    lam = F.radians(as_col(lon) - central_meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for order, a in enumerate(FORWARD, start=1):
        east = east + F.lit(a) * F.cos(F.lit(2.0 * order) * xi) * F.sinh(F.lit(2.0 * order) * eta)
        north = north + F.lit(a) * F.sin(F.lit(2.0 * order) * xi) * F.cosh(F.lit(2.0 * order) * eta)
    k = F.lit(SCALE * _RADIUS)
    return F.lit(FALSE_EASTING) + k * east, k * north


def from_utm(easting, northing, central_meridian: float = 75.0) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees."""
    k = F.lit(SCALE * _RADIUS)
    xi = as_col(northing) / k
    eta = (as_col(easting) - FALSE_EASTING) / k
    xi0, eta0 = xi, eta
    for order, b in enumerate(INVERSE, start=1):
        xi0 = xi0 - F.lit(b) * F.sin(F.lit(2.0 * order) * xi) * F.cosh(F.lit(2.0 * order) * eta)
        eta0 = eta0 - F.lit(b) * F.cos(F.lit(2.0 * order) * xi) * F.sinh(F.lit(2.0 * order) * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for order, d in enumerate(LATITUDE, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * order) * chi)
    lam = F.atan2(F.sinh(eta0), F.cos(xi0))
    return F.degrees(lam) + central_meridian, F.degrees(phi)
