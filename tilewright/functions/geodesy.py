"""WGS84 conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cols import col

# fixed values: the WGS84 ellipsoid
EQUATORIAL_RADIUS = 6378137.0
POLAR_RADIUS = 6356752.3142
ECCENTRICITY_SQUARED = 6.69437999014e-3


def radius_at_lat(lat) -> Column:
    """Radius of curvature in the prime vertical."""
    s = F.sin(F.radians(col(lat)))
    return F.lit(EQUATORIAL_RADIUS) / F.sqrt(F.lit(1.0) - s * s * ECCENTRICITY_SQUARED)


def ecef(lon, lat, h) -> tuple[Column, Column, Column]:
    lam, phi, v = F.radians(col(lon)), F.radians(col(lat)), radius_at_lat(lat)
    flat = (v + col(h)) * F.cos(phi)
    return flat * F.cos(lam), flat * F.sin(lam), (v * (1.0 - ECCENTRICITY_SQUARED) + col(h)) * F.sin(phi)


def geographic(df: DataFrame, x: str, y: str, z: str, out: tuple[str, str, str] = ("lon", "lat", "h")) -> DataFrame:
    """Add longitude, latitude (degrees) and height of an earth-centred position.

    Closed form after Vermeille (2004); valid everywhere outside the evolute of the meridian
    ellipse, that is for any height above about -6,300 km. The steps are columns of their own,
    so that no term is expanded twice.
    """
    keep = [*df.columns, *out]
    a2, e2 = EQUATORIAL_RADIUS**2, ECCENTRICITY_SQUARED
    e4 = e2 * e2
    c = F.col
    steps = [
        {"_rho2": c(x) * c(x) + c(y) * c(y), "_q": c(z) * c(z) * ((1.0 - e2) / a2)},
        {"_p": c("_rho2") / a2},
        {"_r": (c("_p") + c("_q") - e4) / 6.0},
        {"_s": c("_p") * c("_q") * e4 / (c("_r") * c("_r") * c("_r") * 4.0)},
        {"_t": F.cbrt(c("_s") + 1.0 + F.sqrt(c("_s") * (c("_s") + 2.0)))},
        {"_u": c("_r") * (c("_t") + 1.0 + F.lit(1.0) / c("_t"))},
        {"_v": F.sqrt(c("_u") * c("_u") + c("_q") * e4)},
        {"_w": (c("_u") + c("_v") - c("_q")) * e2 / (c("_v") * 2.0)},
        {"_k": F.sqrt(c("_u") + c("_v") + c("_w") * c("_w")) - c("_w")},
        {"_d": c("_k") * F.sqrt(c("_rho2")) / (c("_k") + e2)},
        {"_dz": F.sqrt(c("_d") * c("_d") + c(z) * c(z))},
        {
            out[0]: F.degrees(F.atan2(c(y), c(x))),
            out[1]: F.degrees(F.atan2(c(z), c("_d") + c("_dz")) * 2.0),
            out[2]: (c("_k") + e2 - 1.0) / c("_k") * c("_dz"),
        },
    ]
    for step in steps:
        df = df.withColumns(step)
    return df.select(*keep)


def ellipsoid_normal(x, y, z) -> tuple[Column, Column, Column]:
    """Unit surface normal at an earth-centred position."""
    nx, ny, nz = col(x) / EQUATORIAL_RADIUS**2, col(y) / EQUATORIAL_RADIUS**2, col(z) / POLAR_RADIUS**2
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    return nx / size, ny / size, nz / size


def to_metres(degrees) -> Column:
    """Arc length along the equator."""
    return F.radians(col(degrees)) * EQUATORIAL_RADIUS


