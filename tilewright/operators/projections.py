"""Rasters in their own reference system: geographic, spherical and ellipsoidal mercator.

A system is a pair of functions between its coordinates and longitude and latitude. What a raster covers in another
system follows from its whole outline, not its corners alone, since edges may bend; between cylindrical systems they don't.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.functions._cols import col
from tilewright.functions.geodesy import ECCENTRICITY_SQUARED, EQUATORIAL_RADIUS

STEPS = 16  # parts of an edge whose ends are looked at
DIGITS = 9  # extents in degrees are rounded to so many, far below a cell, so that going there and back gives the same


def _ellipsoid_metres(lon, lat) -> tuple[Column, Column]:
    e, phi = math.sqrt(ECCENTRICITY_SQUARED), F.radians(col(lat))
    return F.radians(col(lon)) * EQUATORIAL_RADIUS, (F.asinh(F.tan(phi)) - F.atanh(F.sin(phi) * e) * e) * EQUATORIAL_RADIUS


def _ellipsoid_lonlat(x, y) -> tuple[Column, Column]:
    """Latitude by the fixed point of the isometric latitude; each step gains more than two digits."""
    e, psi = math.sqrt(ECCENTRICITY_SQUARED), col(y) / EQUATORIAL_RADIUS
    s = F.tanh(psi)
    for _ in range(8):
        s = F.tanh(psi + F.atanh(s * e) * e)
    return F.degrees(col(x) / EQUATORIAL_RADIUS), F.degrees(F.asin(s))


#: From longitude and latitude to the system's coordinates, and back.
SYSTEMS = {
    "EPSG:4326": (lambda lon, lat: (col(lon), col(lat)), lambda x, y: (col(x), col(y))),
    "EPSG:3857": (grid.lonlat_to_metres, grid.metres_to_lonlat),
    "EPSG:3395": (_ellipsoid_metres, _ellipsoid_lonlat),
}

#: Systems whose axes depend on longitude or latitude alone and grow with it: boxes of one are boxes of the others.
CYLINDRICAL = {"EPSG:4326", "EPSG:3857", "EPSG:3395"}


def projected(x, y, source: str, target: str) -> tuple[Column, Column]:
    """A position of one system in another."""
    for s in (source, target):
        if s not in SYSTEMS:
            raise ValueError(f"unknown reference system {s!r}")
    if source == target:
        return col(x), col(y)
    return SYSTEMS[target][0](*SYSTEMS[source][1](x, y))


def outline_box(w, s, e, n, source: str, target: str, steps: int = STEPS) -> dict[str, Column]:
    """Box in ``target`` around the outline of a box in ``source``, from ``steps`` parts of each edge.

    Between cylindrical systems that is the box of two opposite corners. Inside one select, name the results differently from the columns they are made of.
    """
    w, s, e, n = col(w), col(s), col(e), col(n)
    if source == target:
        return {"w": w, "s": s, "e": e, "n": n}
    if {source, target} <= CYLINDRICAL:
        # the far corner as it is, and as steps along an outline end there
        xs, ys = zip(*[projected(x, y, source, target) for x, y in ((w, s), (e, n), (w + (e - w), s + (n - s)))])
        return {"w": F.least(*xs), "s": F.least(*ys), "e": F.greatest(*xs), "n": F.greatest(*ys)}
    parts = F.sequence(F.lit(0), F.lit(steps))

    def along(axis: int, x, y) -> Column:
        return F.transform(parts, lambda k: projected(x(k / steps), y(k / steps), source, target)[axis])

    edges = [
        (lambda k: w + (e - w) * k, lambda k: s), (lambda k: w + (e - w) * k, lambda k: n),
        (lambda k: w, lambda k: s + (n - s) * k), (lambda k: e, lambda k: s + (n - s) * k),
    ]
    xs, ys = (F.concat(*[along(axis, x, y) for x, y in edges]) for axis in (0, 1))
    return {"w": F.array_min(xs), "s": F.array_min(ys), "e": F.array_max(xs), "n": F.array_max(ys)}


def in_degrees(footprints: DataFrame) -> DataFrame:
    """Footprints with their extents (w, s, e, n, in the units of ``srs``) as longitude and latitude.

    Geographic ones stay as they are; systems other than SYSTEMS raise when their rows are read. A null srs is geographic.
    """
    srs = F.coalesce("srs", F.lit("EPSG:4326"))
    boxes = {name: outline_box("w", "s", "e", "n", name, "EPSG:4326") for name in SYSTEMS}
    unknown = F.raise_error(F.concat(F.lit("unknown reference system "), srs))

    def of(k: str) -> Column:
        out = F.when(srs == "EPSG:4326", F.col(k))
        for name, box in boxes.items():
            if name != "EPSG:4326":
                out = out.when(srs == name, F.round(box[k], DIGITS))
        return out.otherwise(unknown.cast("double"))

    return footprints.withColumns({f"_{k}": of(k) for k in "wsen"}).select(
        *[F.col(f"_{c}").alias(c) if c in ("w", "s", "e", "n") else F.lit("EPSG:4326").alias(c) if c == "srs" else F.col(c) for c in footprints.columns])


def reproject_nearest(rasters: DataFrame, cells: DataFrame, cols: int, rows: int, source: str = "EPSG:4326", target: str = "EPSG:3857") -> DataFrame:
    """Each raster of ``source`` on a lattice of ``cols`` x ``rows`` cells of ``target`` over the same extent.

    Rasters: file_id, w, n (north-west corner), px (width and height of a cell), cols, rows in the units of ``source``. Every
    target cell looks up the one source cell under its centre by the inverse transform; beyond the border the nearest counts.
    """
    r = rasters.withColumns({"_e": F.col("w") + F.col("cols") * F.col("px"), "_s": F.col("n") - F.col("rows") * F.col("px")})
    box = outline_box("w", "_s", "_e", "n", source, target)
    zero = F.lit(0).cast("bigint")
    r = r.withColumns({f"_t{k}": v for k, v in box.items()})
    t = r.withColumn("tcol", F.explode(F.sequence(zero, F.lit(cols - 1).cast("bigint")))).withColumn("trow", F.explode(F.sequence(zero, F.lit(rows - 1).cast("bigint"))))
    x = F.col("_tw") + (F.col("_te") - F.col("_tw")) / cols * (F.col("tcol") + 0.5)
    y = F.col("_tn") - (F.col("_tn") - F.col("_ts")) / rows * (F.col("trow") + 0.5)
    t = t.withColumns({"_x": x, "_y": y})
    sx, sy = projected("_x", "_y", target, source)

    def inside(v: Column, size: str) -> Column:
        return F.greatest(zero, F.least(F.floor(v), F.col(size) - 1))

    at = t.select("file_id", "tcol", "trow", inside((sx - F.col("w")) / F.col("px"), "cols").alias("col"), inside((F.col("n") - sy) / F.col("px"), "rows").alias("row"))
    return at.join(cells.hint("merge"), ["file_id", "col", "row"], "left").select("file_id", F.col("tcol").alias("col"), F.col("trow").alias("row"), "value")
