"""Tile grids as Column expressions.

Grids: ``xyz`` is web mercator with 2^z x 2^z tiles counted from the north; ``geodetic`` is plain
longitude/latitude with 2^(z+1) x 2^z tiles counted from the south unless ``origin='north'``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cols import col, pow2

# fixed values: sphere radius and half the width of the mercator world, in metres
EARTH_RADIUS = 6378137.0
HALF_WORLD = 20037508.342789244
# fixed values: scale denominator of level 0 and corner of the published tile matrix set
MATRIX_SCALE = 559082264.029
MATRIX_CORNER = 20037508.34
# fixed values: offsets of the eight neighbours in their order of preference
EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (1, 0), (0, 1), (0, -1)]


def _mercator_fraction(lat) -> Column:
    phi = F.radians(col(lat))
    return (F.lit(1.0) - F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / F.lit(math.pi)) / F.lit(2.0)


def xyz_x(lon, z) -> Column:
    return F.floor((col(lon) + 180.0) / 360.0 * pow2(z))


def xyz_y(lat, z) -> Column:
    return F.floor(_mercator_fraction(lat) * pow2(z))


def xyz_lon(x, z) -> Column:
    """Longitude of the west edge of column ``x``."""
    return col(x) / pow2(z) * 360.0 - 180.0


def xyz_lat(y, z) -> Column:
    """Latitude of the north edge of row ``y``."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * col(y) / pow2(z)))))


def xyz_bounds(z, x, y) -> dict[str, Column]:
    return {
        "west": xyz_lon(x, z),
        "south": xyz_lat(col(y) + 1, z),
        "east": xyz_lon(col(x) + 1, z),
        "north": xyz_lat(y, z),
    }


def mercator_metre_bounds(z, x, y) -> dict[str, Column]:
    size = F.lit(2 * HALF_WORLD) / pow2(z)
    return {
        "min_x": col(x) * size - HALF_WORLD,
        "min_y": F.lit(HALF_WORLD) - (col(y) + 1) * size,
        "max_x": (col(x) + 1) * size - HALF_WORLD,
        "max_y": F.lit(HALF_WORLD) - col(y) * size,
    }


def lonlat_to_metres(lon, lat) -> tuple[Column, Column]:
    phi = F.radians(col(lat))
    return (
        F.radians(col(lon)) * EARTH_RADIUS,
        F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi)) * EARTH_RADIUS,
    )


def metres_to_lonlat(mx, my) -> tuple[Column, Column]:
    return (
        F.degrees(col(mx) / EARTH_RADIUS),
        F.degrees(F.atan(F.sinh(col(my) / EARTH_RADIUS))),
    )


def tile_angle(z) -> Column:
    """Width of a geodetic tile in degrees."""
    return F.lit(180.0) / pow2(z)


def geodetic_x(lon, z) -> Column:
    return F.floor((col(lon) + 180.0) / tile_angle(z))


def geodetic_y(lat, z, origin: str = "south") -> Column:
    from_edge = F.lit(90.0) - col(lat) if origin == "north" else col(lat) + 90.0
    return F.floor(from_edge / tile_angle(z))


def geodetic_bounds(z, x, y, origin: str = "south") -> dict[str, Column]:
    a = tile_angle(z)
    if origin == "north":
        south, north = F.lit(90.0) - a * (col(y) + 1), F.lit(90.0) - a * col(y)
    else:
        south, north = a * col(y) - 90.0, a * (col(y) + 1) - 90.0
    return {"west": a * col(x) - 180.0, "south": south, "east": a * (col(x) + 1) - 180.0, "north": north}


def xyz_range(z, w, s, e, n) -> dict[str, Column]:
    """Tiles an extent covers, clamped to the level."""
    last = pow2(z) - 1
    zero = F.lit(0).cast("bigint")
    return {
        "min_x": F.greatest(zero, xyz_x(w, z)),
        "max_x": F.least(last, xyz_x(e, z)),
        "min_y": F.greatest(zero, xyz_y(n, z)),
        "max_y": F.least(last, xyz_y(s, z)),
    }


def metre_range(z, min_x, min_y, max_x, max_y) -> dict[str, Column]:
    """Tiles an extent in metres covers, counted from the north."""
    size = F.lit(2 * HALF_WORLD) / pow2(z)
    last = pow2(z) - 1
    zero = F.lit(0).cast("bigint")
    return {
        "min_x": F.greatest(zero, F.floor((col(min_x) + HALF_WORLD) / size)),
        "max_x": F.least(last, F.ceil((col(max_x) + HALF_WORLD) / size) - 1),
        "min_y": F.greatest(zero, F.floor((F.lit(HALF_WORLD) - col(max_y)) / size)),
        "max_y": F.least(last, F.ceil((F.lit(HALF_WORLD) - col(min_y)) / size) - 1),
    }


def geodetic_range(z, w, s, e, n) -> dict[str, Column]:
    """Corner tiles, widened where an edge rounds to a tile further out."""
    a = tile_angle(z)

    def nearest(v, edge):
        return F.floor((col(v) + edge) / a + 0.5)

    return {
        "min_x": F.least(geodetic_x(w, z), nearest(w, 180.0)),
        "max_x": F.greatest(geodetic_x(e, z), nearest(e, 180.0)),
        "min_y": F.least(geodetic_y(s, z), nearest(s, 90.0)),
        "max_y": F.greatest(geodetic_y(n, z), nearest(n, 90.0)),
    }


def explode_zooms(df: DataFrame, zmin: int, zmax: int) -> DataFrame:
    return df.withColumn("z", F.explode(F.sequence(F.lit(zmin).cast("bigint"), F.lit(zmax).cast("bigint"))))


def enumerate_tiles(df: DataFrame) -> DataFrame:
    """One row per tile of the range ``min_x..max_x``, ``min_y..max_y`` of each row.

    A range that is empty yields nothing; the two explodes stay inside one stage.
    """
    return (
        df.filter((F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y")))
        .withColumn("x", F.explode(F.sequence("min_x", "max_x")))
        .withColumn("y", F.explode(F.sequence("min_y", "max_y")))
    )


def range_size(min_x, max_x, min_y, max_y) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), col(max_x) - col(min_x) + 1) * F.greatest(
        F.lit(0).cast("bigint"), col(max_y) - col(min_y) + 1
    )


def expand_range(min_x, max_x, min_y, max_y, by: int = 1) -> dict[str, Column]:
    """Grow a range; only the lower side is clamped."""
    zero = F.lit(0).cast("bigint")
    return {
        "min_x": F.greatest(zero, col(min_x) - by),
        "max_x": col(max_x) + by,
        "min_y": F.greatest(zero, col(min_y) - by),
        "max_y": col(max_y) + by,
    }


def subdivide_range(df: DataFrame, most: int = 16) -> DataFrame:
    """Split ranges into parts of at most ``most`` x ``most`` tiles (columns ``part_*``)."""

    def parts(lo: str, hi: str) -> tuple[Column, Column]:
        size = F.col(hi) - F.col(lo) + 1
        return size, F.ceil(size / F.lit(float(most)))

    (w, nx), (h, ny) = parts("min_x", "max_x"), parts("min_y", "max_y")
    one = F.lit(1).cast("bigint")
    df = df.withColumn("part_x", F.explode(F.sequence(one * 0, nx - 1))).withColumn(
        "part_y", F.explode(F.sequence(one * 0, ny - 1))
    )

    def cut(lo: str, size: Column, n: Column, part: str) -> tuple[Column, Column]:
        step = size / n
        return (
            F.col(lo) + F.floor(F.col(part) * step),
            F.col(lo) + F.floor((F.col(part) + 1) * step) - 1,
        )

    x0, x1 = cut("min_x", w, nx, "part_x")
    y0, y1 = cut("min_y", h, ny, "part_y")
    return df.withColumns({"part_min_x": x0, "part_max_x": x1, "part_min_y": y0, "part_max_y": y1})


def parent(x, y) -> dict[str, Column]:
    return {"parent_x": F.shiftright(col(x), 1), "parent_y": F.shiftright(col(y), 1)}


def quadrant(x, y, origin: str = "south") -> Column:
    """Name of the quarter of its parent a tile fills."""
    upper = (col(y) % 2 == 1) if origin == "south" else (col(y) % 2 == 0)
    right = col(x) % 2 == 1
    return F.concat(F.when(upper, "N").otherwise("S"), F.when(right, "E").otherwise("W"))


def children(df: DataFrame) -> DataFrame:
    """Four rows per tile with ``child_z, child_x, child_y``."""
    offsets = F.array(*[F.struct(F.lit(i).cast("bigint").alias("dx"), F.lit(j).cast("bigint").alias("dy")) for j in (0, 1) for i in (0, 1)])
    return (
        df.withColumn("_o", F.explode(offsets))
        .withColumns({
            "child_z": F.col("z") + 1,
            "child_x": F.col("x") * 2 + F.col("_o.dx"),
            "child_y": F.col("y") * 2 + F.col("_o.dy"),
        })
        .drop("_o")
    )


def neighbours(df: DataFrame, offsets=EIGHT, prefix: str = "n_") -> DataFrame:
    """One row per neighbour position, with its place in the preference order."""
    items = F.array(*[
        F.struct(F.lit(k).alias("ord"), F.lit(dx).cast("bigint").alias("dx"), F.lit(dy).cast("bigint").alias("dy"))
        for k, (dx, dy) in enumerate(offsets)
    ])
    return (
        df.withColumn("_o", F.explode(items))
        .withColumns({
            f"{prefix}ord": F.col("_o.ord"),
            f"{prefix}x": F.col("x") + F.col("_o.dx"),
            f"{prefix}y": F.col("y") + F.col("_o.dy"),
        })
        .drop("_o")
    )


def flip_y(z, y) -> Column:
    return pow2(z) - col(y) - 1


# fixed values: extent, root tiles and tile size of the two pixel-grid profiles
PROFILES = {
    "geodetic": {"x0": 180.0, "y0": 90.0, "width": 360.0, "root_tiles": 2, "tile_size": 65},
    "mercator": {"x0": math.pi * EARTH_RADIUS, "y0": math.pi * EARTH_RADIUS, "width": 2 * math.pi * EARTH_RADIUS,
                 "root_tiles": 1, "tile_size": 256},
}


def root_resolution(profile: str) -> float:
    p = PROFILES[profile]
    return p["width"] / p["root_tiles"] / p["tile_size"]


def resolution(z, profile: str = "geodetic") -> Column:
    return F.lit(root_resolution(profile)) / pow2(z)


def zoom_for_resolution(res, profile: str = "geodetic") -> Column:
    """Coarsest level that is at least as fine as ``res``."""
    return F.ceil(F.round(F.log2(F.lit(root_resolution(profile)) / col(res)), 9))


def crs_to_pixel(x, y, z, profile: str = "geodetic") -> tuple[Column, Column]:
    p, r = PROFILES[profile], resolution(z, profile)
    return F.floor((col(x) + p["x0"]) / r), F.floor((col(y) + p["y0"]) / r)


def pixel_to_crs(px, py, z, profile: str = "geodetic") -> tuple[Column, Column]:
    p, r = PROFILES[profile], resolution(z, profile)
    return col(px) * r - p["x0"], col(py) * r - p["y0"]


def pixel_to_tile(px, py, profile: str = "geodetic") -> tuple[Column, Column]:
    size = PROFILES[profile]["tile_size"]
    return F.floor(col(px) / size), F.floor(col(py) / size)


def pixel_tile_bounds(z, x, y, profile: str = "geodetic") -> dict[str, Column]:
    size = PROFILES[profile]["tile_size"]
    w, s = pixel_to_crs(col(x) * size, col(y) * size, z, profile)
    e, n = pixel_to_crs((col(x) + 1) * size, (col(y) + 1) * size, z, profile)
    return {"west": w, "south": s, "east": e, "north": n}


def max_zoom_for_size(width, height, cap: int = 18) -> Column:
    return F.least(F.lit(cap).cast("bigint"), F.round(F.log2(F.greatest(col(width), col(height)) / 256.0), 9).cast("bigint") + 1)


def tile_size_metres(z) -> Column:
    return F.radians(tile_angle(z)) * EARTH_RADIUS


def desired_pixel_metres(z, tile_pixels: int = 256) -> Column:
    return tile_size_metres(z) / tile_pixels


def level_error(z, radius: float = EARTH_RADIUS, quality: float = 0.25, tile_size: int = 65, root_tiles: int = 2) -> Column:
    """Geometric error allowed at a level, halved with every level."""
    return F.lit(radius * 2 * math.pi * quality / (tile_size * root_tiles)) / pow2(z)


def _steps(z, steps: list[tuple[int, float]], beyond: float) -> Column:
    """Value of the first step whose upper level is not below ``z``."""
    out = None
    for upto, value in steps:
        out = F.when(col(z) <= upto, value) if out is None else out.when(col(z) <= upto, value)
    return out.otherwise(beyond)


# fixed values: factors on the tile size, as (last level they hold for, factor)
MAX_DEVIATION_STEPS = [(4, 0.01), (8, 0.015), (9, 0.02), (10, 0.03), (11, 0.04), (12, 0.05), (15, 0.06), (16, 0.065)]
MAX_DEVIATION_BEYOND = 0.07
MIN_SIZE_STEPS = [(10, 1.0), (14, 1.25), (15, 1.125), (17, 1.0)]
MIN_SIZE_BEYOND = 0.75


def refine_limits(z, intensity: float = 4.0) -> dict[str, Column]:
    """Triangle sizes and plane deviation (metres) that steer refinement at a level."""
    size = tile_size_metres(z)
    return {
        "max_triangle": size / 2.5 * F.when(col(z) < 11, 0.2).otherwise(1.0),
        "min_triangle": size * 0.1 / intensity * _steps(z, MIN_SIZE_STEPS, MIN_SIZE_BEYOND),
        "max_deviation": size * _steps(z, MAX_DEVIATION_STEPS, MAX_DEVIATION_BEYOND) / intensity,
    }


def wmts_matrix(z) -> dict[str, Column]:
    return {
        "identifier": col(z).cast("string"),
        "scale_denominator": F.lit(MATRIX_SCALE) / pow2(z),
        "top_left_x": F.lit(-MATRIX_CORNER),
        "top_left_y": F.lit(MATRIX_CORNER),
        "tile_pixels": F.lit(256),
        "matrix_width": pow2(z),
        "matrix_height": pow2(z),
    }
