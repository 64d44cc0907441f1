"""Spatial predicates as boolean Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._cols import col, pow2


def bbox_intersects_closed(a: dict, b: dict) -> Column:
    """Boxes meet; touching edges count. Keys: w, s, e, n."""
    return (
        (col(a["w"]) <= col(b["e"])) & (col(a["e"]) >= col(b["w"]))
        & (col(a["s"]) <= col(b["n"])) & (col(a["n"]) >= col(b["s"]))
    )


def bbox_overlaps_open(a: dict, b: dict) -> Column:
    """Boxes share some area; touching edges do not count."""
    return (
        (col(a["w"]) < col(b["e"])) & (col(a["e"]) > col(b["w"]))
        & (col(a["s"]) < col(b["n"])) & (col(a["n"]) > col(b["s"]))
    )


def point_in_bbox(lon, lat, box: dict) -> Column:
    return col(lon).between(col(box["w"]), col(box["e"])) & col(lat).between(col(box["s"]), col(box["n"]))


def valid_tile(z, x, y, grid: str = "xyz") -> Column:
    """The index lies inside its level (0..30)."""
    columns = pow2(col(z) + 1) if grid == "geodetic" else pow2(z)
    return (
        col(z).between(0, 30)
        & (col(x) >= 0) & (col(x) < columns)
        & (col(y) >= 0) & (col(y) < pow2(z))
    )


def in_range(z, x, y, depth, min_x, max_x, min_y, max_y) -> Column:
    return (
        (col(z) == col(depth))
        & col(x).between(col(min_x), col(max_x))
        & col(y).between(col(min_y), col(max_y))
    )


def nodata_tile(cells, nodata_cells, expected: int = 65536, threshold: float = 0.0) -> Column:
    """A tile counts as nodata when it has the wrong size or too large a share of nodata cells."""
    ratio = col(nodata_cells) / F.greatest(col(cells), F.lit(1))
    return (col(cells) != expected) | (ratio > threshold)
