"""Raster operators over cells and rasters.

``rasters``: file_id, w, n, px, cols, rows (cells are counted from the north-west corner).
``cells``: file_id, col, row, value; null is nodata. ``tile_cells``: z, x, y, col, row, value.

A position finds its rasters through lattice cells, and its values through an equi-join with blocks of
cells: a block is unique on its key, so the join never multiplies rows. Joins with cells, blocks and windows are merge joins:
these come from rows that were multiplied, whose size Spark underrates, and must not pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.functions._cols import pow2
from tilewright.functions.encoding import decode_height, encode_height
from tilewright.session import cut_lineage

from . import kernels
from .index import filed, own_level

NODATA = -9999.0  # fixed value: default sentinel read and written for nodata


def read_cells(df: DataFrame, nodata: float = NODATA) -> DataFrame:
    """Cells with NaN and the sentinel as null."""
    v = F.col("value")
    return df.withColumn("value", F.when(F.isnan(v) | (v == nodata), None).otherwise(v))


def extent(rasters: DataFrame) -> DataFrame:
    return rasters.withColumns({
        "e": F.col("w") + F.col("cols") * F.col("px"), "s": F.col("n") - F.col("rows") * F.col("px"),
    })


def covering(points: DataFrame, rasters: DataFrame) -> DataFrame:
    """Every pair of a position (lon, lat) and a raster that covers it.

    A raster is filed under the (at most four) lattice cells of the level its own size asks for; a
    position looks at one cell of each level in use, of which there are at most 21. Cells are thus
    never much larger than the rasters in them, and a pair meets exactly once.
    """
    r = extent(rasters)
    level = own_level("w", "s", "e", "n")
    in_use = r.agg(F.array_sort(F.collect_set(level))).scalar()
    filed_rasters = filed(r, "", F.array(level))
    p = points.withColumn("_lv", F.explode(in_use))
    cells = F.pow(F.lit(2.0), F.col("_lv"))
    p = p.withColumns({k: F.floor((F.col(c) + 180.0) / 360.0 * cells) for k, c in (("_cx", "lon"), ("_cy", "lat"))})
    hit = F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n"))
    return p.join(filed_rasters.hint("merge"), ["_lv", "_cx", "_cy"]).filter(hit).drop("_lv", "_cx", "_cy")


def _unit(pairs: DataFrame) -> tuple[Column, Column]:
    """Position inside the raster in cells, from the north-west corner."""
    return (F.col("lon") - F.col("w")) / F.col("px"), (F.col("n") - F.col("lat")) / F.col("px")


def _inside(v: Column, size: str) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.floor(v), F.col(size) - 1))


BLOCK = 64


def cell_blocks(cells: DataFrame, keys: tuple[str, ...] = ("file_id",), block: int = BLOCK) -> DataFrame:
    """Cells as arrays: ``keys``, _bx, _by, _values with null where there is no cell.

    An array holds ``block`` x ``block`` cells row by row and one more column and row of the next blocks, so
    that the four cells around any position lie in one array.
    """
    side = block + 1

    @F.pandas_udf("array<double>")
    def dense(places: pd.Series, values: pd.Series) -> pd.Series:
        out = np.full((len(places), side * side), np.nan)
        for k, (i, v) in enumerate(zip(places, values)):
            out[k, i] = v
        return pd.Series(list(out))

    return block_lists(cells, keys, block).select(*keys, "_bx", "_by", dense("_at", "_v").alias("_values"))


GATHER = 1 << 17  # cells put together into pieces of blocks at once, before they are shuffled


def block_lists(cells: DataFrame, keys: tuple[str, ...] = ("file_id",), block: int = BLOCK) -> DataFrame:
    """Cells with a value as lists: ``keys``, _bx, _by, places in the array of a block (_at) and values (_v).

    What a task reads of a block becomes one piece before the shuffle, so that pieces travel and are sorted, not cells.
    """
    side = block + 1

    def blocks(v: str) -> Column:
        k = F.floor(F.col(v) / block)
        return F.explode(F.when((F.col(v) % block == 0) & (F.col(v) > 0), F.array(k, k - 1)).otherwise(F.array(k)))

    c = cells.filter(F.col("value").isNotNull()).select(*keys, "col", "row", F.col("value").cast("double").alias("_v"))
    c = c.withColumn("_bx", blocks("col")).withColumn("_by", blocks("row"))
    at = ((F.col("row") - F.col("_by") * block) * side + F.col("col") - F.col("_bx") * block).cast("int")
    c = c.select(*keys, "_bx", "_by", at.alias("_at"), "_v")
    spot = [*keys, "_bx", "_by"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gathered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).group_by(spot).aggregate([("_at", "list"), ("_v", "list")])
            yield from t.select([*spot, "_at_list", "_v_list"]).rename_columns([*spot, "_at", "_v"]).to_batches()

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= GATHER:
                yield from gathered(held)
                held, rows = [], 0
        if rows:
            yield from gathered(held)

    types = ", ".join(f"`{k}` {c.schema[k].dataType.simpleString()}" for k in spot)
    p = c.mapInArrow(pieces, f"{types}, _at array<int>, _v array<double>")
    return p.groupBy(*spot).agg(F.flatten(F.collect_list("_at")).alias("_at"), F.flatten(F.collect_list("_v")).alias("_v"))


def _in_block(col: Column, row: Column, block: int = BLOCK) -> Column:
    """The value at a cell of the block beside it; NaN stands for no cell."""
    v = F.get("_values", ((row - F.col("_by") * block) * (block + 1) + col - F.col("_bx") * block).cast("int"))
    return F.when(~F.isnan(v), v)


def _places(points: DataFrame) -> DataFrame:
    """The different positions of ``points``."""
    return points.filter("lon is not null and lat is not null").select("lon", "lat").distinct()


def _dealt_back(points: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of ``points`` with what was found at their positions. It meets them by position, so that no pair is shuffled."""
    return points.join(found.hint("merge"), ["lon", "lat"], how)


def sample_nearest(points: DataFrame, rasters: DataFrame, cells: DataFrame) -> DataFrame:
    """Value of the cell under each position, per covering raster (null: nodata). Equal positions are looked up once."""
    found = _nearest(_places(points), rasters, cells)
    return _dealt_back(points, found).select(*points.columns, "file_id", "px", "cell_col", "cell_row", "value")


def _nearest(places: DataFrame, rasters: DataFrame, cells: DataFrame) -> DataFrame:
    pairs = covering(places, rasters)
    cx, cy = _unit(pairs)
    at = pairs.withColumns({"_col": _inside(cx, "cols"), "_row": _inside(cy, "rows")})
    at = at.withColumns({"_bx": F.floor(F.col("_col") / BLOCK), "_by": F.floor(F.col("_row") / BLOCK)})
    got = at.join(cell_blocks(cells).hint("merge"), ["file_id", "_bx", "_by"], "left")
    value = _in_block(F.col("_col"), F.col("_row"))
    return got.select("lon", "lat", "file_id", "px", F.col("_col").alias("cell_col"), F.col("_row").alias("cell_row"), value.alias("value"))


def sample_bilinear(points: DataFrame, rasters: DataFrame, cells: DataFrame, digits: int | None = None) -> DataFrame:
    """Value between the four cells around each position, per covering raster.

    Cells are addressed by their north-west corner; indexes beyond an edge use the edge cell. With
    nodata in any corner the first corner's value is taken as it is. Positions meet whole blocks of
    cells in one join. Equal positions are looked up once and stay rows of their own. With ``digits``, values
    are rounded to so many, once per position and raster.
    """
    found = _bilinear(_places(points), rasters, cells)
    if digits is not None:
        found = found.withColumn("value", F.round("value", digits))
    return _dealt_back(points, found).select(*points.columns, "file_id", "px", "value")


def _bilinear(places: DataFrame, rasters: DataFrame, cells: DataFrame) -> DataFrame:
    pairs = covering(places, rasters)
    cx, cy = _unit(pairs)
    c0, r0 = _inside(cx, "cols"), _inside(cy, "rows")
    at = pairs.withColumns({"_c0": c0, "_r0": r0, "_fx": cx - c0, "_fy": cy - r0})
    at = at.withColumns({"_bx": F.floor(F.col("_c0") / BLOCK), "_by": F.floor(F.col("_r0") / BLOCK)})
    got = at.join(cell_blocks(cells).hint("merge"), ["file_id", "_bx", "_by"], "left")
    value = _between(F.col("cols") - 1, F.col("rows") - 1)
    return got.select("lon", "lat", "file_id", "px", value.alias("value"))


def _between(last_col: Column, last_row: Column, block: int = BLOCK) -> Column:
    """Bilinear value at (_c0 + _fx, _r0 + _fy) of the block beside it."""
    c0, r0 = F.col("_c0"), F.col("_r0")
    c1, r1 = F.least(c0 + 1, last_col), F.least(r0 + 1, last_row)
    corners = [_in_block(c, r, block) for c, r in ((c0, r0), (c1, r0), (c0, r1), (c1, r1))]
    return bilinear(*corners, F.col("_fx"), F.col("_fy"))


def bilinear(a: Column, b: Column, c: Column, d: Column, u: Column, v: Column) -> Column:
    one = F.lit(1.0)
    blend = (a * (one - u) + b * u) * (one - v) + (c * (one - u) + d * u) * v
    return F.coalesce(blend, a)


def best_value(samples: DataFrame, keys: list[str], priority: str = "resolution") -> DataFrame:
    """One value per key: that of the finest raster, or the largest; nodata never wins.

    A single ``groupBy`` with a map-side part, however many rasters lie over one place. Columns besides keys, file_id, px
    and value must not differ inside a key and are kept.
    """
    rest = [F.first(k).alias(k) for k in samples.columns if k not in (*keys, "file_id", "px", "value")]
    if priority == "max":
        return samples.groupBy(*keys).agg(*rest, F.max("value").alias("value"))
    rank = F.when(F.col("value").isNotNull(), F.struct(F.col("px") * F.col("px"), F.col("file_id")))
    return samples.groupBy(*keys).agg(
        *rest, F.min_by("value", rank).alias("value"),
        F.min_by(F.when(F.col("value").isNotNull(), F.col("file_id")), rank).alias("file_id"),
    )


def mosaic(points: DataFrame, rasters: DataFrame, cells: DataFrame, priority: str = "resolution", method: str = "bilinear") -> DataFrame:
    """One row per row of ``points`` with the value on top there, null where no raster has one.

    The value on top is found once for every different position and dealt back to the rows there; none is lost.
    """
    sample = _bilinear if method == "bilinear" else _nearest
    found = sample(_places(points), rasters, cells).select("lon", "lat", "file_id", "px", "value")
    top = best_value(found, ["lon", "lat"], priority)
    return _dealt_back(points, top, "left").select(*points.columns, "value", *(["file_id"] if priority != "max" else []))


def tile_fragments(tiles: DataFrame, rasters: DataFrame, cells: DataFrame, n: int, spacing: str, bilinear: bool) -> DataFrame:
    """What every tile takes from every block of cells it touches (see :mod:`.kernels`)."""
    pairs = kernels.tile_blocks(tiles.select("z", "x", "y").distinct(), rasters, n, spacing, BLOCK)
    return kernels.fragments(pairs.join(block_lists(cells).hint("merge"), ["file_id", "_bx", "_by"], "left"), n, spacing, BLOCK, bilinear)


def tile_raster(tiles: DataFrame, rasters: DataFrame, cells: DataFrame, n: int = 256, priority: str = "resolution",
                method: str = "bilinear", spacing: str = "half") -> DataFrame:
    """Cells of each tile sampled from all rasters below it, from the finest raster with a value (or the largest value).

    Places that no raster covers are left out; null stands where the rasters hold no data. A tile asked for twice comes once.
    """
    found = tile_fragments(tiles, rasters, cells, n, spacing, method == "bilinear")
    return kernels.layered(found, n, spacing, method == "bilinear", [F.col("px") * F.col("px"), F.col("file_id")], "covered", priority == "max")


def sample_tile_bilinear(points: DataFrame, tile_cells: DataFrame, n: int) -> DataFrame:
    """Bilinear value inside the tile raster of each position (z, x, y, lon, lat).

    ``n`` cells span the tile from edge to edge, rows from the south; outside the tile: null.
    """
    b = grid.geodetic_bounds("z", "x", "y")
    u = (F.col("lon") - b["west"]) / (b["east"] - b["west"]) * (n - 1)
    v = (F.col("lat") - b["south"]) / (b["north"] - b["south"]) * (n - 1)
    p = points.withColumns({"_u": u, "_v": v})
    inside = F.col("_u").between(0.0, float(n - 1)) & F.col("_v").between(0.0, float(n - 1))
    top = F.lit(n - 1).cast("bigint")
    p = p.withColumns({
        "_in": inside,
        "_c0": F.greatest(F.lit(0).cast("bigint"), F.least(F.floor("_u"), top)),
        "_r0": F.greatest(F.lit(0).cast("bigint"), F.least(F.floor("_v"), top)),
    }).withColumns({"_fx": F.col("_u") - F.col("_c0"), "_fy": F.col("_v") - F.col("_r0")})
    block = min(BLOCK, n)  # a block is no larger than the tile
    p = p.withColumns({"_bx": F.floor(F.col("_c0") / block), "_by": F.floor(F.col("_r0") / block)})
    tile = ("z", "x", "y")
    got = p.join(cell_blocks(tile_cells, tile, block).hint("merge"), [*tile, "_bx", "_by"], "left")
    return got.select(*points.columns, F.when(F.col("_in"), _between(top, top, block)).alias("value"))


def overview(cells: DataFrame, factors: list[int], keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Mean-resampled overviews; nodata is left out of the means.

    Each level comes from the sums and counts of the level before, never from the cells again;
    levels are written once, since a union would otherwise recompute the chain for each of them.
    """
    level = cut_lineage(cells.groupBy(*keys, F.floor(F.col("col") / factors[0]).alias("col"), F.floor(F.col("row") / factors[0]).alias("row")).agg(
        F.sum("value").alias("total"), F.count("value").alias("n")))
    out, before = None, factors[0]
    for f in factors:
        if f != before:
            step = f // before
            level = cut_lineage(level.groupBy(*keys, F.floor(F.col("col") / step).alias("col"), F.floor(F.col("row") / step).alias("row")).agg(
                F.sum("total").alias("total"), F.sum("n").alias("n")))
            before = f
        rows = level.select(*keys, F.lit(f).alias("factor"), "col", "row", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("value"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def crop(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Cells of each window (file_id, wx, wy, x_off, y_off, x_size, y_size), numbered from its corner.

    Cells and windows meet per file and block of 64 x 64 cells, not per file alone.
    """
    block = 64

    def at(v):
        return F.floor(v / block)

    w = windows.withColumn("_bx", F.explode(F.sequence(at(F.col("x_off")), at(F.col("x_off") + F.col("x_size") - 1)))).withColumn(
        "_by", F.explode(F.sequence(at(F.col("y_off")), at(F.col("y_off") + F.col("y_size") - 1))))
    c = cells.withColumns({"_bx": at(F.col("col")), "_by": at(F.col("row"))})
    x, y = F.col("col") - F.col("x_off"), F.col("row") - F.col("y_off")
    hit = (x >= 0) & (x < F.col("x_size")) & (y >= 0) & (y < F.col("y_size"))
    return c.join(w.hint("merge"), ["file_id", "_bx", "_by"]).filter(hit).select("file_id", "wx", "wy", x.alias("col"), y.alias("row"), "value")


LEAST_PIXELS = 24  # fixed value: a resized raster keeps at least this many cells per side


def depth_size(rasters: DataFrame, z) -> DataFrame:
    """Columns and rows a raster needs at a depth; unchanged when it is already coarser."""
    pixel = grid.desired_pixel_metres(z)
    metres = F.radians(F.col("px")) * grid.EARTH_RADIUS
    share = metres / pixel

    def side(k):
        shrunk = F.greatest(F.lit(LEAST_PIXELS).cast("bigint"), F.ceil(F.col(k) * share))
        return F.when(share >= 1.0, F.col(k)).otherwise(F.least(F.col(k), shrunk))

    return rasters.withColumns({"new_cols": side("cols"), "new_rows": side("rows")})


def resize_to_depth(rasters: DataFrame, cells: DataFrame, z) -> DataFrame:
    """Each raster shrunk to the pixel size a depth asks for, by the nearest cell."""
    zero = F.lit(0).cast("bigint")
    r = depth_size(rasters, z)
    t = r.withColumn("tcol", F.explode(F.sequence(zero, F.col("new_cols") - 1))).withColumn(
        "trow", F.explode(F.sequence(zero, F.col("new_rows") - 1)))
    at = t.select(
        "file_id", "tcol", "trow",
        F.floor((F.col("tcol") + 0.5) * F.col("cols") / F.col("new_cols")).alias("col"),
        F.floor((F.col("trow") + 0.5) * F.col("rows") / F.col("new_rows")).alias("row"),
    )
    return at.join(cells.hint("merge"), ["file_id", "col", "row"], "left").select("file_id", F.col("tcol").alias("col"), F.col("trow").alias("row"), "value")


AGGREGATES = {
    "average": F.avg, "max": F.max, "min": F.min, "med": F.median, "q1": lambda v: F.percentile(v, 0.25), "q3": lambda v: F.percentile(v, 0.75),
    "mode": lambda v: F.mode(v, deterministic=True),  # the least of equally frequent values
}


def warp_tile(tiles: DataFrame, rasters: DataFrame, cells: DataFrame, n: int, resampling: str = "near", nodata: float | None = 0.0) -> DataFrame:
    """Tile cells from all sources of a tile: the source with the highest id lies on top.

    ``near`` and ``bilinear`` sample each source at the cell centres; the names in AGGREGATES reduce
    the source cells whose centres fall into a target cell. ``nodata`` values are transparent.
    """
    if resampling not in ("near", "bilinear", *AGGREGATES):
        raise ValueError(f"unknown resampling {resampling!r}")
    clean = cells if nodata is None else cells.withColumn("value", F.nullif(F.col("value"), F.lit(nodata)))
    keys = ["z", "x", "y", "col", "row"]
    if resampling in AGGREGATES:
        r = extent(rasters).select("file_id", "w", "n", "px")
        c = clean.join(r.hint("shuffle_hash"), "file_id").select(
            "file_id", "value", (F.col("w") + (F.col("col") + 0.5) * F.col("px")).alias("lon"), (F.col("n") - (F.col("row") + 0.5) * F.col("px")).alias("lat"))
        z = tiles.select("z", "x", "y")
        zs = tiles.agg(F.array_sort(F.collect_set("z"))).scalar()
        c = c.withColumn("z", F.explode(zs)).withColumns({"x": grid.geodetic_x("lon", "z"), "y": grid.geodetic_y("lat", "z")})
        a = F.lit(180.0) / pow2("z")
        c = c.withColumns({
            "col": F.floor(((F.col("lon") + 180.0) / a - F.col("x")) * n), "row": F.floor(((F.col("lat") + 90.0) / a - F.col("y")) * n),
        })
        reduced = c.groupBy(*keys, "file_id").agg(AGGREGATES[resampling](F.col("value")).alias("value")).join(z, ["z", "x", "y"], "left_semi")
        return _on_top(reduced, keys)
    found = tile_fragments(tiles, rasters, clean, n, "cells", resampling == "bilinear")
    return kernels.layered(found, n, "cells", resampling == "bilinear", [F.desc("file_id")], "value")


def _on_top(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Value of the highest source that has one."""
    rank = F.when(F.col("value").isNotNull(), F.col("file_id"))
    got = samples.groupBy(*keys).agg(F.max_by("value", rank).alias("value"))
    return got.filter(F.col("value").isNotNull())


def merge_tile_parts(parts: DataFrame) -> DataFrame:
    """Parts of a tile stacked by ``ordinal``: per cell the last part that is not transparent."""
    rank = F.when(F.col("value").isNotNull(), F.col("ordinal"))
    return parts.groupBy("z", "x", "y", "col", "row").agg(F.max_by("value", rank).alias("value"))


def pyramid(base: DataFrame, zmax: int, zmin: int, n: int) -> DataFrame:
    """All levels from ``zmax`` down to ``zmin``, each from the sums and counts of the one below it.

    ``base`` has tile cells of level ``zmax`` with rows from the south; tiles are ``n`` cells wide
    (even). One shuffle per level over a quarter of the rows of the level before.
    """
    half = n // 2
    keys = ["x", "y", "col", "row"]
    level = cut_lineage(base.filter(F.col("z") == zmax).groupBy(*keys).agg(F.sum("value").alias("total"), F.count("value").alias("n")))
    out = None
    for z in range(zmax, zmin - 1, -1):
        if z < zmax:
            level = cut_lineage(level.groupBy(
                F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"),
                ((F.col("x") % 2) * half + F.floor(F.col("col") / 2)).alias("col"), ((F.col("y") % 2) * half + F.floor(F.col("row") / 2)).alias("row"),
            ).agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
        rows = level.select(F.lit(z).cast("bigint").alias("z"), *keys, "total", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def point_pyramid(points: DataFrame, zmax: int, zmin: int) -> DataFrame:
    """Count and sum per tile for every level; the base level is reduced once, the rest builds on it."""
    level = cut_lineage(points.groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    out = None
    for z in range(zmax, zmin - 1, -1):
        if z < zmax:
            level = cut_lineage(level.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
        rows = level.select(F.lit(z).cast("bigint").alias("z"), "x", "y", "n", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


def reconcile_seams(tile_cells: DataFrame, n: int) -> DataFrame:
    """Tile cells with shared border and corner cells set to the mean of all tiles sharing them.

    Only border cells are shuffled, under their position on the global lattice; at most four tiles
    share one. Inner cells pass through untouched.
    """
    edge = (F.col("col") == 0) | (F.col("col") == n - 1) | (F.col("row") == 0) | (F.col("row") == n - 1)
    inner, border = tile_cells.filter(~edge), tile_cells.filter(edge)
    spot = Window.partitionBy("z", F.col("x") * (n - 1) + F.col("col"), F.col("y") * (n - 1) + F.col("row"))
    return inner.unionByName(border.withColumn("value", F.avg("value").over(spot)))


def heightmap(tiles: DataFrame, rasters: DataFrame, cells: DataFrame, n: int = 65) -> DataFrame:
    """``n`` x ``n`` heights per tile over its bounds grown by one step to the west and north.

    Cells without data are 0 metres. Adds the stored 16-bit height.
    """
    found = tile_fragments(tiles, rasters, cells, n, "grown", True).unionByName(kernels.blank_parts(tiles.select("z", "x", "y").distinct(), n))
    full = kernels.layered(found, n, "grown", True, [F.col("px").isNull(), F.col("px") * F.col("px"), F.col("file_id")], "all")
    v = F.coalesce(F.col("value"), F.lit(0.0))
    return full.select("z", "x", "y", "col", "row", v.alias("height"), encode_height(v).alias("stored"))


def heights_to_cells(heights: DataFrame, n: int) -> DataFrame:
    """Georeferenced cells of stored tile heights."""
    b = grid.geodetic_bounds("z", "x", "y")
    step = (b["east"] - b["west"]) / (n - 1)
    return heights.select(
        "z", "x", "y", "col", "row", (b["west"] + step * F.col("col")).alias("lon"), (b["south"] + step * F.col("row")).alias("lat"),
        decode_height("stored").alias("value"),
    )


def root_tile_fill(tiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Root tiles (z 0, x 0 and 1) the set (or each set of ``by``) lacks, to be written with zero heights."""
    zero = F.lit(0).cast("bigint")
    sets = tiles.select(*by).distinct() if by else tiles.sparkSession.range(1).select()
    roots = sets.withColumn("x", F.explode(F.array(zero, F.lit(1).cast("bigint"))))
    have = tiles.filter("z = 0 and y = 0").select(*by, "x")
    return roots.join(have, [*by, "x"], "left_anti").select(*by, zero.alias("z"), "x", zero.alias("y"), F.lit(0.0).alias("height"))


def child_flags(tiles: DataFrame, bounds: DataFrame, max_zoom: int) -> DataFrame:
    """Child byte per tile: quarters that overlap the data extent, none at the deepest level."""
    ext = bounds.select(F.struct("w", "s", "e", "n")).scalar()
    b = grid.geodetic_bounds("z", "x", "y")
    t = tiles.withColumn("_x", ext).withColumns({**b})
    mx, my = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2

    def bit(w, s, e, n, value):
        hit = (w < F.col("_x.e")) & (e > F.col("_x.w")) & (s < F.col("_x.n")) & (n > F.col("_x.s"))
        return F.when(hit, value).otherwise(0)

    flags = (
        bit(F.col("west"), F.col("south"), mx, my, 1) + bit(mx, F.col("south"), F.col("east"), my, 2)
        + bit(F.col("west"), my, mx, F.col("north"), 4) + bit(mx, my, F.col("east"), F.col("north"), 8)
    )
    return t.select(*tiles.columns, F.when(F.col("z") >= max_zoom, 0).otherwise(flags).alias("child_flags"))


def child_flags_from_tiles(tiles: DataFrame) -> DataFrame:
    """Child byte of each parent, from the children that exist."""
    right, upper = F.col("x") % 2 == 1, F.col("y") % 2 == 1
    quarter = F.when(upper, F.when(right, 8).otherwise(4)).otherwise(F.when(right, 2).otherwise(1))
    up = tiles.filter("z > 0").select((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), quarter.alias("bit"))
    return up.groupBy("z", "x", "y").agg(F.bit_or("bit").alias("child_flags"))
