"""Footprint analysis: continuity, windows and pixel windows of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.functions._cols import col, pow2

from .ordering import global_lead


def continuity(footprints: DataFrame) -> DataFrame:
    """Gaps and overlaps between neighbours in the order of their centres, along x and along y.

    A difference of more than one pixel counts. Needs ``file_id, file_name, w, s, e, n, px``.
    """
    out = None
    for axis, low, high in (("x", "w", "e"), ("y", "s", "n")):
        f = footprints.select(
            "file_id", "file_name", "px", ((F.col(low) + F.col(high)) / 2).alias("center"),
            F.col(low).alias("low"), F.col(high).alias("high"),
        )
        lead = global_lead(f, ["center", "file_id"], ["file_name", "low"])
        gap = F.col("next_low") - F.col("high")
        kind = F.when(gap > F.col("px"), "gap").when(gap < -F.col("px"), "overlap")
        rows = lead.select(
            F.lit(axis).alias("axis"), kind.alias("kind"), "center", F.col("file_name").alias("file1"),
            F.col("next_file_name").alias("file2"), F.abs(gap).alias("size"), (F.abs(gap) / F.col("px")).alias("pixels"),
        ).filter(F.col("kind").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out


def continuity_report(breaks: DataFrame) -> DataFrame:
    """Numbers of gaps and overlaps; a set is continuous without gaps."""
    return breaks.agg(
        F.coalesce(F.sum((F.col("kind") == "gap").cast("bigint")), F.lit(0)).alias("gaps"),
        F.coalesce(F.sum((F.col("kind") == "overlap").cast("bigint")), F.lit(0)).alias("overlaps"),
    ).withColumn("continuous", F.col("gaps") == 0)


def first_breaks(breaks: DataFrame, kind: str, n: int = 3) -> DataFrame:
    """The first ``n`` gaps or overlaps, along x first, in the order of the centres."""
    return breaks.filter(F.col("kind") == kind).orderBy("axis", "center", "file1").limit(n)


# fixed values: margins of the three ways to cut windows
BOTH_SIDES_PX = 50
LEAST_MARGIN_PX = 4
MARGIN_SHARE = 0.01
BLOCK_OVERLAP_PX = 50


def split_windows(rasters: DataFrame, size: int, mode: str = "both", overlap: int = BOTH_SIDES_PX) -> DataFrame:
    """Windows of ``size`` pixels over each raster (``cols`` x ``rows``).

    ``both``: the overlap lies on both sides; ``far``: on the far side only; ``margin``: one per
    cent of the size, at least four pixels, inside the raster. Adds wx, wy, x_off, y_off,
    x_size, y_size.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    df = rasters.withColumn("wx", F.explode(F.sequence(zero, F.ceil(F.col("cols") / size) - one))).withColumn(
        "wy", F.explode(F.sequence(zero, F.ceil(F.col("rows") / size) - one))
    )

    def side(at: str, whole: str) -> tuple[Column, Column]:
        start, full = F.col(at) * size, F.col(whole)
        if mode == "both":
            off = F.greatest(zero, start - overlap)
            return off, F.least(F.lit(size + 2 * overlap).cast("bigint"), full - off)
        if mode == "far":
            return start, F.least(F.lit(size + overlap).cast("bigint"), full - start)
        margin = max(int(size * MARGIN_SHARE), LEAST_MARGIN_PX)
        end = F.least(start + size, full) + F.when(start + size < full, margin).otherwise(0)
        return F.when(start > margin, start - margin).otherwise(start), end - start

    (x, w), (y, h) = side("wx", "cols"), side("wy", "rows")
    return df.withColumns({"x_off": x, "y_off": y, "x_size": w, "y_size": h})


def aligned_blocks(rasters: DataFrame, n: int) -> DataFrame:
    """``n`` x ``n`` equal blocks (the last takes the rest) and the same blocks with overlap."""
    zero, last = F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")
    df = rasters.withColumn("block_x", F.explode(F.sequence(zero, last))).withColumn("block_y", F.explode(F.sequence(zero, last)))
    bw, bh = F.floor(F.col("cols") / n), F.floor(F.col("rows") / n)
    lap = F.greatest(F.lit(BLOCK_OVERLAP_PX).cast("bigint"), F.floor(F.least(bw, bh) / 10))

    def side(at: str, base: Column, whole: str) -> tuple[Column, Column, Column, Column]:
        full, start = F.col(whole), F.col(at) * base
        size = F.when(F.col(at) == n - 1, full - start).otherwise(base)
        wide_start = F.greatest(zero, start - lap)
        wide = size + F.when(start > 0, lap).otherwise(0) + F.when(start + size < full, lap).otherwise(0)
        return start, size, wide_start, F.least(full - wide_start, wide)

    x, w, ox, ow = side("block_x", bw, "cols")
    y, h, oy, oh = side("block_y", bh, "rows")
    return df.withColumns({"x": x, "y": y, "width": w, "height": h, "outer_x": ox, "outer_y": oy, "outer_width": ow, "outer_height": oh})


def tile_pixel_windows(images: DataFrame, z, growth: int = 2, tile_pixels: int = 256) -> DataFrame:
    """Source and target pixel rectangles of every tile an image touches.

    ``images`` has its extent in mercator metres (min_x, min_y, max_x, max_y) and its size in
    pixels (width, height). Both rectangles grow by ``growth`` pixels and stay inside.
    """
    df = images.withColumn("z", col(z).cast("bigint"))
    df = grid.enumerate_tiles(df.select(
        *[c for c in df.columns],
        *[c.alias("r_" + n) for n, c in grid.metre_range("z", "min_x", "min_y", "max_x", "max_y").items()],
    ).withColumnsRenamed({"min_x": "i_min_x", "min_y": "i_min_y", "max_x": "i_max_x", "max_y": "i_max_y"})
     .withColumnsRenamed({"r_min_x": "min_x", "r_max_x": "max_x", "r_min_y": "min_y", "r_max_y": "max_y"}))
    t = grid.mercator_metre_bounds("z", "x", "y")
    df = df.withColumns({"t_" + k: v for k, v in t.items()})
    df = df.withColumns({
        "o_x0": F.greatest("t_min_x", "i_min_x"), "o_x1": F.least("t_max_x", "i_max_x"),
        "o_y0": F.greatest("t_min_y", "i_min_y"), "o_y1": F.least("t_max_y", "i_max_y"),
    }).filter((F.col("o_x1") > F.col("o_x0")) & (F.col("o_y1") > F.col("o_y0")))
    grow = F.lit(float(growth)) / F.least("width", "height")
    iw, ih = F.col("i_max_x") - F.col("i_min_x"), F.col("i_max_y") - F.col("i_min_y")
    tile = F.lit(2 * grid.HALF_WORLD) / pow2("z")

    def nearest(v):
        return F.floor(v + 0.5)

    def source(lo: Column, hi: Column, px: str) -> tuple[Column, Column]:
        a, b = F.greatest(F.lit(0.0), lo - grow), F.least(F.lit(1.0), hi + grow)
        start = F.greatest(F.lit(0).cast("bigint"), F.least(nearest(a * F.col(px)), F.col(px) - 1))
        return start, F.greatest(F.lit(1).cast("bigint"), F.least(nearest((b - a) * F.col(px)), F.col(px) - start))

    def target(lo: Column, hi: Column) -> tuple[Column, Column]:
        start = F.greatest(F.lit(0).cast("bigint"), F.floor(lo * tile_pixels) - growth)
        return start, F.least(F.lit(tile_pixels).cast("bigint") - start, F.ceil(F.round((hi - lo) * tile_pixels, 6)) + 2 * growth)

    sx, sw = source((F.col("o_x0") - F.col("i_min_x")) / iw, (F.col("o_x1") - F.col("i_min_x")) / iw, "width")
    sy, sh = source((F.col("i_max_y") - F.col("o_y1")) / ih, (F.col("i_max_y") - F.col("o_y0")) / ih, "height")
    dx, dw = target((F.col("o_x0") - F.col("t_min_x")) / tile, (F.col("o_x1") - F.col("t_min_x")) / tile)
    dy, dh = target((F.col("t_max_y") - F.col("o_y1")) / tile, (F.col("t_max_y") - F.col("o_y0")) / tile)
    keep = [c for c in images.columns if c not in ("min_x", "min_y", "max_x", "max_y")]
    df = df.withColumns({"src_x": sx, "src_y": sy, "src_w": sw, "src_h": sh, "dst_x": dx, "dst_y": dy, "dst_w": dw, "dst_h": dh})
    return df.select(*keep, "z", "x", "y", "src_x", "src_y", "src_w", "src_h", "dst_x", "dst_y", "dst_w", "dst_h")
