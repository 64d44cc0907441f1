"""Tiles as ranges of a space-filling order: what a raster covers in rows that follow its outline, not its area.

Tiles of a level are numbered along the Z-order curve (the bits of x and y interleaved), so that all tiles below one tile of
a coarser level have consecutive numbers. A rectangle of tiles is cut into its largest whole subtrees; these are
``first .. last``. Tiles are listed only where they are asked for, in steps of at most STEP rows from one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.functions._cols import pow2
from tilewright.session import cut_lineage

from . import ordering
from .index import union_extent

SEGMENT = 1024  # blocks of a strip that one row yields
STEP = 6  # levels that one row is listed down at once, 4 ** 6 rows
EDGE = 1e-9  # in tiles; edges this close to a tile border are tested against both sides

# fixed values: bits are moved apart, or together, in halving steps
_MASKS = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread(v: Column) -> Column:
    for shift, mask in _MASKS:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _gathered(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(_MASKS[-1][1]))
    for (shift, _), mask in zip(reversed(_MASKS), [m for _, m in reversed(_MASKS[:-1])] + [0x00000000FFFFFFFF]):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def number_of(x, y) -> Column:
    """Place of a tile on the curve; x and y below 2^31."""
    return _spread(F.col(x).cast("long")).bitwiseOR(F.shiftleft(_spread(F.col(y).cast("long")), 1))


def tile_of(number) -> dict[str, Column]:
    return {"x": _gathered(F.col(number)), "y": _gathered(F.shiftright(number, 1))}


def covers(ranges: DataFrame, deepest: int) -> DataFrame:
    """``ranges`` (z, min_x, max_x, min_y, max_y and others; z up to ``deepest``) as largest whole subtrees: ``first`` and ``last`` number.

    On every scale the whole blocks of a rectangle that lie in no whole block of the next scale form a frame of strips one
    block wide; these are found in closed form and cut into segments before they are listed. Empty ranges yield nothing.
    """
    rest = [k for k in ranges.columns if k not in ("min_x", "max_x", "min_y", "max_y")]
    r = ranges.filter("min_x <= max_x and min_y <= max_y").withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.col("z").cast("int"), F.lit(deepest)))))
    one = F.lit(1).cast("long")

    def whole(low: str, high: str, k: Column) -> tuple[Column, Column]:
        """First and last whole block of 2^k tiles."""
        size = F.call_function("shiftleft", one, k)
        return F.call_function("shiftright", F.col(low) + size - 1, k), F.call_function("shiftright", F.col(high) + 1, k) - 1

    k = F.col("_k")
    (x0, x1), (y0, y1) = whole("min_x", "max_x", k), whole("min_y", "max_y", k)
    (u0, u1), (v0, v1) = whole("min_x", "max_x", k + 1), whole("min_y", "max_y", k + 1)
    r = r.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1, "_u0": u0 * 2, "_u1": u1 * 2 + 1, "_v0": v0 * 2, "_v1": v1 * 2 + 1})
    c = F.col

    def strip(a, b, p, q):
        return F.struct(a.alias("a"), b.alias("b"), p.alias("p"), q.alias("q"))

    inner = (k < c("z")) & (c("_u0") <= c("_u1")) & (c("_v0") <= c("_v1"))
    frame = F.when(inner, F.array(
        strip(c("_x0"), c("_u0") - 1, c("_y0"), c("_y1")), strip(c("_u1") + 1, c("_x1"), c("_y0"), c("_y1")),
        strip(c("_u0"), c("_u1"), c("_y0"), c("_v0") - 1), strip(c("_u0"), c("_u1"), c("_v1") + 1, c("_y1")),
    )).otherwise(F.array(strip(c("_x0"), c("_x1"), c("_y0"), c("_y1"))))
    s = r.select(*rest, "_k", F.inline(frame)).filter("a <= b and p <= q")
    # along the longer side in segments, then block by block
    s = s.withColumn("_at", F.explode(F.expr(f"sequence(0L, greatest(b - a, q - p), {SEGMENT}L)"))).withColumn("_wide", c("b") - c("a") >= c("q") - c("p"))
    end = c("_at") + SEGMENT - 1
    s = s.select(
        *rest, "_k", F.when(c("_wide"), c("a") + c("_at")).otherwise(c("a")).alias("a"), F.when(c("_wide"), F.least("b", c("a") + end)).otherwise(c("b")).alias("b"),
        F.when(c("_wide"), c("p")).otherwise(c("p") + c("_at")).alias("p"), F.when(c("_wide"), c("q")).otherwise(F.least("q", c("p") + end)).alias("q"))
    s = s.withColumn("_bx", F.explode(F.sequence("a", "b"))).withColumn("_by", F.explode(F.sequence("p", "q")))
    first = F.call_function("shiftleft", number_of("_bx", "_by"), 2 * k)
    return s.select(*rest, first.alias("first"), (first + F.call_function("shiftleft", one, 2 * k) - 1).alias("last"))


def listed(cover: DataFrame, deepest: int) -> DataFrame:
    """The tiles of ``cover`` (z, first, last, others): z, x, y, others.

    A range longer than 4 ** STEP is cut into that many parts, which are dealt out again, until all are short enough.
    """
    rest = [k for k in cover.columns if k not in ("z", "first", "last")]
    out = cover
    for level in range((deepest + 1) // STEP, 0, -1):
        size = 4 ** (STEP * level)  # parts of so many tiles
        parts = F.explode(F.expr(f"sequence(first div {size}L, last div {size}L)"))
        out = out.withColumn("_part", parts).withColumns({"first": F.greatest(F.col("first"), F.col("_part") * size), "last": F.least(F.col("last"), F.col("_part") * size + size - 1)})
        out = out.drop("_part").repartition(F.col("z"), F.floor(F.col("first") / size))
    tiles = out.withColumn("_n", F.explode(F.sequence("first", "last")))
    return tiles.select("z", *[v.alias(k) for k, v in tile_of("_n").items()], *rest)


def source_ranges(footprints: DataFrame, zmin: int, zmax: int) -> DataFrame:
    """Rectangle of web mercator tiles that each raster meets (touching counts) on every level, inside the range of all of them."""
    ext = union_extent(footprints).select(F.struct("w", "s", "e", "n")).scalar()
    level = grid.explode_zooms(footprints.withColumn("_ext", ext), zmin, zmax)
    all_of = grid.xyz_range("z", F.col("_ext.w"), F.col("_ext.s"), F.col("_ext.e"), F.col("_ext.n"))
    n = pow2("z")

    def fx(lon):
        return (F.col(lon) + 180.0) / 360.0 * n

    def fy(lat):
        return grid._mercator_fraction(lat) * n

    r = level.withColumns({"_x0": F.floor(fx("w") - EDGE), "_x1": F.floor(fx("e") + EDGE), "_y0": F.floor(fy("n") - EDGE), "_y1": F.floor(fy("s") + EDGE)})
    low, high = grid.xyz_bounds("z", "_x0", "_y0"), grid.xyz_bounds("z", "_x1", "_y1")
    r = r.withColumns({
        "min_x": F.greatest(all_of["min_x"], F.col("_x0") + (low["east"] < F.col("w")).cast("int")), "max_x": F.least(all_of["max_x"], F.col("_x1") - (high["west"] > F.col("e")).cast("int")),
        "min_y": F.greatest(all_of["min_y"], F.col("_y0") + (low["south"] > F.col("n")).cast("int")), "max_y": F.least(all_of["max_y"], F.col("_y1") - (high["north"] < F.col("s")).cast("int")),
    })
    return r.select(*footprints.columns, "z", "min_x", "max_x", "min_y", "max_y")


def index_runs(footprints: DataFrame, zmin: int, zmax: int) -> DataFrame:
    """The tile index as runs of tiles with the same number of sources: z, first, last, source_count.

    Rows follow the outlines of the rasters. Where runs of one raster begin and end becomes one ordered list per level,
    whose running sum is the number of sources; it runs over range partitions, however large a level is.
    """
    # equal rectangles, of which the coarser levels have few, are covered once
    ranges = source_ranges(footprints.select("w", "s", "e", "n"), zmin, zmax)
    ranges = cut_lineage(ranges.groupBy("z", "min_x", "max_x", "min_y", "max_y").agg(F.count(F.lit(1)).alias("_n")))
    cover = covers(ranges, zmax).select("z", "first", "last", "_n")
    ends = cover.select("z", F.explode(F.array(F.struct(F.col("first").alias("at"), F.col("_n").alias("d")), F.struct((F.col("last") + 1).alias("at"), (-F.col("_n")).alias("d")))).alias("e"))
    steps = ends.select("z", "e.*").groupBy("z", "at").agg(F.sum("d").alias("d")).filter("d <> 0")
    run = ordering.running(steps, ["z"], ["at"], {"source_count": F.col("d")}).select("z", "at", "source_count")
    run = ordering.global_lead(cut_lineage(run), ["z", "at"], ["at", "z"])
    return run.filter("source_count > 0 and next_z = z").select("z", F.col("at").alias("first"), (F.col("next_at") - 1).alias("last"), "source_count")


def run_stats(runs: DataFrame) -> DataFrame:
    """Tiles, source references, tiles of several sources and most sources per level, from runs alone."""
    n = F.col("last") - F.col("first") + 1
    return runs.groupBy("z").agg(
        F.sum(n).alias("tiles"), F.sum(n * F.col("source_count")).alias("sources"), F.sum(F.when(F.col("source_count") > 1, n).otherwise(0)).alias("overlapped"),
        F.max("source_count").alias("most_sources"))
