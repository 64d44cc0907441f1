"""Right-triangulated irregular networks over square tile lattices of 2^k + 1 cells.

Each tile's lattice is one array column of fixed length. Steps that compare a vertex with others
far away in the same tile run on whole Arrow batches of tiles (:mod:`tilewright.functions.lattice`);
tiles only meet for their shared borders, of which four strips per tile are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import grid, lattice

TILE = ["z", "x", "y"]
SMOOTH_ZOOM = 6  # fixed value: up to this level a lattice of 16 steps is always kept
SMOOTH_STEPS = 16
SLICE = 256  # tiles computed at once


def tile_arrays(tile_cells: DataFrame, n: int, value: str = "value") -> DataFrame:
    """One row per tile with its n * n values (row by row from the south) in ``heights``.

    A list has the size of one tile. Cells a tile lacks are null in their place.
    """
    pair = F.struct((F.col("row") * n + F.col("col")).alias("k"), F.col(value).alias("v"))
    lists = tile_cells.groupBy(*TILE).agg(F.sort_array(F.collect_list(pair)).alias("_l"))
    whole = F.transform("_l", lambda p: p["v"])
    by_key = F.map_from_entries("_l")
    patched = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n * n - 1).cast("bigint")), lambda k: F.try_element_at(by_key, k))
    return lists.select(*TILE, F.when(F.size("_l") == n * n, whole).otherwise(patched).alias("heights"))


def _stack(series: pd.Series, n: int, dtype) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=dtype) for a in series]).reshape(len(series), n, n) if len(series) else np.empty((0, n, n), dtype)


def _sliced(step, *columns: pd.Series) -> pd.Series:
    """``step`` over SLICE tiles of a batch at a time, so that its cubes stay small."""
    out: list[np.ndarray] = []
    for at in range(0, len(columns[0]), SLICE):
        cube = step(*[c.iloc[at : at + SLICE] for c in columns])
        out.extend(cube.reshape(len(cube), -1))
    return pd.Series(out, dtype=object)


def rtin_error(arrays: DataFrame, n: int) -> DataFrame:
    """``errors``: distance of each vertex from the middle of the edge it would split."""

    @F.pandas_udf("array<double>")
    def errors(heights: pd.Series) -> pd.Series:
        return _sliced(lambda h: lattice.split_errors(_stack(h, n, float)), heights)

    return arrays.withColumn("errors", errors("heights"))


def rtin_activation(errors: DataFrame, n: int, quality: float = 1.0) -> DataFrame:
    """``levels``: activation level per vertex, -1 where the error stays below the limit.

    Corners are always active; up to level 6 so is a lattice of 16 steps.
    """
    e = errors.withColumn("_limit", grid.level_error("z", quality=0.25 * quality, tile_size=n))
    step = max((n - 1) // SMOOTH_STEPS, 1)

    def level(err, k):
        i, j = k % n, F.floor(k / n)
        over = err >= F.col("_limit")
        own = F.when(over & ~F.isnan(err), F.floor(F.log2(err / F.col("_limit")) + 0.5)).otherwise(-1)
        corner = (i % (n - 1) == 0) & (j % (n - 1) == 0)
        smooth = (F.col("z") <= SMOOTH_ZOOM) & (i % step == 0) & (j % step == 0)
        return F.greatest(own, F.when(corner | smooth, 0).otherwise(-1)).cast("int")

    return e.withColumn("levels", F.transform("errors", level)).drop("_limit")


def rtin_propagate(activation: DataFrame, n: int) -> DataFrame:
    """Raise ``levels`` so that every vertex is at least as active as those depending on it."""

    @F.pandas_udf("array<int>")
    def propagated(levels: pd.Series) -> pd.Series:
        return _sliced(lambda v: lattice.propagate_levels(_stack(v, n, np.int32)), levels)

    return activation.withColumn("levels", propagated("levels"))


def border_activation(activation: DataFrame, n: int, zmin: int = SMOOTH_ZOOM + 1) -> DataFrame:
    """Levels after the borders of neighbouring tiles have been made to agree (levels ``zmin`` and deeper).

    Levels are propagated inside each tile, border vertices take the neighbour's level where it is
    higher, and what was raised is propagated again, so that no crack is left. Only the four
    border strips travel, keyed by the neighbour they belong to.
    """
    last = n - 1
    activation = rtin_propagate(activation, n)

    def strip(start, step):
        return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.get(F.col("levels"), k * step + start))

    # my east strip is the west strip of the tile to my east, and so on
    strips = [
        (1, 0, "west", strip(last, n)), (-1, 0, "east", strip(0, n)),
        (0, 1, "south", strip(last * n, 1)), (0, -1, "north", strip(0, 1)),
    ]
    sent = F.explode(F.array(*[
        F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(side).alias("side"), levels.alias("levels"))
        for dx, dy, side, levels in strips
    ]))
    sides = ("west", "east", "south", "north")
    got = activation.filter(F.col("z") >= zmin).select("z", sent.alias("s")).select("z", "s.*").groupBy(*TILE).agg(*[
        F.max(F.when(F.col("side") == side, F.col("levels"))).alias("_" + side) for side in sides
    ])

    @F.pandas_udf("array<int>")
    def raised(levels: pd.Series, west: pd.Series, east: pd.Series, south: pd.Series, north: pd.Series) -> pd.Series:
        none = np.full(n, -1, dtype=np.int32)

        def step(own: pd.Series, *sides: pd.Series) -> np.ndarray:
            strips = [np.stack([none if s is None else np.asarray(s, dtype=np.int32) for s in side]) for side in sides]
            return lattice.raise_borders(_stack(own, n, np.int32), *strips)

        return _sliced(step, levels, west, east, south, north)

    j = activation.join(got.hint("merge"), TILE, "left")
    return rtin_propagate(j.withColumn("levels", raised("levels", *["_" + s for s in sides])).drop(*["_" + s for s in sides]), n)
