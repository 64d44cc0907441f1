"""Whole tiles sampled from blocks of raster cells.

A tile asks for a lattice of positions; a raster is held as blocks of cells. What is joined are pairs of a tile and a block
it touches, never positions: a pair's kernel gathers all its samples from the block with array arithmetic, for the
positions form a rectangle of the lattice. The rectangles of a part of a tile then lie one over the other by priority. Of a
rectangle travels what is less, its samples or the cells they come from; cells are sampled only where a place is still empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import grid

from .index import box_pairs

# fixed values: offset of the first sample of a tile, in steps to the east and north, and steps per tile short of n
SPACING = {"half": (0.5, 0.5, 1), "edge": (0.0, 0.0, 1), "grown": (-0.5, 0.5, 1), "cells": (0.5, 0.5, 0)}

PART = 128  # a tile is put together in parts of about this many samples a side
ROWS = 1 << 17  # rows returned at once

# of the tile its first position and step, of the raster its corner and size
GEOMETRY = {"_west": "double", "_south": "double", "_sx": "double", "_sy": "double", "_w": "double", "_n": "double", "cols": "long", "rows": "long"}
# where the rectangle lies in the tile, and its samples or the cells (from _c0, _r0 on, _across in a row) they come from; neither: no cell has a value
RECTANGLE = {"_tx": "int", "_ty": "int", "_col": "int", "_row": "int", "_width": "int", "_height": "int", "_c0": "int", "_r0": "int", "_across": "int", "_samples": "binary", "_cells": "binary"}
FRAGMENT = {"z": "long", "x": "long", "y": "long", **RECTANGLE, "file_id": "long", "px": "double", **GEOMETRY}


def lattice_box(tiles: DataFrame, n: int, spacing: str) -> DataFrame:
    """Tiles with the box of their positions (w, s, e, n), and the first position and step of both axes."""
    shift_x, shift_y, short = SPACING[spacing]
    b = grid.geodetic_bounds("z", "x", "y")
    t = tiles.select("z", "x", "y", *[v.alias(f"_{k}") for k, v in b.items()])
    sx, sy = (F.col("_east") - F.col("_west")) / (n - short), (F.col("_north") - F.col("_south")) / (n - short)
    t = t.withColumns({"_sx": sx, "_sy": sy})

    def at(first: str, step: str, shift: float) -> tuple[Column, Column]:
        return F.col(first) + F.col(step) * shift, F.col(first) + F.col(step) * (n - 1 + shift)

    (w, e), (s, north) = at("_west", "_sx", shift_x), at("_south", "_sy", shift_y)
    return t.select("z", "x", "y", "_west", "_south", "_sx", "_sy", w.alias("w"), s.alias("s"), e.alias("e"), north.alias("n"))


def tile_blocks(tiles: DataFrame, rasters: DataFrame, n: int, spacing: str, block: int) -> DataFrame:
    """Pairs of a tile and a block (file_id, _bx, _by) of a raster that some of its positions fall into."""
    boxes = lattice_box(tiles, n, spacing)
    r = rasters.select(
        "file_id", F.col("w").alias("w"), (F.col("n") - F.col("rows") * F.col("px")).alias("s"), (F.col("w") + F.col("cols") * F.col("px")).alias("e"), "n",
        "px", "cols", "rows")
    p = box_pairs(boxes, r)

    def blocks(low: Column, high: Column, size: str) -> Column:
        """Numbers of the blocks that hold the cells under two places (in cells)."""
        first, last = (F.floor(F.greatest(F.lit(0.0), F.least(F.floor(v), F.col(size) - 1)) / block) for v in (low, high))
        return F.explode(F.sequence(first.cast("long"), last.cast("long")))

    west, east = F.greatest("a_w", "b_w"), F.least("a_e", "b_e")
    south, north = F.greatest("a_s", "b_s"), F.least("a_n", "b_n")
    p = p.withColumn("_bx", blocks((west - F.col("b_w")) / F.col("b_px"), (east - F.col("b_w")) / F.col("b_px"), "b_cols"))
    p = p.withColumn("_by", blocks((F.col("b_n") - north) / F.col("b_px"), (F.col("b_n") - south) / F.col("b_px"), "b_rows"))
    return p.select(
        *[F.col(f"a_{k}").alias(k) for k in ("z", "x", "y", "_west", "_south", "_sx", "_sy")], F.col("b_file_id").alias("file_id"), F.col("b_px").alias("px"),
        F.col("b_w").alias("_w"), F.col("b_n").alias("_n"), F.col("b_e").alias("_e"), F.col("b_s").alias("_s"), F.col("b_cols").alias("cols"), F.col("b_rows").alias("rows"),
        "_bx", "_by",
    )


def _axis(first: float, step: float, index: np.ndarray, shift: float, low: float, px: float, size: int, down: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of an axis, the cells of a raster they lie in and their offsets in cells."""
    at = first + step * (index + shift)
    unit = (low - at) / px if down else (at - low) / px
    cell = np.clip(np.floor(unit), 0, size - 1)
    return at, cell.astype(np.int64), unit - cell


def _span(at: np.ndarray, low: float, high: float, cell: np.ndarray, block: int, number: int) -> slice | None:
    """Positions of an axis inside [low, high] whose cell lies in the numbered block."""
    hit = np.flatnonzero((at >= low) & (at <= high) & (cell // block == number))
    return slice(hit[0], hit[-1] + 1) if len(hit) else None


def _sampled(cells: np.ndarray, c0: np.ndarray, u: np.ndarray, r0: np.ndarray, v: np.ndarray, last_col: int, last_row: int, bilinear: bool) -> np.ndarray:
    """Samples from ``cells``; columns, rows and the raster's last ones are counted from their corner."""
    a = cells[np.ix_(r0, c0)]
    if not bilinear:
        return a
    c1, r1 = np.minimum(c0 + 1, last_col), np.minimum(r0 + 1, last_row)
    u, v = u[None, :], v[:, None]
    upper = a * (1.0 - u) + cells[np.ix_(r0, c1)] * u
    lower = cells[np.ix_(r1, c0)] * (1.0 - u) + cells[np.ix_(r1, c1)] * u
    blend = upper * (1.0 - v) + lower * v
    return np.where(np.isnan(blend), a, blend)


def parts_of(n: int) -> tuple[int, int]:
    """Number of parts of a lattice of n per axis, and samples per part."""
    count = max(1, n // PART)
    return count, -(-n // count)


def fragments(pairs: DataFrame, n: int, spacing: str, block: int, bilinear: bool) -> DataFrame:
    """Rectangles of every pair that carries its block's cells (places ``_at`` and values ``_v``, null: a block without any), cut into parts of the tile."""
    shift_x, shift_y, _ = SPACING[spacing]
    _, part = parts_of(n)
    side = block + 1
    steps = np.arange(n)
    names = [*GEOMETRY, "_s", "_e", "px", "_bx", "_by"]

    def rectangles(r: dict, places: pa.Scalar, values: pa.Scalar) -> Iterator[tuple]:
        lon, c0, u = _axis(r["_west"], r["_sx"], steps, shift_x, r["_w"], r["px"], r["cols"])
        lat, r0, v = _axis(r["_south"], r["_sy"], steps, shift_y, r["_n"], r["px"], r["rows"], down=True)
        across, along = _span(lon, r["_w"], r["_e"], c0, block, r["_bx"]), _span(lat, r["_s"], r["_n"], r0, block, r["_by"])
        if across is None or along is None:
            return
        cells = None
        if values.is_valid:
            cells = np.full(side * side, np.nan)
            cells[places.values.to_numpy()] = values.values.to_numpy()
            cells = cells.reshape(side, side)
        west, north = r["_bx"] * block, r["_by"] * block
        last_col, last_row = r["cols"] - 1 - west, r["rows"] - 1 - north
        for ty in range(along.start // part, (along.stop - 1) // part + 1):
            y = slice(max(along.start, ty * part), min(along.stop, ty * part + part))
            for tx in range(across.start // part, (across.stop - 1) // part + 1):
                x = slice(max(across.start, tx * part), min(across.stop, tx * part + part))
                place = (tx, ty, x.start, y.start, x.stop - x.start, y.stop - y.start)
                if cells is None:
                    yield *place, None, None, None, None, None
                    continue
                col, row = c0[x] - west, r0[y] - north
                # columns run east, rows of positions north and rows of cells south
                left, top = col[0], row[-1]
                own = cells[top : min(row[0] + bilinear, last_row) + 1, left : min(col[-1] + bilinear, last_col) + 1]
                if own.size < (x.stop - x.start) * (y.stop - y.start):
                    yield *place, int(left + west), int(top + north), own.shape[1], None, own.tobytes()
                else:
                    yield *place, None, None, None, _sampled(cells, col, u[x], row, v[y], last_col, last_row, bilinear).tobytes(), None

    types = [pa.int32()] * 9 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {k: b.column(k).to_pylist() for k in names}
            places, values = b.column("_at"), b.column("_v")
            take, out, size = [], [], 0

            def ready() -> pa.RecordBatch:
                at = pa.array(take, pa.int64())
                kept = {k: b.column(k).take(at) for k in ("z", "x", "y", "file_id", "px", *GEOMETRY)}
                kept |= {k: pa.array(c, t) for k, c, t in zip(RECTANGLE, zip(*out), types, strict=True)}
                return pa.RecordBatch.from_arrays([kept[k] for k in FRAGMENT], names=list(FRAGMENT))

            for k in range(b.num_rows):
                for found in rectangles({name: columns[name][k] for name in names}, places[k], values[k]):
                    take.append(k)
                    out.append(found)
                    size += sum(len(f) for f in found[-2:] if f is not None) // 8
                if size >= ROWS:
                    yield ready()
                    take, out, size = [], [], 0
            if out:
                yield ready()

    return pairs.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in FRAGMENT.items()))


def layered(found: DataFrame, n: int, spacing: str, bilinear: bool, rank: list[Column], keep: str, largest: bool = False) -> DataFrame:
    """Rows z, x, y, col, row, value of fragments laid one over the other.

    A part's fragments arrive in the order of ``rank`` and each fills the places that are still empty (with ``largest``,
    the greatest value stays), so that a part in work is all that a task holds, however many rasters lie there; a fragment whose
    places are all taken isn't sampled. ``keep`` tells which places are rows: those with a ``value``, those that any raster ``covered``, or ``all``.
    """
    shift_x, shift_y, _ = SPACING[spacing]
    _, part = parts_of(n)
    key = ["z", "x", "y", "_tx", "_ty"]
    names = [k for k in (*RECTANGLE, "px", *GEOMETRY) if k not in (*key, "_samples", "_cells")]
    dealt = found.repartition(*key).sortWithinPartitions(*key, *rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, seen = None, None, None
        done: list[tuple] = []

        def finish() -> None:
            wanted = ~np.isnan(best) if keep == "value" else seen if keep == "covered" else np.ones_like(seen)
            rows, cols = np.nonzero(wanted)
            if len(rows):
                z, x, y, tx, ty = at
                done.append((np.full(len(rows), z), np.full(len(rows), x), np.full(len(rows), y), cols + tx * part, rows + ty * part, best[rows, cols]))

        def ready() -> pa.RecordBatch:
            z, x, y, col, row, value = (np.concatenate(c) for c in zip(*done, strict=True))
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in (z, x, y, col, row)], pa.array(value, pa.float64(), mask=np.isnan(value))], names=["z", "x", "y", "col", "row", "value"])

        def sampled(r: dict, cells: np.ndarray) -> np.ndarray:
            _, c0, u = _axis(r["_west"], r["_sx"], np.arange(r["_col"], r["_col"] + r["_width"]), shift_x, r["_w"], r["px"], r["cols"])
            _, r0, v = _axis(r["_south"], r["_sy"], np.arange(r["_row"], r["_row"] + r["_height"]), shift_y, r["_n"], r["px"], r["rows"], down=True)
            return _sampled(cells.reshape(-1, r["_across"]), c0 - r["_c0"], u, r0 - r["_r0"], v, r["cols"] - 1 - r["_c0"], r["rows"] - 1 - r["_r0"], bilinear)

        for b in batches:
            keys = list(zip(*[b.column(k).to_pylist() for k in key], strict=True))
            columns = {k: b.column(k).to_pylist() for k in names}
            samples, cells = b.column("_samples"), b.column("_cells")
            for k in range(b.num_rows):
                if keys[k] != at:
                    if at is not None:
                        finish()
                        if sum(len(d[0]) for d in done) >= ROWS:
                            yield ready()
                            done = []
                    at = keys[k]
                    height, width = (min(part, n - i * part) for i in (at[4], at[3]))
                    best, seen = np.full((height, width), np.nan), np.zeros((height, width), dtype=bool)
                if columns["_width"][k] is None:
                    continue
                r = {name: columns[name][k] for name in names}
                row, col = r["_row"] - at[4] * part, r["_col"] - at[3] * part
                spot = np.s_[row : row + r["_height"], col : col + r["_width"]]
                seen[spot] = True
                if not (samples[k].is_valid or cells[k].is_valid) or not (largest or np.isnan(best[spot]).any()):
                    continue
                if samples[k].is_valid:
                    values = np.frombuffer(samples[k].as_buffer(), dtype=np.float64).reshape(-1, r["_width"])
                else:
                    values = sampled(r, np.frombuffer(cells[k].as_buffer(), dtype=np.float64))
                best[spot] = np.fmax(best[spot], values) if largest else np.where(np.isnan(best[spot]), values, best[spot])
        if at is not None:
            finish()
        if done:
            yield ready()

    return dealt.select(*key, *names, "_samples", "_cells").mapInArrow(run, "z long, x long, y long, col long, row long, value double")


def blank_parts(tiles: DataFrame, n: int) -> DataFrame:
    """Fragments without samples for every part of every tile, behind all others in rank."""
    count, _ = parts_of(n)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    t = tiles.select("z", "x", "y").withColumn("_tx", numbers).withColumn("_ty", numbers)
    none = {k: v for k, v in FRAGMENT.items() if k not in t.columns}
    return t.select("*", *[F.lit(None).cast(v).alias(k) for k, v in none.items()])
