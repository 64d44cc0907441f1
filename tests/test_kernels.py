"""Whole tiles against a plain loop over positions and rasters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import kernels, rasters

SPACE = {"half": (0.5, 0.5, 1), "edge": (0.0, 0.0, 1), "grown": (-0.5, 0.5, 1), "cells": (0.5, 0.5, 0)}


def world(seed):
    """Rasters of several sizes, two of them crossing a tile border, one with holes and one without any cell."""
    rnd = random.Random(seed)
    meta = [(1, 10.0, 20.0, 0.25, 90, 70), (2, 5.0, 15.0, 0.5, 30, 20), (3, 12.5, 19.0, 0.25, 8, 8), (4, 11.0, 18.0, 1.0, 3, 3), (5, 24.0, 12.0, 0.125, 100, 9), (6, 10.0, 20.0, 0.25, 90, 70)]
    cells = {(f, c, r): float(rnd.randrange(-5, 90)) for f, _, _, _, cols, rows in meta for c in range(cols) for r in range(rows) if f != 4 and rnd.random() > (0.3 if f == 3 else 0.02)}
    return meta, cells


def brute(tile, n, spacing, meta, cells, bilinear):
    """For every place of a tile the samples (file, px, value) of all rasters over it."""
    z, x, y = tile
    a = 180.0 / 2**z
    sx, sy, short = SPACE[spacing]
    out = {}
    for col in range(n):
        lon = a * x - 180.0 + a / (n - short) * (col + sx)
        for row in range(n):
            lat = a * y - 90.0 + a / (n - short) * (row + sy)
            for f, w, north, px, cols, rows in meta:
                if not (w <= lon <= w + cols * px and north - rows * px <= lat <= north):
                    continue
                u, v = (lon - w) / px, (north - lat) / px
                c, r = max(0, min(math.floor(u), cols - 1)), max(0, min(math.floor(v), rows - 1))
                value = cells.get((f, c, r))
                if bilinear:
                    four = [cells.get((f, min(c + i, cols - 1), min(r + j, rows - 1))) for j in (0, 1) for i in (0, 1)]
                    if None not in four:
                        u, v = u - c, v - r
                        value = (four[0] * (1 - u) + four[1] * u) * (1 - v) + (four[2] * (1 - u) + four[3] * u) * v
                out.setdefault((col, row), []).append((f, px, value))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    meta, cells = world(4)
    r = spark.createDataFrame([(f, w, n, px, c, q) for f, w, n, px, c, q in meta], "file_id long, w double, n double, px double, cols long, rows long")
    c = spark.createDataFrame([(*k, v) for k, v in cells.items()], "file_id long, col long, row long, value double").cache()
    tiles = [(4, 16, 8), (4, 17, 9), (6, 68, 38), (0, 1, 0), (4, 2, 2)]
    return meta, cells, r, c, tiles, spark.createDataFrame([*tiles, tiles[0]], "z long, x long, y long")


def rounded(rows):
    return {k: None if v is None else round(v, 9) for k, v in rows.items()}


def got_of(df, value="value"):
    rows = [(r.z, r.x, r.y, r.col, r.row, r[value]) for r in df.collect()]
    out = {r[:5]: r[5] for r in rows}
    assert len(out) == len(rows)
    return rounded(out)


def first(samples, key, default=None):
    have = sorted((key(s), s[2]) for s in samples if s[2] is not None)
    return have[0][1] if have else default


@pytest.mark.parametrize("n, spacing, bilinear", [(33, "half", True), (150, "edge", False), (65, "grown", True)])
def test_tile_raster(tables, n, spacing, bilinear):
    meta, cells, r, c, tiles, table = tables
    got = got_of(rasters.tile_raster(table, r, c, n, method="bilinear" if bilinear else "nearest", spacing=spacing))
    want = {(*t, *at): first(s, lambda x: (x[1] ** 2, x[0])) for t in tiles for at, s in brute(t, n, spacing, meta, cells, bilinear).items()}
    assert got == rounded(want) and None in want.values()


def test_largest_value(tables):
    meta, cells, r, c, tiles, table = tables
    got = got_of(rasters.tile_raster(table, r, c, 20, priority="max"))
    want = {(*t, *at): max((x[2] for x in s if x[2] is not None), default=None) for t in tiles for at, s in brute(t, 20, "half", meta, cells, True).items()}
    assert got == rounded(want)


@pytest.mark.parametrize("resampling", ["near", "bilinear"])
def test_warp(tables, resampling):
    meta, cells, r, c, tiles, table = tables
    got = got_of(rasters.warp_tile(table, r, c, 70, resampling, nodata=7.0))
    clean = {k: v for k, v in cells.items() if v != 7.0}
    want = {(*t, *at): first(s, lambda x: -x[0]) for t in tiles for at, s in brute(t, 70, "cells", meta, clean, resampling == "bilinear").items()}
    assert got == rounded({k: v for k, v in want.items() if v is not None})


def test_heightmap_is_whole(tables):
    meta, cells, r, c, tiles, table = tables
    got = got_of(rasters.heightmap(table, r, c, 17), "height")
    want = {(*t, col, row): 0.0 for t in tiles for col in range(17) for row in range(17)}
    want |= {(*t, *at): first(s, lambda x: (x[1] ** 2, x[0]), 0.0) for t in tiles for at, s in brute(t, 17, "grown", meta, cells, True).items()}
    assert got == rounded(want)


def test_no_tiles_and_no_rasters(tables):
    _, _, r, c, _, table = tables
    assert rasters.tile_raster(table.limit(0), r, c, 8).count() == rasters.tile_raster(table, r.limit(0), c, 8).count() == 0
    assert rasters.heightmap(table, r.limit(0), c, 8).count() == 5 * 64


def test_parts_cover_a_tile():
    for n in (1, 2, 16, 63, 64, 65, 127, 128, 200, 256, 1000):
        count, part = kernels.parts_of(n)
        assert (count - 1) * part < n <= count * part


def test_mosaic_keeps_every_position(spark, tables):
    meta, cells, r, c, _, _ = tables
    at = [(1, 12.34, 18.77), (2, 12.34, 18.77), (2, 12.34, 18.77), (3, -100.0, 0.0), (4, 11.5, 17.2), (None, 30.1, 11.9)]
    points = spark.createDataFrame(at, "pid int, lon double, lat double")
    for priority in ("resolution", "max"):
        rows = [tuple(x) for x in rasters.mosaic(points, r, c, priority).collect()]
        assert sorted(map(str, (x[:3] for x in rows))) == sorted(map(str, at))
        values = {x[0]: x[3] for x in rows}
        assert values[3] is None and values[1] == values[2] is not None


def test_equal_positions_are_looked_up_once(spark, tables, monkeypatch):
    meta, cells, r, c, _, _ = tables
    looked_up, plain = [], rasters.covering
    monkeypatch.setattr(rasters, "covering", lambda p, q: looked_up.append(p.count()) or plain(p, q))
    at = [(k, 12.34 + k % 3, 18.77) for k in range(60)] + [(60, None, 18.77), (61, 0.0, 0.0), (62, -0.0, 0.0), (63, float("nan"), 1.0)]
    points = spark.createDataFrame(at, "pid int, lon double, lat double")
    near = [tuple(x) for x in rasters.sample_nearest(points, r, c).select("pid", "file_id", "value").collect()]
    between = [tuple(x) for x in rasters.sample_bilinear(points, r, c).select("pid", "file_id", "value").collect()]
    tops = [x for p in ("resolution", "max") for x in rasters.mosaic(points, r, c, p).collect()]
    short = [tuple(x) for x in rasters.sample_bilinear(points, r, c, digits=3).select("pid", "file_id", "value").collect()]
    assert {x[:2]: x[2] for x in short} == {x[:2]: None if x[2] is None else round(x[2], 3) for x in between} and len(short) == len(between)
    assert len(looked_up) == 5 and max(looked_up) <= 5
    under = [(p, f) for p, lon, lat in at for f, w, n, px, cols, rows in meta if lon is not None and w <= lon <= w + cols * px and n - rows * px <= lat <= n]
    assert sorted(x[:2] for x in near) == sorted(x[:2] for x in between) == sorted(under) and len(under) >= 60
    for p, f, value in near:
        _, w, n, px, cols, rows = next(m for m in meta if m[0] == f)
        assert value == cells.get((f, min(math.floor((at[p][1] - w) / px), cols - 1), min(math.floor((n - at[p][2]) / px), rows - 1)))
    assert len(tops) == 2 * len(at) and all(x.value is None for x in tops if x.pid >= 60)


def test_pieces_of_blocks_travel_instead_of_cells(spark, tables, monkeypatch):
    _, cells, _, c, _, _ = tables
    monkeypatch.setattr(rasters, "GATHER", 1000)
    plan = rasters.block_lists(c)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow")  # the gathering lies below the shuffle
    got = {(r.file_id, r._bx * 64 + i % 65, r._by * 64 + i // 65): v for r in rasters.block_lists(c).collect() for i, v in zip(r._at, r._v, strict=True)}
    assert got == cells
    count = sum((1 + (k[1] % 64 == 0 < k[1])) * (1 + (k[2] % 64 == 0 < k[2])) for k in cells)
    assert rasters.block_lists(c).selectExpr("sum(size(_at))").first()[0] == count


def test_of_a_rectangle_travels_what_is_less(spark, tables):
    """Cells where a tile has more positions than the raster cells below them, samples where it has fewer, nothing without a value."""
    _, _, r, c, _, table = tables
    found = rasters.tile_fragments(table, r, c, 256, "half", True).collect()
    kinds = set()
    for f in found:
        samples, cells = (None if v is None else len(v) // 8 for v in (f._samples, f._cells))
        assert samples is None or cells is None
        assert samples in (None, f._width * f._height) and (cells is None or cells < f._width * f._height and cells % f._across == 0)
        kinds.add((samples is not None, cells is not None))
    assert kinds == {(True, False), (False, True), (False, False)}


def test_taken_places_are_not_sampled(spark, tables, monkeypatch):
    """Ten copies of a raster without holes: only the one on top is sampled."""
    one = spark.sql("select 0L file_id, 10.0D w, 20.0D n, 0.25D px, 40L cols, 40L rows")
    cells = spark.range(1600).selectExpr("0L AS file_id", "id % 40 AS col", "id div 40 AS row", "id * 1.0D AS value")
    copies = spark.range(10).withColumnRenamed("id", "k")
    r = one.crossJoin(copies).selectExpr("k AS file_id", "w", "n", "px", "cols", "rows")
    c = cells.crossJoin(copies).selectExpr("k AS file_id", "col", "row", "value + k AS value")
    tile = spark.createDataFrame([(6, 68, 38)], "z long, x long, y long")
    count, plain = spark.sparkContext.accumulator(0), kernels._sampled
    found = rasters.tile_fragments(tile, r, c, 128, "half", True).cache()
    assert found.count() == 10 and found.where("_cells is null").isEmpty()

    def counted(*a):
        count.add(1)
        return plain(*a)

    monkeypatch.setattr(kernels, "_sampled", counted)
    for largest, times in ((False, 1), (True, 10)):
        before = count.value
        assert kernels.layered(found, 128, "half", True, [F.col("file_id")], "covered", largest).count() > 0
        assert count.value - before == times
    alone = rasters.tile_raster(tile, r.where("file_id = 9"), c.where("file_id = 9"), 128)
    assert got_of(rasters.tile_raster(tile, r, c, 128, priority="max")) == got_of(alone)
