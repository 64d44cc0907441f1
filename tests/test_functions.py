"""Edge cases and round trips of the Column functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import encoding, geodesy, grid, lattice, predicates, text
from tilewright.operators.index import tile_sources


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("lon,lat,z,x,y", [(0.0, 0.0, 1, 1, 1), (22.5, 0.0, 4, 9, 8), (-180.0, 85.0, 3, 0, 0), (-180.01, 0.0, 3, -1, 4)])
def test_xyz_tile_on_edges(spark, lon, lat, z, x, y):
    assert tuple(one(spark, grid.xyz_x(F.lit(lon), F.lit(z)), grid.xyz_y(F.lit(lat), F.lit(z)))) == (x, y)


def test_poles_of_the_geodetic_grid(spark):
    r = one(spark, grid.geodetic_y(F.lit(-90.0), F.lit(4)), grid.geodetic_y(F.lit(89.999), F.lit(4)), grid.geodetic_y(F.lit(89.999), F.lit(4), "north"))
    assert tuple(r) == (0, 15, 0)


def test_touching_boxes_meet_only_when_closed(spark):
    a = {"w": F.lit(0.0), "s": F.lit(0.0), "e": F.lit(22.5), "n": F.lit(10.0)}
    b = {"w": F.lit(22.5), "s": F.lit(0.0), "e": F.lit(45.0), "n": F.lit(10.0)}
    assert tuple(one(spark, predicates.bbox_intersects_closed(a, b), predicates.bbox_overlaps_open(a, b))) == (True, False)


def test_tile_to_bounds_and_back(spark):
    t = grid.enumerate_tiles(spark.sql("select 5L z, 0L min_x, 31L max_x, 0L min_y, 31L max_y")).select("z", "x", "y")
    b = grid.xyz_bounds("z", "x", "y")
    t = t.withColumns({"lon": (b["west"] + b["east"]) / 2, "lat": (b["south"] + b["north"]) / 2})
    assert t.filter((grid.xyz_x("lon", "z") != F.col("x")) | (grid.xyz_y("lat", "z") != F.col("y"))).count() == 0


def test_children_partition_their_parent(spark):
    t = spark.sql("select 3L z, 5L x, 2L y")
    c = grid.children(t)
    assert c.count() == 4
    assert c.select(F.shiftright("child_x", 1), F.shiftright("child_y", 1)).distinct().collect() == [(5, 2)]


def test_closed_index_takes_both_sides_of_an_edge(spark):
    f = spark.sql("select * from values (1L, -10.0D, -10.0D, 0.0D, 10.0D), (2L, 45.0D, -1.0D, 46.0D, 1.0D) t(file_id, w, s, e, n)")
    got = {(r.x, r.y) for r in tile_sources(f, 2, 2).filter("file_id = 1").collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_antimeridian_box_is_cut(spark):
    r = spark.sql("select 179.0D w, -179.0D e").select(F.explode(text.split_antimeridian("w", "e")).alias("i")).select("i.*").collect()
    assert sorted(map(tuple, r)) == [(-180.0, -179.0), (179.0, 180.0)]


def test_bad_paths_have_no_key(spark):
    p = spark.sql("select explode(array('5/a/3.png', '5/7.png', 'layer.json', '5/7/3.png')) as path")
    assert [r.y for r in p.select(text.parse_tile_path("path")["y"].alias("y")).collect()] == [None, None, None, 3]


def test_layouts_round_trip(spark):
    t = spark.sql("select 7L z, 100L x, 63L y")
    for layout in ("nested", "flat", "folded"):
        back = text.parse_tile_path("p", layout)
        r = t.withColumn("p", text.tile_path("z", "x", "y", layout)).select(*[back[k].alias(k) for k in "zxy"]).first()
        assert tuple(r) == (7, 100, 63)


@pytest.mark.parametrize("n", [0, -1, 1, -32768, 32767, 2**40, -(2**40)])
def test_zigzag_round_trip(spark, n):
    v = encoding.zigzag(F.lit(n))
    r = one(spark, v, encoding.unzigzag(v))
    assert r[0] == (2 * n if n >= 0 else -2 * n - 1) and r[1] == n


def test_flat_tile_quantizes_to_zero(spark):
    assert one(spark, encoding.quantize(F.lit(5.0), F.lit(5.0), F.lit(5.0)))[0] == 0
    assert tuple(one(spark, encoding.quantize(F.lit(1.0), F.lit(0.0), F.lit(3.0)), encoding.quantize(F.lit(1.0), F.lit(0.0), F.lit(2.0)), encoding.quantize(F.lit(1.0), F.lit(0.0), F.lit(2.0), "trunc"))) == (10922, 16384, 16383)


def test_ecef_round_trip(spark):
    p = spark.sql("select * from values (0.0D, 0.0D, 0.0D), (179.9D, 89.9D, 8000.0D), (-120.5D, -45.25D, -300.0D) t(a, b, c)")
    x, y, z = geodesy.ecef("a", "b", "c")
    got = geodesy.geographic(p.withColumns({"x": x, "y": y, "zz": z}), "x", "y", "zz", ("lon", "lat", "h")).collect()
    for r in got:
        assert abs(r.lon - r.a) < 1e-9 and abs(r.lat - r.b) < 1e-9 and abs(r.h - r.c) < 1e-3


def test_rtin_levels_reach_their_parents():
    levels = np.full((1, 9, 9), -1, dtype=np.int32)
    levels[0, 1, 1] = 3
    out = lattice.propagate_levels(levels)
    assert out[0, 2, 0] == 3 and out[0, 0, 2] == 3 and out[0, 2, 2] == 3 and out[0, 4, 4] == 3


def test_plane_has_no_split_errors():
    j, i = np.mgrid[0:17, 0:17]
    assert np.allclose(lattice.split_errors((2.0 * i + 3.0 * j)[None].astype(float)), 0)


def test_cells_in_triangles(spark):
    """Spans of cells against the test of every cell, for either turn, slivers and points."""
    import random

    from tilewright.operators import mesh

    rnd, n, z, x, y = random.Random(9), 17, 3, 5, 2
    w, s, a = x * 22.5 - 180, y * 22.5 - 90, 22.5 / 16
    corners = [[(rnd.uniform(-1, 17), rnd.uniform(-1, 17)) for _ in "abc"] for _ in range(60)]
    corners += [[(rnd.randrange(17), rnd.randrange(17)) for _ in "abc"] for _ in range(60)] + [[(3, 4)] * 3, [(0, 0), (16, 16), (16, 0)], [(2, 2), (9, 2), (5, 2)]]
    rows = [(z, x, y, k, *[v for i, j in t for v in (w + a * i, s + a * j)]) for k, t in enumerate(corners)]
    df = spark.createDataFrame(rows, "z long, x long, y long, tid long, lon0 double, lat0 double, lon1 double, lat1 double, lon2 double, lat2 double")
    got = {(r.tid, r.col, r.row) for r in mesh.cells_in_triangles(df, n).collect()}
    want = set()
    for k, t in enumerate(corners):
        for i in range(n):
            for j in range(n):
                sides = [(q[0] - p[0]) * (j - p[1]) - (q[1] - p[1]) * (i - p[0]) for p, q in zip(t, t[1:] + t[:1])]
                box = all(min(c[d] for c in t) - 1e-9 <= v <= max(c[d] for c in t) + 1e-9 for d, v in ((0, i), (1, j)))
                turn = (t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])
                if turn and box and (min(sides) >= -1e-9 or max(sides) <= 1e-9):
                    want.add((k, i, j))
    assert got == want
