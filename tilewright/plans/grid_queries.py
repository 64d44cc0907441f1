"""Queries over the tile grids and the spatial predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import grid, predicates
from tilewright.operators import covers

from .registry import query


def r(c, digits: int = 6):
    return F.round(c, digits)


def rounded(columns: dict, digits: int = 6) -> list:
    return [r(c, digits).alias(n) for n, c in columns.items()]


def zooms(lo: int, hi: int) -> str:
    return f"cross join (select cast(range as bigint) as z from range({lo}, {hi + 1})) zz"


PI = "pi()"
POINT_TILES = f"""pt as (
  select pid, z, cast(floor((lon + 180.0) / 360.0 * pow(2, z)) as bigint) as x,
         cast(floor((1 - asinh(tan(radians(lat))) / {PI}) / 2 * pow(2, z)) as bigint) as y
  from points {zooms(0, 14)})"""


def point_tiles(i, lo=0, hi=14):
    return grid.explode_zooms(i.points, lo, hi).select(
        "pid", "z", grid.xyz_x("lon", "z").alias("x"), grid.xyz_y("lat", "z").alias("y")
    )


@query("g01_xyz_tile", f"with {POINT_TILES} select pid, z, x, y from pt")
def g01(i):
    return point_tiles(i)


XYZ_BOUNDS_SQL = """
  round(x / pow(2, z) * 360 - 180, 6) as west,
  round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))), 6) as south,
  round((x + 1) / pow(2, z) * 360 - 180, 6) as east,
  round(degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))), 6) as north"""


@query("g02_xyz_bounds", f"with {POINT_TILES} select pid, z, x, y, {XYZ_BOUNDS_SQL} from pt")
def g02(i):
    return point_tiles(i).select("pid", "z", "x", "y", *rounded(grid.xyz_bounds("z", "x", "y")))


@query("g03_geodetic_tile", f"""
select pid, z, cast(floor((lon + 180) * pow(2, z) / 180) as bigint) as x,
       cast(floor((lat + 90) * pow(2, z) / 180) as bigint) as y_south,
       cast(floor((90 - lat) * pow(2, z) / 180) as bigint) as y_north
from points {zooms(0, 14)}""")
def g03(i):
    return grid.explode_zooms(i.points, 0, 14).select(
        "pid", "z", grid.geodetic_x("lon", "z").alias("x"),
        grid.geodetic_y("lat", "z").alias("y_south"), grid.geodetic_y("lat", "z", "north").alias("y_north"),
    )


@query("g04_geodetic_bounds", """
select set_id, z, x, y, x * 180 / pow(2, z) - 180 as west, y * 180 / pow(2, z) - 90 as south,
       (x + 1) * 180 / pow(2, z) - 180 as east, (y + 1) * 180 / pow(2, z) - 90 as north,
       90 - (y + 1) * 180 / pow(2, z) as south_from_north
from tile_store""")
def g04(i):
    north = grid.geodetic_bounds("z", "x", "y", "north")
    return i.tile_store.select(
        "set_id", "z", "x", "y",
        *[c.alias(n) for n, c in grid.geodetic_bounds("z", "x", "y").items()],
        north["south"].alias("south_from_north"),
    )


@query("g05_mercator_bounds", f"""
with {POINT_TILES}
select z, x, y, count(*) as points, {XYZ_BOUNDS_SQL} from pt where z <= 22 group by z, x, y""")
def g05(i):
    tiles = point_tiles(i).filter("z <= 22").groupBy("z", "x", "y").agg(F.count("*").alias("points"))
    return tiles.select("z", "x", "y", "points", *rounded(grid.xyz_bounds("z", "x", "y")))


@query("g06_metre_bounds", f"""
with {POINT_TILES}
select pid, z, x, y,
       round(x * 40075016.685578488 / pow(2, z) - 20037508.342789244, 3) as min_x,
       round(20037508.342789244 - (y + 1) * 40075016.685578488 / pow(2, z), 3) as min_y,
       round((x + 1) * 40075016.685578488 / pow(2, z) - 20037508.342789244, 3) as max_x,
       round(20037508.342789244 - y * 40075016.685578488 / pow(2, z), 3) as max_y
from pt""")
def g06(i):
    return point_tiles(i).select("pid", "z", "x", "y", *rounded(grid.mercator_metre_bounds("z", "x", "y"), 3))


def xyz_range_sql(w="w", s="s", e="e", n="n") -> str:
    def y(lat):
        return f"cast(floor((1 - asinh(tan(radians({lat}))) / pi()) / 2 * pow(2, z)) as bigint)"

    return f"""greatest(0, cast(floor(({w} + 180) / 360 * pow(2, z)) as bigint)) as min_x,
       least(cast(pow(2, z) as bigint) - 1, cast(floor(({e} + 180) / 360 * pow(2, z)) as bigint)) as max_x,
       greatest(0, {y(n)}) as min_y, least(cast(pow(2, z) as bigint) - 1, {y(s)}) as max_y"""


GEODETIC_RANGE_SQL = """
       least(cast(floor((w + 180) * pow(2, z) / 180) as bigint), cast(floor((w + 180) * pow(2, z) / 180 + 0.5) as bigint)) as g_min_x,
       greatest(cast(floor((e + 180) * pow(2, z) / 180) as bigint), cast(floor((e + 180) * pow(2, z) / 180 + 0.5) as bigint)) as g_max_x,
       least(cast(floor((s + 90) * pow(2, z) / 180) as bigint), cast(floor((s + 90) * pow(2, z) / 180 + 0.5) as bigint)) as g_min_y,
       greatest(cast(floor((n + 90) * pow(2, z) / 180) as bigint), cast(floor((n + 90) * pow(2, z) / 180 + 0.5) as bigint)) as g_max_y"""

METRE = "40075016.685578488e0 / pow(2, z)"
METRE_RANGE_SQL = f"""
       greatest(0, cast(floor((radians(w) * 6378137.0 + 20037508.342789244) / ({METRE})) as bigint)) as m_min_x,
       least(cast(pow(2, z) as bigint) - 1, cast(ceil((radians(e) * 6378137.0 + 20037508.342789244) / ({METRE})) as bigint) - 1) as m_max_x,
       greatest(0, cast(floor((20037508.342789244 - asinh(tan(radians(n))) * 6378137.0) / ({METRE})) as bigint)) as m_min_y,
       least(cast(pow(2, z) as bigint) - 1, cast(ceil((20037508.342789244 - asinh(tan(radians(s))) * 6378137.0) / ({METRE})) as bigint) - 1) as m_max_y"""


@query("g07_tile_range", f"""
select file_id, z, {xyz_range_sql()}, {GEODETIC_RANGE_SQL}, {METRE_RANGE_SQL} from footprints {zooms(2, 9)}""")
def g07(i):
    west, south = grid.lonlat_to_metres("w", "s")
    east, north = grid.lonlat_to_metres("e", "n")
    return grid.explode_zooms(i.footprints, 2, 9).select(
        "file_id", "z",
        *[c.alias(n) for n, c in grid.xyz_range("z", "w", "s", "e", "n").items()],
        *[c.alias("g_" + n) for n, c in grid.geodetic_range("z", "w", "s", "e", "n").items()],
        *[c.alias("m_" + n) for n, c in grid.metre_range("z", west, south, east, north).items()],
    )


RANGES_SQL = f"rg as (select file_id, z, {xyz_range_sql()} from footprints {zooms(0, 9)})"


def footprint_ranges(i, lo=0, hi=9):
    return grid.explode_zooms(i.footprints.select("file_id", "w", "s", "e", "n"), lo, hi).select(
        "file_id", "z", *[c.alias(n) for n, c in grid.xyz_range("z", "w", "s", "e", "n").items()]
    )


@query("g08_enumerate_tiles", f"""
with {RANGES_SQL}
select file_id, z, x, unnest(range(min_y, max_y + 1)) as y
from (select *, unnest(range(min_x, max_x + 1)) as x from rg) q""")
def g08(i):
    return grid.enumerate_tiles(footprint_ranges(i)).select("file_id", "z", "x", "y")


@query("g08_cover_ranges", f"""
with {RANGES_SQL}
select file_id, z, x, unnest(range(min_y, max_y + 1)) as y
from (select *, unnest(range(min_x, max_x + 1)) as x from rg) q""")
def g08_covers(i):
    """The same tiles by way of whole subtrees."""
    cover = covers.covers(footprint_ranges(i).select("file_id", "z", "min_x", "max_x", "min_y", "max_y"), 9)
    return covers.listed(cover, 9).select("file_id", "z", "x", "y")


@query("g09_range_size", f"""
with {RANGES_SQL}
select file_id, cast(sum((max_x - min_x + 1) * (max_y - min_y + 1)) as bigint) as tiles from rg group by file_id""")
def g09(i):
    return footprint_ranges(i).groupBy("file_id").agg(
        F.sum(grid.range_size("min_x", "max_x", "min_y", "max_y")).alias("tiles")
    )


@query("g10_expand_range", f"""
with {RANGES_SQL}
select file_id, z, greatest(0, min_x - 1) as min_x, max_x + 1 as max_x,
       greatest(0, min_y - 1) as min_y, max_y + 1 as max_y from rg""")
def g10(i):
    return footprint_ranges(i).select(
        "file_id", "z", *[c.alias(n) for n, c in grid.expand_range("min_x", "max_x", "min_y", "max_y").items()]
    )


@query("g11_subdivide_range", f"""
with rg as (select file_id, z, {xyz_range_sql()} from footprints {zooms(10, 13)}),
dims as (select *, max_x - min_x + 1 as w, max_y - min_y + 1 as h,
         cast(ceil((max_x - min_x + 1) / 16.0) as bigint) as nx, cast(ceil((max_y - min_y + 1) / 16.0) as bigint) as ny from rg),
px as (select *, unnest(range(nx)) as part_x from dims),
py as (select *, unnest(range(ny)) as part_y from px)
select file_id, z, part_x, part_y,
       min_x + cast(floor(part_x * (w / nx)) as bigint) as part_min_x,
       min_x + cast(floor((part_x + 1) * (w / nx)) as bigint) - 1 as part_max_x,
       min_y + cast(floor(part_y * (h / ny)) as bigint) as part_min_y,
       min_y + cast(floor((part_y + 1) * (h / ny)) as bigint) - 1 as part_max_y
from py""")
def g11(i):
    return grid.subdivide_range(footprint_ranges(i, 10, 13)).select(
        "file_id", "z", "part_x", "part_y", "part_min_x", "part_max_x", "part_min_y", "part_max_y"
    )


@query("g12_parent_children", """
select set_id, z, x, y, x // 2 as parent_x, y // 2 as parent_y,
       (case when y % 2 = 1 then 'N' else 'S' end) || (case when x % 2 = 1 then 'E' else 'W' end) as quadrant,
       z + 1 as child_z, 2 * x + i as child_x, 2 * y + j as child_y
from tile_store cross join (select range as i from range(2)) a cross join (select range as j from range(2)) b""")
def g12(i):
    tiles = i.tile_store.select("set_id", "z", "x", "y")
    return grid.children(tiles).withColumns({**grid.parent("x", "y"), "quadrant": grid.quadrant("x", "y")})


@query("g13_neighbours", """
select set_id, z, x, y, x + dx as n_x, y + dy as n_y,
       cast(row_number() over (partition by set_id, z, x, y order by dx, dy) - 1 as int) as n_ord
from tile_store
cross join (select range - 1 as dx from range(3)) a cross join (select range - 1 as dy from range(3)) b
where dx <> 0 or dy <> 0""")
def g13(i):
    return grid.neighbours(i.tile_store.select("set_id", "z", "x", "y"))


@query("g14_flip_y", "select set_id, z, x, y, (1 << cast(z as int)) - y - 1 as flipped from tile_store")
def g14(i):
    return i.tile_store.select("set_id", "z", "x", "y", grid.flip_y("z", "y").alias("flipped"))


@query("g15_resolution", """
with f as (select file_id, px, e - w as width from footprints)
select file_id, cast(ceil(round(log2(360.0 / 2 / 65) - log2(px), 9)) as bigint) as zoom,
       round(360.0 / 2 / 65 / pow(2, ceil(round(log2(360.0 / 2 / 65) - log2(px), 9))), 10) as resolution,
       cast(ceil(round(log2(2 * pi() * 6378137.0 / 256) - log2(radians(width / 100) * 6378137.0), 9)) as bigint) as mercator_zoom
from f""")
def g15(i):
    zoom = grid.zoom_for_resolution("px")
    return i.footprints.select(
        "file_id", zoom.alias("zoom"), r(grid.resolution(zoom), 10).alias("resolution"),
        grid.zoom_for_resolution(F.radians((F.col("e") - F.col("w")) / 100) * grid.EARTH_RADIUS, "mercator").alias("mercator_zoom"),
    )


@query("g16_pixel_grid", f"""
with p as (select pid, z, cast(floor((lon + 180) / (360.0 / 2 / 65 / pow(2, z))) as bigint) as px,
                  cast(floor((lat + 90) / (360.0 / 2 / 65 / pow(2, z))) as bigint) as py
           from points {zooms(0, 10)})
select pid, z, px, py, px // 65 as x, py // 65 as y,
       round((px // 65) * 65 * (360.0 / 2 / 65 / pow(2, z)) - 180, 6) as west,
       round((py // 65) * 65 * (360.0 / 2 / 65 / pow(2, z)) - 90, 6) as south,
       round((px // 65 + 1) * 65 * (360.0 / 2 / 65 / pow(2, z)) - 180, 6) as east,
       round((py // 65 + 1) * 65 * (360.0 / 2 / 65 / pow(2, z)) - 90, 6) as north
from p""")
def g16(i):
    px, py = grid.crs_to_pixel("lon", "lat", "z")
    df = grid.explode_zooms(i.points, 0, 10).select("pid", "z", px.alias("px"), py.alias("py"))
    x, y = grid.pixel_to_tile("px", "py")
    df = df.withColumns({"x": x, "y": y})
    return df.select("pid", "z", "px", "py", "x", "y", *rounded(grid.pixel_tile_bounds("z", "x", "y")))


@query("g17_max_zoom_for_size", """
select file_id, least(18, cast(trunc(round(log2(greatest((e - w) / px, (n - s) / px) / 256), 9)) as bigint) + 1) as max_zoom
from footprints""")
def g17(i):
    return i.footprints.select(
        "file_id",
        grid.max_zoom_for_size((F.col("e") - F.col("w")) / F.col("px"), (F.col("n") - F.col("s")) / F.col("px")).alias("max_zoom"),
    )


TILE_METRES = "(radians(180.0 / pow(2, z)) * 6378137.0)"


@query("g18_tile_metres", f"""
select z, count(*) as tiles, round({TILE_METRES}, 4) as tile_metres, round({TILE_METRES} / 256, 6) as pixel_metres
from tile_store group by z""")
def g18(i):
    return i.tile_store.groupBy("z").agg(F.count("*").alias("tiles")).select(
        "z", "tiles", r(grid.tile_size_metres("z"), 4).alias("tile_metres"),
        r(grid.desired_pixel_metres("z"), 6).alias("pixel_metres"),
    )


@query("g19_refine_limits", f"""
with d as (select l_linenumber * 4 + cast(l_suppkey % 5 as int) as z, count(*) as tiles from lineitem group by 1)
select cast(z as bigint) as z, tiles,
       round({TILE_METRES} / 2.5 * case when z < 11 then 0.2 else 1 end, 4) as max_triangle,
       round({TILE_METRES} * 0.1 / 4 * case when z > 17 then 0.75 when z > 15 then 1.0 when z > 14 then 1.125
             when z > 10 then 1.25 else 1.0 end, 4) as min_triangle,
       round({TILE_METRES} / 4 * case when z < 5 then 0.01 when z <= 8 then 0.015 when z = 9 then 0.02 when z = 10 then 0.03
             when z = 11 then 0.04 when z = 12 then 0.05 when z <= 15 then 0.06 when z = 16 then 0.065 else 0.07 end, 4) as max_deviation
from d""")
def g19(i):
    depth = (F.col("l_linenumber") * 4 + F.col("l_suppkey") % 5).cast("bigint")
    d = i.table("lineitem").groupBy(depth.alias("z")).agg(F.count("*").alias("tiles"))
    return d.select("z", "tiles", *rounded(grid.refine_limits("z"), 4))


@query("g20_level_error", """
select z, count(*) as tiles, round(6378137.0 * 2 * pi() * 0.25 / (65 * 2) / pow(2, z), 6) as max_error
from tile_store group by z""")
def g20(i):
    return i.tile_store.groupBy("z").agg(F.count("*").alias("tiles")).select(
        "z", "tiles", r(grid.level_error("z")).alias("max_error")
    )


@query("g21_wmts_matrix", """
select set_id, cast(z as string) as identifier, count(*) as tiles,
       round(559082264.029 / pow(2, z), 6) as scale_denominator, -20037508.34e0 as top_left_x, 20037508.34e0 as top_left_y,
       256 as tile_pixels, cast(pow(2, z) as bigint) as matrix_width, cast(pow(2, z) as bigint) as matrix_height
from tile_store group by set_id, z""")
def g21(i):
    levels = i.tile_store.groupBy("set_id", "z").agg(F.count("*").alias("tiles"))
    m = grid.wmts_matrix("z")
    m["scale_denominator"] = r(m["scale_denominator"])
    return levels.select("set_id", "tiles", *[c.alias(n) for n, c in m.items()])


# predicates ---------------------------------------------------------------------------------

A = {"w": "w", "s": "s", "e": "e", "n": "n"}


def lattice_boxes(i):
    """Each footprint against the level-5 geodetic tile its centre falls in and the one east of it."""
    f = i.footprints.withColumn("z", F.lit(5).cast("bigint"))
    f = f.withColumns({
        "x": grid.geodetic_x((F.col("w") + F.col("e")) / 2, "z"),
        "y": grid.geodetic_y((F.col("s") + F.col("n")) / 2, "z"),
    }).withColumn("x", F.explode(F.array(F.col("x"), F.col("x") + 1)))
    b = grid.geodetic_bounds("z", "x", "y")
    return f.withColumns({"tw": b["west"], "ts": b["south"], "te": b["east"], "tn": b["north"]})


LATTICE_SQL = """lb as (
  select file_id, w, s, e, n, 5 as z, x, y, x * 5.625 - 180 as tw, y * 5.625 - 90 as ts, (x + 1) * 5.625 - 180 as te, (y + 1) * 5.625 - 90 as tn
  from (select *, cast(floor(((w + e) / 2 + 180) / 5.625) as bigint) + k as x, cast(floor(((s + n) / 2 + 90) / 5.625) as bigint) as y
        from footprints cross join (select range as k from range(2)) kk) q)"""
B = {"w": "tw", "s": "ts", "e": "te", "n": "tn"}


@query("f01_bbox_intersects_closed", f"""
with {LATTICE_SQL} select file_id, x, y from lb where not (w > te or e < tw or s > tn or n < ts)""")
def f01(i):
    return lattice_boxes(i).filter(predicates.bbox_intersects_closed(A, B)).select("file_id", "x", "y")


@query("f02_bbox_overlaps_open", f"""
with {LATTICE_SQL} select file_id, x, y from lb where not (w >= te or e <= tw or s >= tn or n <= ts)""")
def f02(i):
    return lattice_boxes(i).filter(predicates.bbox_overlaps_open(A, B)).select("file_id", "x", "y")


@query("f03_point_in_bbox", """
select pid, lon >= -90 and lon <= 90 and lat >= -45 and lat <= 45 as inside from points""")
def f03(i):
    box = {"w": F.lit(-90.0), "s": F.lit(-45.0), "e": F.lit(90.0), "n": F.lit(45.0)}
    return i.points.select("pid", predicates.point_in_bbox("lon", "lat", box).alias("inside"))


@query("f04_valid_tile", """
select set_id, z, x, y, x * 2 < pow(2, z) and y * 2 < pow(2, z) as valid_xyz,
       x * 2 < pow(2, z + 1) and y * 2 < pow(2, z) as valid_geodetic from tile_store""")
def f04(i):
    x, y = F.col("x") * 2, F.col("y") * 2
    return i.tile_store.select(
        "set_id", "z", "x", "y", predicates.valid_tile("z", x, y).alias("valid_xyz"),
        predicates.valid_tile("z", x, y, "geodetic").alias("valid_geodetic"),
    )


@query("f05_in_range", """
select set_id, z, x, y from tile_store where z = 5 and x between 4 and 20 and y between 6 and 18""")
def f05(i):
    inside = predicates.in_range("z", "x", "y", *[F.lit(v) for v in (5, 4, 20, 6, 18)])
    return i.tile_store.filter(inside).select("set_id", "z", "x", "y")
