"""Queries over raster cells: sampling, mosaics, tiles, overviews and pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.operators import metadata, projections, rasters

from .grid_queries import r
from .registry import query


@query("src04_footprint_scan", """
select file_id, p % 512 + 256 as cols, p % 256 + 128 as rows, 0.25e0 as px, 0.125e0 as py, cast(case when p % 3 = 0 then 2 else 1 end as int) as bands,
       'Float32' as band_type, -9999.0e0 as nodata, x0 as w, y0 - (p % 256 + 128) * 0.125e0 as s, x0 + (p % 512 + 256) * 0.25e0 as e, y0 as n,
       case when p % 2 = 0 then 'EPSG:4326' else 'EPSG:3857' end as srs,
       (2 * x0 + (p % 512 + 256) * 0.25e0) / 2 as center_x, (2 * y0 - (p % 256 + 128) * 0.125e0) / 2 as center_y
from (select p_partkey as file_id, p_partkey as p, cast(p_partkey % 170 - 85 || '.5' as double) as x0, p_partkey % 80 + 0.25e0 as y0 from part) q""")
def src04(i):
    return metadata.footprints_from_json(i.meta_json)


@query("src04_footprint_text", """
select p_partkey as file_id, p_partkey % 512 + 256 as cols, p_partkey % 256 + 128 as rows, (p_partkey % 9 + 1) / 100 as px,
       round(case when p_partkey % 4 = 1 then p_partkey % 170 + 0.5 else -(p_partkey % 170 + 0.5 + 15 / 3600) end, 9) as west from part""")
def src04_text(i):
    f = metadata.footprints_from_text(i.meta_text)
    return f.select("file_id", "cols", "rows", "px", r(F.col("west"), 9).alias("west"))


@query("src05_read_cells", """
select file_id, col, row, value from cells""")
def src05(i):
    # the same cells as a file would hold them: the sentinel for every third missing value, NaN for the rest
    v = F.coalesce(F.col("value"), F.when(F.col("col") % 3 == 0, F.lit(rasters.NODATA)).otherwise(F.lit(float("nan"))))
    return rasters.read_cells(i.cells.withColumn("value", v))


COVER = """cov as (select p.*, r.file_id, r.w, r.n, r.px, r.cols, r.rows, (lon - w) / px as ux, (n - lat) / px as uy
  from {points} p join rasters r on lon >= w and lon <= w + cols * px and lat <= n and lat >= n - rows * px)"""
AT = """aa as (select *, greatest(0, least(cast(floor(ux) as bigint), cols - 1)) as c0, greatest(0, least(cast(floor(uy) as bigint), rows - 1)) as r0 from cov)"""


def bilinear_sql(points: str = "probes", cells: str = "cells", cover: str | None = None) -> str:
    joins = "\n".join(
        f"left join {cells} v{a}{b} on v{a}{b}.file_id = a.file_id and v{a}{b}.col = least(c0 + {a}, cols - 1) and v{a}{b}.row = least(r0 + {b}, rows - 1)"
        for a in (0, 1) for b in (0, 1))
    return f"""{cover or COVER.format(points=points)}, {AT},
bl as (select a.*, coalesce((v00.value * (1 - (ux - c0)) + v10.value * (ux - c0)) * (1 - (uy - r0)) + (v01.value * (1 - (ux - c0)) + v11.value * (ux - c0)) * (uy - r0), v00.value) as value
  from aa a {joins})"""


@query("j03_sample_nearest", f"""with {COVER.format(points='probes')}, {AT}
select pid, a.file_id, c0 as col, r0 as row, value from aa a left join cells c on c.file_id = a.file_id and c.col = c0 and c.row = r0""")
def j03(i):
    return rasters.sample_nearest(i.probes, i.rasters, i.cells).select(
        "pid", "file_id", F.col("cell_col").alias("col"), F.col("cell_row").alias("row"), "value")


@query("j04_sample_bilinear", f"with {bilinear_sql()} select pid, file_id, round(value, 6) as value from bl")
def j04(i):
    return rasters.sample_bilinear(i.probes, i.rasters, i.cells, digits=6).select("pid", "file_id", "value")


BEST = "row_number() over (partition by {k} order by case when value is null then 1 else 0 end, px, file_id)"


@query("j05_mosaic", f"""with {bilinear_sql()},
b as (select *, {BEST.format(k='pid')} as k from bl)
select p.pid, round(value, 6) as value, case when value is not null then file_id end as file_id from probes p left join (select * from b where k = 1) b on b.pid = p.pid""")
def j05(i):
    return rasters.mosaic(i.probes, i.rasters, i.cells).select("pid", r(F.col("value")).alias("value"), "file_id")


@query("j05_mosaic_max", f"with {bilinear_sql()} select p.pid, round(max(value), 6) as value from probes p left join bl on bl.pid = p.pid group by p.pid")
def j05_max(i):
    return rasters.mosaic(i.probes, i.rasters, i.cells, "max").select("pid", r(F.col("value")).alias("value"))


def area_tiles(i, z: int):
    """Tiles of a level the probes fall into."""
    zz = F.lit(z).cast("bigint")
    return i.probes.select(zz.alias("z"), grid.geodetic_x("lon", zz).alias("x"), grid.geodetic_y("lat", zz).alias("y")).distinct()


def tiles_sql(z: int) -> str:
    return f"tl as (select distinct cast({z} as bigint) as z, cast(floor((lon + 180) * {2 ** z} / 180) as bigint) as x, cast(floor((lat + 90) * {2 ** z} / 180) as bigint) as y from probes)"


def lattice_sql(z: int, n: int, shift, step: str, name: str = "lat") -> str:
    a = 180 / 2 ** z
    sx, sy = shift
    return f"""{name} as (select z, x, y, col, row, (x * {a}e0 - 180) + {a}e0 / {step} * (col + {sx}) as lon, (y * {a}e0 - 90) + {a}e0 / {step} * (row + {sy}) as lat
  from tl cross join (select range as col from range({n})) a cross join (select range as row from range({n})) b)"""


# tile rasters carry columns named col and row already, so the sampled positions use others
SAMPLED = "pt as (select z, x, y, col as tc, row as tr, lon, lat from lat)"


def tile_cover_sql(z: int, n: int, shift, step: int) -> str:
    """Positions of whole tiles with each raster over them: pairs of tiles and rasters first, then one axis, then the other."""
    a = 180 / 2 ** z
    west, south, (sx, sy) = f"(x * {a}e0 - 180)", f"(y * {a}e0 - 90)", shift
    return f"""bx as (select tl.*, r.* from tl join rasters r on w <= {west} + {a}e0 / {step} * ({n - 1} + {sx}) and w + cols * px >= {west} + {a}e0 / {step} * {sx}
  and r.n >= {south} + {a}e0 / {step} * {sy} and r.n - rows * px <= {south} + {a}e0 / {step} * ({n - 1} + {sy})),
lo as (select * from (select bx.*, range as tc, {west} + {a}e0 / {step} * (range + {sx}) as lon from bx cross join range({n}) k) q where lon >= w and lon <= w + cols * px),
cov as (select *, (lon - w) / px as ux, (n - lat) / px as uy from (select lo.*, range as tr, {south} + {a}e0 / {step} * (range + {sy}) as lat from lo cross join range({n}) k) q
  where lat <= n and lat >= n - rows * px)"""


# the odd offset keeps values off the borders of rounding, where the last bit would decide
MILLI = "floor(value * 1000 + 0.123457)"
WHOLE_SQL = f"""select z, x, y, count(*) as cells, count(value) as valued, cast(sum(cast({MILLI} as bigint)) as bigint) as total,
  cast(sum(cast({MILLI} as bigint) * (tc + 1)) as bigint) as by_col, cast(sum(cast({MILLI} as bigint) * (tr + 1)) as bigint) as by_row"""


def whole_tiles(cells):
    """One row per tile: number of cells and of values, and sums of values that tell where each lies."""
    milli = F.floor(F.col("value") * 1000 + 0.123457)
    return cells.groupBy("z", "x", "y").agg(
        F.count("*").alias("cells"), F.count("value").alias("valued"), F.sum(milli).alias("total"),
        F.sum(milli * (F.col("col") + 1)).alias("by_col"), F.sum(milli * (F.col("row") + 1)).alias("by_row"))


@query("j06_tile_raster", f"""with {tiles_sql(6)}, {bilinear_sql(cover=tile_cover_sql(6, 256, (0.5, 0.5), 255))},
b as (select *, {BEST.format(k='z, x, y, tc, tr')} as k from bl)
{WHOLE_SQL} from b where k = 1 group by z, x, y""")
def j06(i):
    return whole_tiles(rasters.tile_raster(area_tiles(i, 6), i.rasters, i.cells, 256))


@query("j07_sample_tile_bilinear", """
with p as (select z, x, y, vid, lon, lat, (lon - (x * 180 / pow(2, z) - 180)) / (180 / pow(2, z)) * 16 as u, (lat - (y * 180 / pow(2, z) - 90)) / (180 / pow(2, z)) * 16 as v
           from (select z, x, y, vid, lon + 0.0013e0 as lon, lat + 0.0007e0 as lat from vertices) q),
a as (select *, least(cast(floor(u) as bigint), 16) as c0, least(cast(floor(v) as bigint), 16) as r0 from p),
f as (select a.*, i, j, least(c0 + i, 16) as cc, least(r0 + j, 16) as rr from a cross join (select a.range as i, b.range as j from range(2) a cross join range(2) b) k),
g as (select f.z, f.x, f.y, vid, u, v, c0, r0, sum(case when i = 0 and j = 0 then value end) as v00, sum(case when i = 1 and j = 0 then value end) as v10,
        sum(case when i = 0 and j = 1 then value end) as v01, sum(case when i = 1 and j = 1 then value end) as v11
      from f join tile_cells t on t.z = f.z and t.x = f.x and t.y = f.y and t.col = cc and t.row = rr group by f.z, f.x, f.y, vid, u, v, c0, r0)
select z, x, y, vid, round(case when u <= 16 and v <= 16 then (v00 * (1 - (u - c0)) + v10 * (u - c0)) * (1 - (v - r0)) + (v01 * (1 - (u - c0)) + v11 * (u - c0)) * (v - r0) end, 6) as value from g""")
def j07(i):
    p = i.vertices.select("z", "x", "y", "vid", (F.col("lon") + 0.0013).alias("lon"), (F.col("lat") + 0.0007).alias("lat"))
    return rasters.sample_tile_bilinear(p, i.tile_cells, 17).select("z", "x", "y", "vid", r(F.col("value")).alias("value"))


def overview_sql(f: int) -> str:
    return f"select file_id, {f} as factor, col // {f} as col, row // {f} as row, round(avg(value), 6) as value, count(value) as n from cells group by 1, 2, 3, 4"


@query("a03_overview", " union all ".join(overview_sql(f) for f in (2, 4, 8, 16, 32, 64)))
def a03(i):
    return rasters.overview(i.cells, [2, 4, 8, 16, 32, 64]).withColumn("value", r(F.col("value")))


WINDOW_SQL = """wd as (select file_id, wx, wy, wx * 20 as x_off, wy * 20 as y_off, least(28, cols - wx * 20) as x_size, least(28, rows - wy * 20) as y_size
  from (select *, unnest(range(cast(ceil(rows / 20) as bigint))) as wy from (select *, unnest(range(cast(ceil(cols / 20) as bigint))) as wx from rasters) q) q2)"""


@query("r03_crop", f"""with {WINDOW_SQL}
select c.file_id, wx, wy, col - x_off as col, row - y_off as row, value from cells c join wd on wd.file_id = c.file_id
where col >= x_off and col < x_off + x_size and row >= y_off and row < y_off + y_size""")
def r03(i):
    from tilewright.operators.footprints import split_windows

    return rasters.crop(i.cells, split_windows(i.rasters, 20, "far", 8))


@query("r04_reproject_nearest", """
with e as (select *, radians(w) * 6378137.0 as x0, radians(w + cols * px) * 6378137.0 as x1, asinh(tan(radians(n - rows * px))) * 6378137.0 as y0, asinh(tan(radians(n))) * 6378137.0 as y1 from rasters),
t as (select e.*, tc, tr, (degrees((x0 + (x1 - x0) / 40 * (tc + 0.5e0)) / 6378137.0) - w) / px as ux, (n - degrees(atan(sinh((y1 - (y1 - y0) / 40 * (tr + 0.5e0)) / 6378137.0)))) / px as uy
      from e cross join (select range as tc from range(40)) a cross join (select range as tr from range(40)) b)
select t.file_id, tc as col, tr as row, value from t left join cells c on c.file_id = t.file_id
  and c.col = greatest(0, least(cast(floor(ux) as bigint), cols - 1)) and c.row = greatest(0, least(cast(floor(uy) as bigint), rows - 1))""")
def r04(i):
    return projections.reproject_nearest(i.rasters, i.cells, 40, 40)


@query("r04_reproject_back", """
with m as (select file_id, cols, rows, radians(w) * 6378137.0 as x0, asinh(tan(radians(n))) * 6378137.0 as y1, radians(px) * 6378137.0 as px from rasters),
e as (select *, degrees(x0 / 6378137.0) as w, degrees((x0 + cols * px) / 6378137.0) as e, degrees(atan(sinh((y1 - rows * px) / 6378137.0))) as s, degrees(atan(sinh(y1 / 6378137.0))) as n from m),
t as (select e.*, tc, tr, (radians(w + (e - w) / 50 * (tc + 0.5e0)) * 6378137.0 - x0) / px as ux, (y1 - asinh(tan(radians(n - (n - s) / 50 * (tr + 0.5e0)))) * 6378137.0) / px as uy
      from e cross join (select range as tc from range(50)) a cross join (select range as tr from range(50)) b)
select t.file_id, tc as col, tr as row, value from t left join cells c on c.file_id = t.file_id
  and c.col = greatest(0, least(cast(floor(ux) as bigint), cols - 1)) and c.row = greatest(0, least(cast(floor(uy) as bigint), rows - 1))""")
def r04_back(i):
    """The same cells as web mercator rasters, put on a geographic lattice."""
    x, y = grid.lonlat_to_metres("w", "n")
    r = i.rasters.select("file_id", x.alias("w"), y.alias("n"), (F.radians("px") * grid.EARTH_RADIUS).alias("px"), "cols", "rows")
    return projections.reproject_nearest(r, i.cells, 50, 50, "EPSG:3857", "EPSG:4326")


@query("r05_resize_to_depth", """
with q as (select *, radians(px) * 6378137.0 / (radians(180.0 / 64) * 6378137.0 / 256) as share6, radians(px) * 6378137.0 / (radians(180.0 / 2) * 6378137.0 / 256) as sh from rasters),
d as (select *, case when sh >= 1 then cols else least(cols, greatest(24, cast(ceil(cols * sh) as bigint))) end as nc, case when sh >= 1 then rows else least(rows, greatest(24, cast(ceil(rows * sh) as bigint))) end as nr from q),
t as (select *, unnest(range(nr)) as tr from (select *, unnest(range(nc)) as tc from d) k)
select t.file_id, tc as col, tr as row, value from t left join cells c on c.file_id = t.file_id and c.col = cast(floor((tc + 0.5e0) * cols / nc) as bigint) and c.row = cast(floor((tr + 0.5e0) * rows / nr) as bigint)""")
def r05(i):
    return rasters.resize_to_depth(i.rasters, i.cells, F.lit(1))


CLEAN = "cl as (select file_id, col, row, nullif(value, 0) as value from cells)"


@query("r06_warp_near", f"""with {tiles_sql(6)}, {CLEAN}, {tile_cover_sql(6, 256, (0.5, 0.5), 256)}, {AT},
s as (select a.*, value from aa a join cl c on c.file_id = a.file_id and c.col = c0 and c.row = r0 where value is not null)
{WHOLE_SQL} from (select *, row_number() over (partition by z, x, y, tc, tr order by file_id desc) as k from s) q where k = 1 group by z, x, y""")
def r06(i):
    return whole_tiles(rasters.warp_tile(area_tiles(i, 6), i.rasters, i.cells, 256))


@query("r06_warp_bilinear", f"""with {tiles_sql(6)}, {CLEAN}, {bilinear_sql('', 'cl', tile_cover_sql(6, 256, (0.5, 0.5), 256))}
{WHOLE_SQL} from (select *, row_number() over (partition by z, x, y, tc, tr order by file_id desc) as k from bl where value is not null) q where k = 1 group by z, x, y""")
def r06_bilinear(i):
    return whole_tiles(rasters.warp_tile(area_tiles(i, 6), i.rasters, i.cells, 256, "bilinear"))


def warp_sql(value: str) -> str:
    """Source cells reduced per target cell and source; the highest source on top."""
    return f"""with {tiles_sql(2)}, {CLEAN},
p as (select c.file_id, value, w + (col + 0.5e0) * px as lon, n - (row + 0.5e0) * px as lat from cl c join rasters using (file_id)),
t as (select file_id, value, cast(2 as bigint) as z, cast(floor((lon + 180) / 45) as bigint) as x, cast(floor((lat + 90) / 45) as bigint) as y, lon, lat from p),
u as (select z, x, y, cast(floor(((lon + 180) / 45 - x) * 256) as bigint) as col, cast(floor(((lat + 90) / 45 - y) * 256) as bigint) as row, file_id, value from t),
g as (select z, x, y, col, row, file_id, {value} as value from u group by 1, 2, 3, 4, 5, 6)
select z, x, y, col, row, round(value, 6) as value from (select *, row_number() over (partition by z, x, y, col, row order by file_id desc) as k from g join tl using (z, x, y) where value is not null) q where k = 1"""


def warped(name: str):
    def build(i):
        return rasters.warp_tile(area_tiles(i, 2), i.rasters, i.cells, 256, name).withColumn("value", r(F.col("value")))

    return build


for _name, _value in (
    ("average", "avg(value)"), ("max", "max(value)"), ("min", "min(value)"), ("med", "median(value)"), ("q1", "quantile_cont(value, 0.25)"), ("q3", "quantile_cont(value, 0.75)"),
):
    query(f"r06_warp_{_name}", warp_sql(_value))(warped(_name))

query("r06_warp_mode", warp_sql("value").replace(
    "g as (select z, x, y, col, row, file_id, value as value from u group by 1, 2, 3, 4, 5, 6)",
    """n as (select z, x, y, col, row, file_id, value, count(value) as c from u group by all),
g as (select z, x, y, col, row, file_id, value from (select *, row_number() over (partition by z, x, y, col, row, file_id order by c desc, value) as k from n where value is not null) q where k = 1)""",
))(warped("mode"))


@query("r08_merge_tile_parts", """
with p as (select *, (x * 3 + y + col + row) % 4 as ordinal, case when (col + row) % 3 > 0 then value end as v from tile_cells),
q as (select z, x, y, col // 2 as col, row // 2 as row, ordinal * 10 + col % 2 * 2 + row % 2 as ordinal, v from p)
select z, x, y, col, row, v as value from (select *, row_number() over (partition by z, x, y, col, row order by case when v is null then 1 else 0 end, ordinal desc) as k from q) w where k = 1""")
def r08(i):
    ordinal = ((F.col("x") * 3 + F.col("y") + F.col("col") + F.col("row")) % 4) * 10 + F.col("col") % 2 * 2 + F.col("row") % 2
    parts = i.tile_cells.select(
        "z", "x", "y", F.floor(F.col("col") / 2).alias("col"), F.floor(F.col("row") / 2).alias("row"), ordinal.alias("ordinal"),
        F.when((F.col("col") + F.col("row")) % 3 > 0, F.col("value")).alias("value"))
    return rasters.merge_tile_parts(parts)


def pyramid_sql(z: int) -> str:
    k = 2 ** (6 - z)
    return f"select cast({z} as bigint) as z, col // {16 * k} as x, row // {16 * k} as y, col % {16 * k} // {k} as col, row % {16 * k} // {k} as row, sum(value) as total, count(*) as n from sparse_cells group by 1, 2, 3, 4, 5"


@query("r09_pyramid", " union all ".join(pyramid_sql(z) for z in range(7)))
def r09(i):
    base = i.sparse_cells.select(
        F.lit(6).cast("bigint").alias("z"), F.floor(F.col("col") / 16).alias("x"), F.floor(F.col("row") / 16).alias("y"),
        (F.col("col") % 16).alias("col"), (F.col("row") % 16).alias("row"), "value")
    return rasters.pyramid(base, 6, 0, 16)


@query("r09_point_pyramid", " union all ".join(
    f"select cast({z} as bigint) as z, col // {2 ** (10 - z)} as x, row // {2 ** (10 - z)} as y, cast(sum(n) as bigint) as n, sum(value) as total from sparse_cells group by 1, 2, 3" for z in range(11)))
def r09_points(i):
    return rasters.point_pyramid(i.sparse_cells.select(F.col("col").alias("x"), F.col("row").alias("y"), "n", F.col("value").alias("total")), 10, 0)


@query("j09_reconcile_seams", """
with g as (select x * 16 + col as gx, y * 16 + row as gy, avg(value) as m from tile_cells group by 1, 2)
select z, x, y, col, row, round(case when col in (0, 16) or row in (0, 16) then m else value end, 6) as value
from tile_cells join g on gx = x * 16 + col and gy = y * 16 + row""")
def j09(i):
    return rasters.reconcile_seams(i.tile_cells, 17).withColumn("value", r(F.col("value")))


@query("r10_heightmap", f"""with {tiles_sql(5)}, {lattice_sql(5, 65, (-0.5, 0.5), '64')}, {SAMPLED}, {bilinear_sql('pt')},
b as (select *, {BEST.format(k='z, x, y, tc, tr')} as k from bl)
select l.z, l.x, l.y, l.col, l.row, cast(trunc((round(coalesce(value, 0), 6) + 1000) * 5) as int) as stored
from lat l left join (select * from b where k = 1) b on b.z = l.z and b.x = l.x and b.y = l.y and b.tc = l.col and b.tr = l.row""")
def r10(i):
    from tilewright.functions.encoding import encode_height

    h = rasters.heightmap(area_tiles(i, 5), i.rasters, i.cells)
    return h.select("z", "x", "y", "col", "row", encode_height(r(F.col("height"))).alias("stored"))


@query("r11_heights_to_cells", """
select z, x, y, col, row, round(x * 180 / pow(2, z) - 180 + col * 180 / pow(2, z) / 16, 9) as lon, round(y * 180 / pow(2, z) - 90 + row * 180 / pow(2, z) / 16, 9) as lat, value from tile_cells""")
def r11(i):
    from tilewright.functions.encoding import encode_height

    stored = i.tile_cells.withColumn("stored", encode_height("value"))
    return rasters.heights_to_cells(stored, 17).withColumns({"lon": r(F.col("lon"), 9), "lat": r(F.col("lat"), 9)})


@query("r12_root_tile_fill", """
with t as (select set_id, x // 8 as x from tile_store where z = 3 and y // 8 = 0)
select set_id, cast(0 as bigint) as z, range as x, cast(0 as bigint) as y, 0.0e0 as height
from (select distinct set_id from tile_store) s cross join range(2) where not exists (select 1 from t where t.set_id = s.set_id and t.x = range)""")
def r12(i):
    # tiles of level 3, with the root's number in place of their own
    t = i.tile_store.select("set_id", F.when(F.col("z") == 3, 0).otherwise(F.col("z")).alias("z"), F.shiftright("x", 3).alias("x"), F.shiftright("y", 3).alias("y"))
    return rasters.root_tile_fill(t, ("set_id",))


FLAG_SQL = "case when {w} < ee and {e} > ew and {s} < en and {n} > es then {b} else 0 end"


@query("a19_child_flags", """
with ex as (select min(w) / 4 as ew, min(s) / 4 as es, max(e) / 4 as ee, max(n) / 4 as en from footprints),
t as (select set_id, z, x, y, x * 180 / pow(2, z) - 180 as w, y * 180 / pow(2, z) - 90 as s, 180 / pow(2, z) as a from tile_store)
select set_id, z, x, y, cast(case when z >= 7 then 0 else """ + " + ".join(
    FLAG_SQL.format(w=f"w + a / 2 * {dx}", e=f"w + a / 2 * {dx + 1}", s=f"s + a / 2 * {dy}", n=f"s + a / 2 * {dy + 1}", b=b)
    for dx, dy, b in ((0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8))) + " end as int) as child_flags from t cross join ex")
def a19(i):
    ext = i.footprints.agg(*[(f(c) / 4).alias(c) for f, c in ((F.min, "w"), (F.min, "s"), (F.max, "e"), (F.max, "n"))])
    return rasters.child_flags(i.tile_store.select("set_id", "z", "x", "y"), ext, 7)


@query("a19_child_flags_from_tiles", """
select z - 1 as z, x // 2 as x, y // 2 as y, cast(bit_or(1 << cast(x % 2 + 2 * (y % 2) as int)) as int) as child_flags from tile_store where z > 0 group by 1, 2, 3""")
def a19_tiles(i):
    return rasters.child_flags_from_tiles(i.tile_store)
