"""Queries that write tile bytes or tile sets and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilewright.functions.encoding import encode_height
from tilewright.operators import rasters
from tilewright.session import checkpoint_dir
from tilewright.sources import codecs, listing, sinks

from .grid_queries import r
from .mesh_queries import NORMAL_SQL, OCCLUSION_SQL, QUANT_SQL, STREAM_SQL
from .registry import query

N = 17


@query("src03_discover_recursive", """
select rel_path from listing where lower(ext) in ('.tif', '.tiff') and (folder = 'd1' or folder like 'd1/%' or folder = 'd4' or folder like 'd4/%')
  and (name || ext like '%.tif' or name || ext like '%.tiff')""")
def src03(i):
    return listing.discover(i.listing, ["d1", "d4"], recursive=True).select("rel_path")


@query("snk02_write_heightmap", f"""
select z, x, y, cast(case when count(*) = {N * N} then {N * N * 2 + 2} end as int) as bytes, count(*) as heights from tile_cells
where not ((x + y) % 5 = 0 and col = row and col > 10) group by z, x, y""")
def snk02(i):
    """Every fifth diagonal of tiles lacks heights: these come back without bytes."""
    cells = i.tile_cells.filter("not ((x + y) % 5 = 0 and col = row and col > 10)")
    w = codecs.write_heightmap_tiles(cells.withColumn("stored", encode_height("value")), None, N)
    return w.select("z", "x", "y", F.octet_length("content").alias("bytes"), "heights")


@query("src07_read_heightmap", """
select z, x, y, col, row, round(trunc((value + 1000) * 5) / 5 - 1000, 6) as value from tile_cells""")
def src07(i):
    w = codecs.write_heightmap_tiles(i.tile_cells.withColumn("stored", encode_height("value")), None, N)
    cells = codecs.heightmap_cells(codecs.read_heightmap_tiles(w, N), N)
    return cells.withColumn("value", r(F.col("value")))


@query("snk03_write_mesh", f"""with {STREAM_SQL},
c as (select z, x, y, count(distinct vid) as n, count(*) as k from st group by z, x, y)
select z, x, y, cast(88 + 4 + 6 * n + 4 + 2 * k + 16 + 2 * 36 + 5 + 2 * n as int) as bytes from c""")
def snk03(i):
    return codecs.write_mesh_tiles(i.vertices, i.triangles).select("z", "x", "y", F.octet_length("content").alias("bytes"))


@query("src08_read_mesh_vertices", f"""with {QUANT_SQL}, {STREAM_SQL},
nm as (select distinct z, x, y, vid, idx from ix)
select z, x, y, idx as vid, cast(u as int) as u, cast(v as int) as v, cast(q as int) as q from qz join nm using (z, x, y, vid)""")
def src08(i):
    tiles = codecs.read_mesh_tiles(codecs.write_mesh_tiles(i.vertices, i.triangles))
    return codecs.mesh_vertices(tiles).select("z", "x", "y", "vid", "u", "v", "q")


@query("src08_read_mesh_triangles", f"""with {STREAM_SQL}
select z, x, y, pos // 3 as tid, max(case when pos % 3 = 0 then idx end) as v0, max(case when pos % 3 = 1 then idx end) as v1, max(case when pos % 3 = 2 then idx end) as v2 from ix group by z, x, y, pos // 3""")
def src08_triangles(i):
    return codecs.mesh_triangles(codecs.read_mesh_tiles(codecs.write_mesh_tiles(i.vertices, i.triangles)))


@query("src08_read_mesh_header", f"""with {OCCLUSION_SQL},
h as (select z, x, y, cast(cast(min(h) as float) as double) as min_h, cast(cast(max(h) as float) as double) as max_h from ve group by z, x, y)
select h.z, h.x, h.y, min_h, max_h, round(center_ex, 2) as sphere_x, round(center_ey, 2) as sphere_y, round(center_ez, 2) as sphere_z, round(radius, 3) as radius,
  round(vx, 7) as occlusion_x, round(vy, 7) as occlusion_y, round(vz, 7) as occlusion_z
from h join bs on bs.z = h.z and bs.x = h.x and bs.y = h.y join oc on oc.z = h.z and oc.x = h.x and oc.y = h.y""")
def src08_header(i):
    t = codecs.read_mesh_tiles(codecs.write_mesh_tiles(i.vertices, i.triangles))
    three = [(f"{n}_{a}", F.col(n)[k], d) for n, d in (("sphere", 2), ("occlusion", 7)) for k, a in enumerate("xyz")]
    return t.select("z", "x", "y", "min_h", "max_h", r(F.col("radius"), 3).alias("radius"), *[r(v, d).alias(n) for n, v, d in three])


@query("src08_read_mesh_normals", f"""with {STREAM_SQL}, {NORMAL_SQL},
nm as (select distinct z, x, y, vid, idx from ix),
ne as (select z, x, y, unnest([v0, v1, v2]) as vid, nx, ny, nz from fu),
ns as (select z, x, y, vid, sum(nx) as a, sum(ny) as b, sum(nz) as c from ne group by all),
np as (select z, x, y, vid, c, a / (abs(a) + abs(b) + abs(c)) as u, b / (abs(a) + abs(b) + abs(c)) as v from ns),
nq as (select z, x, y, vid, case when c < 0 then (1 - abs(v)) * (case when u < 0 then -1 else 1 end) else u end as u, case when c < 0 then (1 - abs(u)) * (case when v < 0 then -1 else 1 end) else v end as v from np)
select z, x, y, cast(idx as bigint) as vid, cast(round((u * 0.5 + 0.5) * 255) as int) as ox, cast(round((v * 0.5 + 0.5) * 255) as int) as oy from nq join nm using (z, x, y, vid)""")
def src08_normals(i):
    t = codecs.read_mesh_tiles(codecs.write_mesh_tiles(i.vertices, i.triangles))
    e = t.select("z", "x", "y", F.posexplode(F.arrays_zip("ox", "oy")).alias("vid", "p"))
    return e.select("z", "x", "y", F.col("vid").cast("bigint").alias("vid"), "p.ox", "p.oy")


@query("src09_inflate", "select set_id, path, size % 200 = 0 as inflated, path as body from tile_store")
def src09(i):
    store = i.tile_store.withColumn("content", F.col("path").cast("binary"))
    packed = codecs.deflate(store.filter("size % 200 = 0")).unionByName(store.filter("size % 200 <> 0"))
    return codecs.inflate(packed).select("set_id", "path", "inflated", F.col("content").cast("string").alias("body"))


@query("snk01_write_tiles", "select set_id, z, x, y, size from tile_store where x < pow(2, z) and y < pow(2, z)")
def snk01(i):
    path = f"{checkpoint_dir(i.spark)}/tiles-{uuid.uuid4().hex}"
    sinks.write_tiles(i.tile_store, path)
    return sinks.read_tiles(i.spark, path).select("set_id", "z", "x", "y", "size")


@query("r11_heightmap_to_cells", """
select z, x, y, col, row, round(x * 180 / pow(2, z) - 180 + col * 180 / pow(2, z) / 16, 9) as lon, round(y * 180 / pow(2, z) - 90 + row * 180 / pow(2, z) / 16, 9) as lat, value from tile_cells""")
def r11_bytes(i):
    w = codecs.write_heightmap_tiles(i.tile_cells.withColumn("stored", encode_height("value")), None, N)
    cells = codecs.heightmap_cells(codecs.read_heightmap_tiles(w, N), N).withColumn("stored", encode_height("value"))
    return rasters.heights_to_cells(cells, N).withColumns({"lon": r(F.col("lon"), 9), "lat": r(F.col("lat"), 9), "value": r(F.col("value"))})
