"""Queries over terrain meshes and RTIN lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import mesh, rtin
from tilewright.operators.index import union_extent

from .grid_queries import r
from .registry import query

V = "(6378137.0 / sqrt(1 - 0.00669437999014 * pow(sin(radians(lat)), 2)))"
ECEF_SQL = f"""ve as (select *, ({V} + h) * cos(radians(lat)) * cos(radians(lon)) as ex, ({V} + h) * cos(radians(lat)) * sin(radians(lon)) as ey,
  ({V} * (1 - 0.00669437999014) + h) * sin(radians(lat)) as ez from vertices)"""


def corners_sql(source: str, cols: list[str]) -> str:
    picks = ", ".join(f"p{k}.{c} as {c}{k}" for k in range(3) for c in cols)
    joins = " ".join(f"join {source} p{k} on p{k}.z = t.z and p{k}.x = t.x and p{k}.y = t.y and p{k}.vid = t.v{k}" for k in range(3))
    return f"select t.*, {picks} from triangles t {joins}"


@query("a15_mesh_header", f"""with {ECEF_SQL}
select z, x, y, count(*) as vertices, min(h) as min_h, max(h) as max_h, """ + ", ".join(
    f"round(min({c}), 3) as min_{c}, round(max({c}), 3) as max_{c}, round((min({c}) + max({c})) / 2, 3) as center_{c}" for c in ("ex", "ey", "ez")) + " from ve group by z, x, y")
def a15(i):
    h = mesh.mesh_header(i.vertices)
    return h.select("z", "x", "y", "vertices", "min_h", "max_h", *[r(F.col(f"{n}_{c}"), 3).alias(f"{n}_{c}") for c in ("ex", "ey", "ez") for n in ("min", "max", "center")])


def dist(a, b):
    return "sqrt(" + " + ".join(f"pow({x} - {y}, 2)" for x, y in zip(a, b)) + ")"


AXES = ("ex", "ey", "ez")
SPHERE_SQL = ECEF_SQL + ", lh as (select z, x, y, " + ", ".join(
    f"arg_{f}({{'ex': ex, 'ey': ey, 'ez': ez}}, {{'a': round({c}, 6), 'b': vid}}) as {n}{c[1]}" for c in AXES for f, n in (("min", "l"), ("max", "h"))) + """ from ve group by z, x, y),
sp as (select *, """ + ", ".join(dist([f"l{c[1]}.{a}" for a in AXES], [f"h{c[1]}.{a}" for a in AXES]) + f" as s{c[1]}" for c in AXES) + """ from lh),
wd as (select *, case when sx >= sy and sx >= sz then lx when sy >= sz then ly else lz end as lo, case when sx >= sy and sx >= sz then hx when sy >= sz then hy else hz end as hi from sp),
ct as (select z, x, y, """ + ", ".join(f"(l{c[1]}.{c} + h{c[1]}.{c}) / 2 as b{c}, (lo.{c} + hi.{c}) / 2 as m{c}" for c in AXES) + """ from wd),
rd as (select z, x, y, bex, bey, bez, mex, mey, mez, max(""" + dist(AXES, ["b" + c for c in AXES]) + ") as rb, max(" + dist(AXES, ["m" + c for c in AXES]) + """) as rm
       from ve join ct using (z, x, y) group by all),
bs as (select z, x, y, """ + ", ".join(f"case when rm < rb then m{c} else b{c} end as center_{c}" for c in AXES) + ", least(rm, rb) as radius from rd)"


@query("a16_bounding_sphere", f"with {SPHERE_SQL} select z, x, y, round(center_ex, 2) as center_ex, round(center_ey, 2) as center_ey, round(center_ez, 2) as center_ez, round(radius, 3) as radius from bs")
def a16(i):
    s = mesh.bounding_sphere(i.vertices)
    return s.select("z", "x", "y", *[r(F.col("center_" + c), 2).alias("center_" + c) for c in AXES], r(F.col("radius"), 3).alias("radius"))


OCCLUSION_SQL = f"""{SPHERE_SQL},
op as (select z, x, y, ex / 6378137.0 as a, ey / 6378137.0 as b, ez / 6356752.3142451793 as c, center_ex / 6378137.0 as ca, center_ey / 6378137.0 as cb, center_ez / 6356752.3142451793 as cc from ve join bs using (z, x, y)),
om as (select *, sqrt(a*a + b*b + c*c) as mag from op),
od as (select *, a / mag as da, b / mag as db, c / mag as dc, greatest(1, mag) as g from om),
ov as (select *, 1 / ((da*ca + db*cb + dc*cc) / g - sqrt(pow(db*cc - dc*cb, 2) + pow(dc*ca - da*cc, 2) + pow(da*cb - db*ca, 2)) * sqrt(greatest(1, mag * mag) - 1) / g) as v from od),
oc as (select z, x, y, max(v) as magnitude, ca * max(v) as vx, cb * max(v) as vy, cc * max(v) as vz from ov group by z, x, y, ca, cb, cc)"""


@query("a17_horizon_occlusion", f"""with {OCCLUSION_SQL}
select z, x, y, round(magnitude, 8) as magnitude, round(vx, 7) as occlusion_x, round(vy, 7) as occlusion_y, round(vz, 7) as occlusion_z from oc""")
def a17(i):
    o = mesh.horizon_occlusion(i.vertices, mesh.bounding_sphere(i.vertices))
    named = [F.col(c) for c in o.columns if c.startswith("occlusion_")]
    return o.select("z", "x", "y", r(F.col("magnitude"), 8).alias("magnitude"), *[r(c, 7).alias(n) for c, n in zip(named, ("occlusion_x", "occlusion_y", "occlusion_z"))])


NORMAL_SQL = f"""{ECEF_SQL}, tc as ({corners_sql('ve', list(AXES))}),
fn as (select *, (ey1-ey0)*(ez2-ez0) - (ez1-ez0)*(ey2-ey0) as nx, (ez1-ez0)*(ex2-ex0) - (ex1-ex0)*(ez2-ez0) as ny, (ex1-ex0)*(ey2-ey0) - (ey1-ey0)*(ex2-ex0) as nz from tc),
fu as (select z, x, y, tid, v0, v1, v2, nx / sqrt(nx*nx+ny*ny+nz*nz) as nx, ny / sqrt(nx*nx+ny*ny+nz*nz) as ny, nz / sqrt(nx*nx+ny*ny+nz*nz) as nz, sqrt(nx*nx+ny*ny+nz*nz) / 2 as area from fn)"""


def vertex_normal_sql(weight: str) -> str:
    return f"""with {NORMAL_SQL},
e as (select z, x, y, unnest([v0, v1, v2]) as vid, nx * {weight} as nx, ny * {weight} as ny, nz * {weight} as nz from fu),
s as (select z, x, y, vid, sum(nx) as nx, sum(ny) as ny, sum(nz) as nz from e group by all)
select z, x, y, vid, round(nx / sqrt(nx*nx+ny*ny+nz*nz), 7) as nx, round(ny / sqrt(nx*nx+ny*ny+nz*nz), 7) as ny, round(nz / sqrt(nx*nx+ny*ny+nz*nz), 7) as nz from s"""


def rounded_normals(df):
    return df.withColumns({k: r(F.col(k), 7) for k in ("nx", "ny", "nz")})


@query("a18_vertex_normals", vertex_normal_sql("1"))
def a18(i):
    return rounded_normals(mesh.vertex_normals(i.triangles, i.vertices))


@query("a18_vertex_normals_area", vertex_normal_sql("area"))
def a18_area(i):
    return rounded_normals(mesh.vertex_normals(i.triangles, i.vertices, "area"))


@query("a22_bucket_faces", """
with p as (select lon, lat, h from points)
select greatest(0, least(31, cast(floor((lon + 180) / 360 * 32) as bigint))) as ox, greatest(0, least(31, cast(floor((lat + 90) / 180 * 32) as bigint))) as oy,
       greatest(0, least(31, cast(floor((h + 1000) / 11000 * 32) as bigint))) as oz, count(*) as points from p group by 1, 2, 3""")
def a22(i):
    p = i.points.select(F.col("lon").alias("px"), F.col("lat").alias("py"), F.col("h").alias("pz"))
    return mesh.bucket_faces(p, 5, (-180.0, -90.0, -1000.0), (180.0, 90.0, 10000.0))


SIZED_SQL = f"""tc as ({corners_sql('vertices', ['lon', 'lat', 'h'])}),
sz as (select *, abs((lon1-lon0)*(lat2-lat0) - (lon2-lon0)*(lat1-lat0)) / 2 as area,
  greatest(sqrt(pow(lon0-lon1,2)+pow(lat0-lat1,2)), sqrt(pow(lon1-lon2,2)+pow(lat1-lat2,2)), sqrt(pow(lon2-lon0,2)+pow(lat2-lat0,2))) as longest from tc)"""


@query("a23_triangle_stats", f"""with {SIZED_SQL}
select z, x, y, count(*) as triangles, round(sum(area), 9) as area, round(max(longest), 9) as longest_edge, round(max(radians(longest) * 6378137.0), 4) as largest_metres from sz group by z, x, y""")
def a23(i):
    s = mesh.triangle_stats(i.triangles, i.vertices)
    return s.withColumns({"area": r(F.col("area"), 9), "longest_edge": r(F.col("longest_edge"), 9), "largest_metres": r(F.col("largest_metres"), 4)})


@query("j14_edge_adjacency", """
with e as (select z, x, y, tid, unnest([{'p': least(v0, v1), 'q': greatest(v0, v1)}, {'p': least(v1, v2), 'q': greatest(v1, v2)}, {'p': least(v0, v2), 'q': greatest(v0, v2)}]) as e from triangles)
select z, x, y, e.p as p, e.q as q, count(*) as faces, min(tid) as tid, case when count(*) > 1 then max(tid) end as twin from e group by z, x, y, e.p, e.q""")
def j14(i):
    return mesh.edge_adjacency(i.triangles)


PLANE_SQL = """h0 + (((clon - lon0) * (lat2 - lat0) - (clat - lat0) * (lon2 - lon0)) * (h1 - h0) + ((lon1 - lon0) * (clat - lat0) - (lat1 - lat0) * (clon - lon0)) * (h2 - h0))
  / ((lon1 - lon0) * (lat2 - lat0) - (lon2 - lon0) * (lat1 - lat0))"""

DEVIATION_STEP = "case when z < 5 then 0.01 when z <= 8 then 0.015 when z = 9 then 0.02 when z = 10 then 0.03 when z = 11 then 0.04 when z = 12 then 0.05 when z <= 15 then 0.06 when z = 16 then 0.065 else 0.07 end"
TILE_M = "(radians(180.0 / pow(2, z)) * 6378137.0)"


@query("j12_triangle_deviation", f"""with {NORMAL_SQL.replace('tc as', 'tce as').replace('from tc)', 'from tce)')}, {SIZED_SQL},
cs as (select z, x, y, tid, abs(nx * cos(radians((y + 0.5) * 180 / pow(2, z) - 90)) * cos(radians((x + 0.5) * 180 / pow(2, z) - 180))
   + ny * cos(radians((y + 0.5) * 180 / pow(2, z) - 90)) * sin(radians((x + 0.5) * 180 / pow(2, z) - 180)) + nz * sin(radians((y + 0.5) * 180 / pow(2, z) - 90))) as c from fu),
cl as (select z, x, y, value, x * 180 / pow(2, z) - 180 + col * 180 / pow(2, z) / 16 as clon, y * 180 / pow(2, z) - 90 + row * 180 / pow(2, z) / 16 as clat from tile_cells),
hit as (select sz.*, c, value, clon, clat from sz join cs using (z, x, y, tid) join cl using (z, x, y)
  where clon >= least(lon0, lon1, lon2) - 1e-10 and clon <= greatest(lon0, lon1, lon2) + 1e-10 and clat >= least(lat0, lat1, lat2) - 1e-10 and clat <= greatest(lat0, lat1, lat2) + 1e-10
    and ((lon1-lon0)*(clat-lat0) - (lat1-lat0)*(clon-lon0)) >= -1e-12 and ((lon2-lon1)*(clat-lat1) - (lat2-lat1)*(clon-lon1)) >= -1e-12 and ((lon0-lon2)*(clat-lat2) - (lat0-lat2)*(clon-lon2)) >= -1e-12),
w as (select z, x, y, tid, max(abs(value - ({PLANE_SQL})) * case when z > 10 then c else 1 end) as deviation, max(radians(longest) * 6378137.0) as metres from hit group by z, x, y, tid),
l as (select *, {TILE_M} / 4 * {DEVIATION_STEP} * (0.8 * metres / {TILE_M} + 0.2) as lim from w)
select z, x, y, tid, round(deviation, 5) as deviation, round(lim, 5) as "limit", deviation > lim as exceeds from l""")
def j12(i):
    d = mesh.triangle_deviation(i.triangles, i.vertices, i.tile_cells, 17)
    return d.withColumns({"deviation": r(F.col("deviation"), 5), "limit": r(F.col("limit"), 5)})


@query("f09_must_refine", f"""with {SIZED_SQL},
ex as (select min(w) / 4 as ew, min(s) as es, max(e) / 4 as ee, 0.5e0 - 90 as en from footprints),
m as (select *, radians(longest) * 6378137.0 as metres, greatest(greatest(lon0, lon1, lon2) - least(lon0, lon1, lon2), greatest(lat0, lat1, lat2) - least(lat0, lat1, lat2)) as box from sz)
select z, x, y, tid, case when metres < {TILE_M} * 0.1 / 4 * 1.25 then false when metres > {TILE_M} / 2.5 then true
  when least(lon0, lon1, lon2) > ee or greatest(lon0, lon1, lon2) < ew or least(lat0, lat1, lat2) > en or greatest(lat0, lat1, lat2) < es
  then greatest(h0, h1, h2) > {TILE_M} / 4 * {DEVIATION_STEP} * (0.8 * radians(box) * 6378137.0 / {TILE_M} + 0.2) end as refine
from m cross join ex""")
def f09(i):
    e = union_extent(i.footprints).select((F.col("w") / 4).alias("w"), "s", (F.col("e") / 4).alias("e"), F.lit(-89.5).alias("n"))
    return mesh.must_refine(mesh.triangle_sizes(i.triangles, i.vertices), e).select("z", "x", "y", "tid", "refine")


@query("m01_initial_mesh", """
with c as (select z, x, y, unnest([0, 1, 2, 3]) as k from mesh_tiles),
v as (select z, x, y, cast(k as bigint) as vid, (x + case when k in (1, 2) then 1 else 0 end) * 180 / pow(2, z) - 180 as lon, (y + case when k in (2, 3) then 1 else 0 end) * 180 / pow(2, z) - 90 as lat,
             case when k in (1, 2) then 16 else 0 end as col, case when k in (2, 3) then 16 else 0 end as row from c)
select v.z, v.x, v.y, vid, lon, lat, t.value as h, f.tid from v join tile_cells t on t.z = v.z and t.x = v.x and t.y = v.y and t.col = v.col and t.row = v.row
join (select cast(unnest([0, 0, 0, 1, 1, 1]) as bigint) as tid, unnest([0, 1, 2, 0, 2, 3]) as fv) f on f.fv = vid""")
def m01(i):
    v, t = mesh.initial_mesh(i.mesh_tiles, i.tile_cells, 17)
    c = t.select("z", "x", "y", "tid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    return v.join(c.hint("merge"), ["z", "x", "y", "vid"])


@query("m04_refresh_elevation", """
select v.z, v.x, v.y, vid, value as h from vertices v join tile_cells t on t.z = v.z and t.x = v.x and t.y = v.y and t.col = 2 * i and t.row = 2 * j""")
def m04(i):
    return mesh.refresh_elevation(i.vertices, i.tile_cells, 17).select("z", "x", "y", "vid", "h")


CHILD_SQL = """oc as (select z, x, y, tid, v0, v1, v2, z + 1 as child_z, 2 * x + case when (v0 % 9 + v1 % 9 + v2 % 9) / 3 >= 4 then 1 else 0 end as child_x,
  2 * y + case when (v0 // 9 + v1 // 9 + v2 // 9) / 3 >= 4 then 1 else 0 end as child_y from triangles)"""


@query("m05_to_children", f"with {CHILD_SQL} select z, x, y, tid, child_z, child_x, child_y from oc")
def m05(i):
    return mesh.to_children(i.triangles, i.vertices)


@query("u06_split_to_sets", f"""with {CHILD_SQL}
select child_z as z, child_x as x, child_y as y, row_number() over (partition by child_z, child_x, child_y order by x, y, tid) - 1 as tid, v0, v1, v2 from oc""")
def u06(i):
    return mesh.split_to_sets(i.triangles, mesh.to_children(i.triangles, i.vertices))


@query("m06_clamp_edges", """
select z, x, y, vid, case when i in (0, 8) then -180 + (x + i / 8) * 180 / pow(2, z) else lon + 3e-7 end as lon, case when j in (0, 8) then -90 + (y + j / 8) * 180 / pow(2, z) else lat - 2e-7 end as lat from vertices""")
def m06(i):
    off = i.vertices.withColumns({"lon": F.col("lon") + 3e-7, "lat": F.col("lat") - 2e-7})
    return mesh.clamp_edges(off).select("z", "x", "y", "vid", "lon", "lat")


QUANT_SQL = """qz as (select z, x, y, vid, cast(floor(i / 8 * 32767 + 0.5) as bigint) as u, cast(floor(j / 8 * 32767 + 0.5) as bigint) as v,
  cast(floor((h - min(h) over w) / (case when max(h) over w = min(h) over w then 1 else max(h) over w - min(h) over w end) * 32767 + 0.5) as bigint) as q from vertices window w as (partition by z, x, y))"""


def quantized(i):
    return mesh.quantize(i.vertices).select("z", "x", "y", "vid", "u", "v", "q")


@query("m07_quantize", f"with {QUANT_SQL} select * from qz")
def m07(i):
    return quantized(i)


WELD_SQL = """wk as (select *, min(vid) over (partition by z, x, y, (i + 1) // 2, (j + 1) // 2) as w from vertices)"""


@query("m08_weld_vertices", f"""with {WELD_SQL}
select t.z, t.x, t.y, tid, a.w as v0, b.w as v1, c.w as v2 from triangles t
join wk a on a.z = t.z and a.x = t.x and a.y = t.y and a.vid = v0 join wk b on b.z = t.z and b.x = t.x and b.y = t.y and b.vid = v1
join wk c on c.z = t.z and c.x = t.x and c.y = t.y and c.vid = v2 where a.w <> b.w and b.w <> c.w and c.w <> a.w""")
def m08(i):
    # two lattice steps of a tile wide, so that four vertices fall together
    kept, faces = mesh.weld_vertices(i.vertices.withColumns({"lon": F.col("i") * 1.0, "lat": F.col("j") * 1.0}), i.triangles, 2.0)
    return faces


@query("m08_weld_kept", f"with {WELD_SQL} select z, x, y, vid from wk where vid = w")
def m08_kept(i):
    kept, _ = mesh.weld_vertices(i.vertices.withColumns({"lon": F.col("i") * 1.0, "lat": F.col("j") * 1.0}), i.triangles, 2.0)
    return kept.select("z", "x", "y", "vid")


@query("m09_plane_height", f"""with {SIZED_SQL}, c as (select *, (lon0 * 2 + lon1 + lon2) / 4 as clon, (lat0 * 2 + lat1 + lat2) / 4 as clat from sz)
select z, x, y, tid, round((2 * h0 + h1 + h2) / 4, 5) as height from c""")
def m09(i):
    s = mesh.triangle_sizes(i.triangles, i.vertices)
    lon, lat = ((F.col(c + "0") * 2 + F.col(c + "1") + F.col(c + "2")) / 4 for c in ("lon", "lat"))
    return s.select("z", "x", "y", "tid", r(mesh.plane_height(lon, lat), 5).alias("height"))


def fold(c: str) -> str:
    d = f"({c} - coalesce(lag({c}) over w, 0))"
    return f"case when {d} < 0 then -2 * {d} - 1 else 2 * {d} end as d{c}"


@query("w04_delta_encode", f"with {QUANT_SQL} select z, x, y, vid, {fold('u')}, {fold('v')}, {fold('q')} from qz window w as (partition by z, x, y order by vid)")
def w04(i):
    return mesh.delta_encode(quantized(i))


STREAM_SQL = """st as (select z, x, y, tid * 3 + k as pos, case k when 0 then v0 when 1 then v1 else v2 end as vid from triangles cross join (select range as k from range(3)) kk),
fs as (select *, min(pos) over (partition by z, x, y, vid) as f from st),
ix as (select z, x, y, pos, vid, dense_rank() over (partition by z, x, y order by f) - 1 as idx from fs),
hw as (select z, x, y, pos, coalesce(max(idx) over (partition by z, x, y order by pos rows between unbounded preceding and 1 preceding) + 1, 0) - idx as code from ix)"""


@query("w05_highwater_encode", f"with {STREAM_SQL} select * from hw")
def w05(i):
    return mesh.highwater_encode(mesh.index_stream(i.triangles))


@query("w06_delta_decode", f"with {QUANT_SQL} select * from qz")
def w06(i):
    return mesh.delta_decode(mesh.delta_encode(quantized(i)))


@query("w06_highwater_decode", f"with {STREAM_SQL} select z, x, y, pos, idx from ix")
def w06_highwater(i):
    return mesh.highwater_decode(mesh.highwater_encode(mesh.index_stream(i.triangles)))


@query("w07_edge_vertices", """
with e as (select z, x, y, vid, 'west' as side, -j as o from vertices where i = 0 union all select z, x, y, vid, 'south', i from vertices where j = 0
  union all select z, x, y, vid, 'east', j from vertices where i = 8 union all select z, x, y, vid, 'north', -i from vertices where j = 8)
select z, x, y, side, vid, cast(row_number() over (partition by z, x, y, side order by o) - 1 as int) as place from e""")
def w07(i):
    return mesh.edge_vertices(quantized(i))


# RTIN -----------------------------------------------------------------------------------------

N = 17


def arrays(i):
    return rtin.tile_arrays(i.tile_cells, N)


def edges_sql() -> str:
    """Every lattice vertex with the ends of the edge it splits, found by halving triangles."""
    return """tri(ax, ay, rx, ry, lx, ly) as (
  select 16, 0, 16, 16, 0, 0 union all select 0, 16, 0, 0, 16, 16
  union all
  select (rx + lx) // 2, (ry + ly) // 2, case when k = 0 then ax else lx end, case when k = 0 then ay else ly end, case when k = 0 then rx else ax end, case when k = 0 then ry else ay end
  from tri cross join (select range as k from range(2)) kk where abs(lx - rx) > 1 or abs(ly - ry) > 1),
ends as (select distinct (rx + lx) // 2 as c, (ry + ly) // 2 as r, least(rx, lx) as c1, case when rx < lx then ry when rx > lx then ly else least(ry, ly) end as r1,
  greatest(rx, lx) as c2, case when rx < lx then ly when rx > lx then ry else greatest(ry, ly) end as r2 from tri where abs(lx - rx) > 1 or abs(ly - ry) > 1),
er as (select m.z, m.x, m.y, m.col, m.row, abs(m.value - 0.5e0 * (a.value + b.value)) as err from tile_cells m join ends e on m.col = e.c and m.row = e.r
  join tile_cells a on a.z = m.z and a.x = m.x and a.y = m.y and a.col = e.c1 and a.row = e.r1 join tile_cells b on b.z = m.z and b.x = m.x and b.y = m.y and b.col = e.c2 and b.row = e.r2)"""


def unpacked(df, column: str, name: str):
    e = df.select("z", "x", "y", F.posexplode(column).alias("k", name))
    return e.select("z", "x", "y", (F.col("k") % N).cast("bigint").alias("col"), F.floor(F.col("k") / N).alias("row"), name)


@query("r13_rtin_error", f"""with recursive {edges_sql()}
select z, x, y, col, row, err as error from er union all select z, x, y, col, row, 0.0e0 from tile_cells where col in (0, 16) and row in (0, 16)""")
def r13(i):
    return unpacked(rtin.rtin_error(arrays(i), N), "errors", "error")


LIMIT = "(6378137.0 * 2 * pi() * 0.25 * 0.02 / (17 * 2) / pow(2, z))"
LEVELS_SQL = f"""{edges_sql()},
lv as (select z, x, y, col, row, case when err >= {LIMIT} then cast(floor(log2(err / {LIMIT}) + 0.5) as int) else -1 end as level from er
  union all select z, x, y, col, row, 0 from tile_cells where col in (0, 16) and row in (0, 16))"""


def activation(i):
    return rtin.rtin_activation(rtin.rtin_error(arrays(i), N), N, 0.02)


@query("r13_rtin_activation", f"with recursive {LEVELS_SQL} select * from lv")
def r13_activation(i):
    return unpacked(activation(i), "levels", "level")


def propagate_sql(last: str = "lv", p: str = "") -> str:
    """Four steps of propagation from the levels in ``last`` to those in ``<p>c3``."""
    steps = []
    for k in range(4):
        half, q = 2 ** k, 2 ** k // 2
        if q:
            near = " union all ".join(f"select z, x, y, col + {a * q}, row + {b * q}, level from {last} where col % {half} = {q} and row % {half} = {q}" for a in (-1, 1) for b in (-1, 1))
            steps.append(f"{p}n{k} as (select z, x, y, col, row, max(level) as m from ({near}) q(z, x, y, col, row, level) group by all)")
            steps.append(f"{p}e{k} as (select b.z, b.x, b.y, b.col, b.row, case when b.col % {half} = 0 and b.row % {half} = 0 and (b.col // {half} + b.row // {half}) % 2 = 1 then greatest(level, coalesce(m, -1)) else level end as level from {last} b left join {p}n{k} using (z, x, y, col, row))")
            last = f"{p}e{k}"
        near = " union all ".join(f"select z, x, y, col + {a * half}, row + {b * half}, level from {last}" for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)))
        steps.append(f"{p}m{k} as (select z, x, y, col, row, max(level) as m from ({near}) q(z, x, y, col, row, level) group by all)")
        steps.append(f"{p}c{k} as (select b.z, b.x, b.y, b.col, b.row, case when b.col % {2 * half} = {half} and b.row % {2 * half} = {half} then greatest(level, coalesce(m, -1)) else level end as level from {last} b left join {p}m{k} using (z, x, y, col, row))")
        last = f"{p}c{k}"
    return ",\n".join(steps)


@query("r14_rtin_propagate", f"with recursive {LEVELS_SQL}, {propagate_sql()} select z, x, y, col, row, level from c3")
def r14(i):
    return unpacked(rtin.rtin_propagate(activation(i), N), "levels", "level")


@query("r15_border_activation", f"""with recursive {LEVELS_SQL}, {propagate_sql()},
g as (select z, x * 16 + col as gx, y * 16 + row as gy, x, y, col, row, level from c3),
nb as (select a.z, a.x, a.y, a.col, a.row, max(b.level) as m from g a join g b on a.z = b.z and a.gx = b.gx and a.gy = b.gy and abs(a.x - b.x) + abs(a.y - b.y) = 1 group by all),
raised as (select z, x, y, col, row, case when z > 6 then greatest(level, coalesce(m, -1)) else level end as level from c3 left join nb using (z, x, y, col, row)),
{propagate_sql("raised", "q")} select z, x, y, col, row, level from qc3""")
def r15(i):
    return unpacked(rtin.border_activation(activation(i), N), "levels", "level")
