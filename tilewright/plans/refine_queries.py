"""Queries over adaptive mesh refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import refine

from .mesh_queries import DEVIATION_STEP, PLANE_SQL, TILE_M
from .registry import query

N = 17


def extent(i):
    return i.spark.range(1).select(*[F.lit(v).alias(k) for k, v in (("w", -180.0), ("s", -90.0), ("e", 180.0), ("n", 90.0))])


def per_tile(triangles, **more):
    """Triangles and covered area (in tiles) per tile."""
    cross = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    t = refine.owner(triangles).withColumn("doubled", F.abs(cross))
    return t.groupBy("z", "x", "y").agg(F.count("*").alias("triangles"), (F.sum("doubled") / (2.0 * refine.STEPS**2)).alias("covered"), *[v.alias(k) for k, v in more.items()])


def ecef_sql(k: int) -> str:
    v = f"(6378137.0 / sqrt(1 - 0.00669437999014 * pow(sin(radians(lat{k})), 2)))"
    return f"""({v} + h{k}) * cos(radians(lat{k})) * cos(radians(lon{k})) as ex{k}, ({v} + h{k}) * cos(radians(lat{k})) * sin(radians(lon{k})) as ey{k},
  ({v} * (1 - 0.00669437999014) + h{k}) * sin(radians(lat{k})) as ez{k}"""


def place_sql(k: int, c: str) -> str:
    return f"180.0 / pow(2, t.z) / 65536 * {c}x - 180 as lon{k}, 180.0 / pow(2, t.z) / 65536 * {c}y - 90 as lat{k}, g{k}.h as h{k}"


ROUND_INTENSITY = 20.0
HALVES = """(qx + cx) // 2 as ax, (qy + cy) // 2 as ay, ax as qx, ay as qy, case when k = 0 then qx else cx end as cx, case when k = 0 then qy else cy end as cy"""
CROSS = [f"((e{p}1 - e{p}0) * (e{q}2 - e{q}0) - (e{q}1 - e{q}0) * (e{p}2 - e{p}0))" for p, q in ("yz", "zx", "xy")]
SIDES = " and ".join(f"turn * ((lon{q} - lon{p}) * (clat - lat{p}) - (lat{q} - lat{p}) * (clon - lon{p})) >= -1e-12" for p, q in ((0, 1), (1, 2), (2, 0)))


# four rounds of splits that size alone asks for, then one in which the raster decides; marks follow each other by recursion
@query("m02_refine_once", f"""with recursive t0 as (
  select z, x, y, (x + k.ax) * 65536 as ax, (y + k.ay) * 65536 as ay, x * 65536 as qx, y * 65536 as qy, (x + 1) * 65536 as cx, (y + 1) * 65536 as cy
  from mesh_tiles cross join (select unnest([1, 0]) as ax, unnest([0, 1]) as ay) k),
{", ".join(f"t{n + 1} as (select z, x, y, {HALVES} from t{n} cross join (select unnest([0, 1]) as k) h)" for n in range(4))},
t as materialized (select * from t4),
g as (select z, x * 16 + col as gx, y * 16 + row as gy, avg(value) as h from tile_cells group by all),
p as (select t.*, {", ".join(place_sql(k, c) for k, c in enumerate("aqc"))} from t {" ".join(f"join g g{k} on g{k}.z = t.z and g{k}.gx = {c}x // 4096 and g{k}.gy = {c}y // 4096" for k, c in enumerate("aqc"))}),
e as (select *, {", ".join(ecef_sql(k) for k in range(3))}, sqrt(pow(lon1 - lon2, 2) + pow(lat1 - lat2, 2)) as longest, sign((lon1 - lon0) * (lat2 - lat0) - (lon2 - lon0) * (lat1 - lat0)) as turn from p),
f as (select *, {", ".join(f"{c} as n{k}" for k, c in zip("xyz", CROSS))}, radians((x + 0.5) * 180 / pow(2, z) - 180) as lam, radians((y + 0.5) * 180 / pow(2, z) - 90) as phi from e),
n as (select *, abs(nx * cos(phi) * cos(lam) + ny * cos(phi) * sin(lam) + nz * sin(phi)) / sqrt(nx * nx + ny * ny + nz * nz) as cosine, radians(longest) * 6378137.0 as metres from f),
cl as (select z, x, y, value, x * 180 / pow(2, z) - 180 + col * 180 / pow(2, z) / 16 as clon, y * 180 / pow(2, z) - 90 + row * 180 / pow(2, z) / 16 as clat from tile_cells),
w as (select n.z, ax, ay, qx, qy, cx, cy, any_value(metres) as metres, max(abs(value - ({PLANE_SQL})) * cosine) as deviation from n join cl using (z, x, y) where {SIDES} group by all),
flagged as materialized (select * from w where deviation > {TILE_M} / {ROUND_INTENSITY} * {DEVIATION_STEP} * (0.8 * metres / {TILE_M} + 0.2)),
legs as materialized (select z, qx + cx as u, qy + cy as v, unnest([ax + qx, ax + cx]) as lu, unnest([ay + qy, ay + cy]) as lv from t),
m as (select z, qx + cx as u, qy + cy as v from flagged union select legs.z, legs.u, legs.v from legs join m on m.z = legs.z and m.u = lu and m.v = lv),
one as (select t.z, case when m.u is null then t.ax else (qx + cx) // 2 end as ax, case when m.u is null then t.ay else (qy + cy) // 2 end as ay, case when m.u is null then qx else t.ax end as qx,
    case when m.u is null then qy else t.ay end as qy, case when m.u is null or k = 1 then cx else qx end as cx, case when m.u is null or k = 1 then cy else qy end as cy
  from t left join m on m.z = t.z and m.u = qx + cx and m.v = qy + cy cross join (select unnest([0, 1]) as k) h where k = 0 or m.u is not null),
two as (select t.z, case when m.u is null then t.ax else (qx + cx) // 2 end as ax, case when m.u is null then t.ay else (qy + cy) // 2 end as ay, case when m.u is null then qx else t.ax end as qx,
    case when m.u is null then qy else t.ay end as qy, case when m.u is null or k = 1 then cx else qx end as cx, case when m.u is null or k = 1 then cy else qy end as cy
  from one t left join m on m.z = t.z and m.u = qx + cx and m.v = qy + cy cross join (select unnest([0, 1]) as k) h where k = 0 or m.u is not null)
select z, (ax + qx + cx) // 196608 as x, (ay + qy + cy) // 196608 as y, count(*) as triangles, sum(abs((qx - ax) * (cy - ay) - (qy - ay) * (cx - ax))) / 8589934592.0e0 as covered,
  cast(sum((ax * 31 + ay * 17 + (qx + cx) * 7 + (qy + cy) * 5 + qx * cx + qy * cy) % 1000003) as bigint) as places from two group by all""")
def m02(i):
    t, _ = refine.refine_once(refine.start(i.mesh_tiles), i.tile_cells, N, extent(i), ROUND_INTENSITY, before=4)
    c = F.col
    place = (c("ax") * 31 + c("ay") * 17 + (c("bx") + c("cx")) * 7 + (c("by") + c("cy")) * 5 + c("bx") * c("cx") + c("by") * c("cy")) % 1000003
    return per_tile(t, places=F.sum(place))


def refined(i):
    """The mesh after as many rounds as it takes."""
    return refine.refine(refine.start(i.mesh_tiles), i.tile_cells, N, extent(i), rounds=None)[0]


@query("m03_refine")
def m03(i):
    return per_tile(refined(i))


@query("m03_refine_cover", "select z, x, y, 1.0e0 as covered from mesh_tiles")
def m03_cover(i):
    # whatever is split, each tile stays covered exactly once
    return per_tile(refined(i)).select("z", "x", "y", "covered")
