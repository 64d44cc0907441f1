"""Queries over the scalar functions: parsing, formatting, geodesy and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import encoding, geodesy, text
from tilewright.operators import metadata

from .grid_queries import r
from .registry import query

DMS_SQL = """(try_cast(regexp_extract({t}, '(\\d+)d\\s*(\\d+)''(\\d+\\.?\\d*)"([EWNS])', 1) as double)
 + try_cast(regexp_extract({t}, '(\\d+)d\\s*(\\d+)''(\\d+\\.?\\d*)"([EWNS])', 2) as double) / 60
 + try_cast(regexp_extract({t}, '(\\d+)d\\s*(\\d+)''(\\d+\\.?\\d*)"([EWNS])', 3) as double) / 3600)
 * (case when regexp_extract({t}, '(\\d+)d\\s*(\\d+)''(\\d+\\.?\\d*)"([EWNS])', 4) in ('W', 'S') then -1 else 1 end)"""


def corner_sql(kind: str, alias: tuple[str, str]) -> str:
    dms = [DMS_SQL.format(t=f"split_part(split_part(line, ')', 2), ',', {k})") for k in (1, 2)]
    num = [f"try_cast(trim(regexp_replace(split_part(split_part(split_part(line, '(', 2), ')', 1), ',', {k}), '[^0-9.-]', '', 'g')) as double)" for k in (1, 2)]
    return "\n".join(
        f", max(case when line like '{kind}%' then case when projected then {d} else {n} end end) as {a}"
        for d, n, a in zip(dms, num, alias)
    )


BOUNDS_SQL = f"""bt as (
  select file_id {corner_sql('Upper Left', ('west', 'north'))} {corner_sql('Lower Right', ('east', 'south'))}
  from (select *, max(case when line like 'PROJCS[%' then 1 else 0 end) over (partition by file_id) = 1 as projected
        from meta_text) q
  where line like 'Upper Left%' or line like 'Lower Right%' group by file_id)"""


@query("p01_bounds_from_text", f"""
with {BOUNDS_SQL}
select file_id, round(west, 6) as west, round(south, 6) as south, round(east, 6) as east, round(north, 6) as north,
       round(case when east < west then east - west + 360 else east - west end, 6) as width_deg,
       round(abs(north - south), 6) as height_deg from bt""")
def p01(i):
    b = metadata.bounds_from_text(i.meta_text)
    return b.select("file_id", *[r(F.col(c)).alias(c) for c in ("west", "south", "east", "north", "width_deg", "height_deg")])


@query("p02_dms_to_deg", f"""
select file_id, line_no, round({DMS_SQL.format(t="split_part(line, ') (', 2)")}, 8) as lon,
       round({DMS_SQL.format(t="split_part(split_part(line, ') (', 2), ',', 2)")}, 8) as lat
from meta_text where line like '%d30%'""")
def p02(i):
    second = F.split_part(F.col("line"), F.lit(") ("), F.lit(2))
    return i.meta_text.filter(F.col("line").contains("d30")).select(
        "file_id", "line_no", r(text.dms_to_deg(second), 8).alias("lon"),
        r(text.dms_to_deg(F.split_part(second, F.lit(","), F.lit(2))), 8).alias("lat"),
    )


@query("p03_classify_crs", """
with t as (select file_id, string_agg(line, chr(10) order by line_no) as body from meta_text group by file_id)
select file_id,
       case when body like '%GEOGCS["WGS 84"%' and body not like '%PROJCS[%' then 'geographic'
            when body like '%Pseudo-Mercator%' then 'webMercator' when body like '%PROJCS[%UTM%' then 'utm'
            when body like '%PROJCS[%' then 'customProjected' else 'unknown' end as crs_type,
       case when body like '%GEOGCS["WGS 84"%' and body not like '%PROJCS[%' then '4326'
            when body like '%Pseudo-Mercator%' then '3857' end as epsg,
       try_cast(nullif(regexp_extract(body, 'UTM Zone (\\d+)', 1), '') as int) as zone,
       case when body like '%PROJCS[%' and body not like '%UTM%' and body not like '%Mercator%'
            then regexp_extract(body, 'PROJCS\\["([^"]+)"', 1) end as crs_name,
       (body like '%GEOGCS["WGS 84"%' and body not like '%PROJCS[%') or body like '%Pseudo-Mercator%' as suitable
from t""")
def p03(i):
    body = metadata.join_lines(i.meta_text)
    return body.select("file_id", *[c.alias(n) for n, c in text.classify_crs("body").items()])


@query("p04_level0_suitable", """
select file_id, coalesce(((e - w) * 90 >= 180 and (n - s) * 90 >= 90)
       or ((e - w) * 90 / px * 10 >= 32768 and (n - s) * 90 / px * 10 >= 16384), false) as suitable
from footprints""")
def p04(i):
    w, h = (F.col("e") - F.col("w")) * 90, (F.col("n") - F.col("s")) * 90
    return i.footprints.select("file_id", text.level0_suitable(w, h, w / F.col("px") * 10, h / F.col("px") * 10).alias("suitable"))


@query("p05_recommend_config", """
with f as (select file_id, size_bytes / 1073741824.0 as gb, file_id % 2 = 0 as terrain from footprints)
select file_id, 0 as min_zoom,
       case when terrain then case when gb < 0.5 then 16 when gb < 2 then 15 when gb < 8 then 14 else 13 end
            else case when gb < 1 then 18 when gb < 5 then 16 when gb < 20 then 15 else 14 end end as max_zoom,
       case when terrain then 'terrain' when gb < 1 then 'png' else 'webp' end as tile_format,
       case when terrain then 100 when gb < 1 then 90 when gb < 5 then 85 when gb < 20 then 80 else 75 end as quality,
       case when not terrain then 'bilinear' end as resampling, not terrain and gb > 2 as create_overview
from f""")
def p05(i):
    kind = F.when(F.col("file_id") % 2 == 0, "terrain").otherwise("map")
    return i.footprints.select("file_id", *[c.alias(n) for n, c in text.recommend_config("size_bytes", kind).items()])


@query("p06_format_size", """
with f as (select file_id, size_bytes // 1000 * (file_id % 3) * (file_id % 1000) + file_id % 2000 as b, file_id * 37 % 20000 as sec from footprints)
select file_id,
       case when b < 1024 then printf('%d B', b) when b < 1048576 then printf('%.1f KB', b / 1024)
            when b < 1073741824 then printf('%.1f MB', b / 1048576) else printf('%.1f GB', b / 1073741824) end as size_text,
       case when b >= 1073741824 then (b // 1073741824) || 'GB' when b >= 1048576 then (b // 1048576) || 'MB'
            when b >= 1024 then (b // 1024) || 'KB' else b || 'bytes' end as size_whole,
       case when sec < 60 then printf('%.1f秒', sec / 1) when sec < 3600 then (sec // 60) || '分' || (sec % 60) || '秒'
            else (sec // 3600) || '小时' || (sec % 3600 // 60) || '分钟' end as duration_text,
       (case when sec >= 3600 then (sec // 3600) || 'h ' else '' end) || (case when sec % 3600 >= 60 then (sec % 3600 // 60) || 'm ' else '' end)
       || (case when sec % 60 > 0 then (sec % 60) || 's ' else '' end) || (file_id % 1000) || 'ms' as millis_text
from f""")
def p06(i):
    fid = F.col("file_id")
    f = i.footprints.select(
        "file_id",
        (F.floor(F.col("size_bytes") / 1000) * (fid % 3) * (fid % 1000) + fid % 2000).alias("b"),
        (fid * 37 % 20000).alias("sec"),
    )
    return f.select(
        "file_id", text.format_size("b").alias("size_text"), text.format_size_whole("b").alias("size_whole"),
        text.format_duration("sec").alias("duration_text"),
        text.format_millis(F.col("sec") * 1000 + fid % 1000).alias("millis_text"),
    )


@query("p07_parse_memory", """
with f as (select p_partkey, case p_partkey % 6 when 0 then p_size || 'g' when 1 then p_size || '.5M' when 2 then p_size || 'k'
                  when 3 then cast(p_size * 1000 as string) when 4 then p_size || ' bytes' else p_size || 'G' end as t from part)
select p_partkey, case when lower(right(t, 1)) = 'g' then cast(cast(left(t, -1) as double) * 1073741824 as bigint)
       when lower(right(t, 1)) = 'm' then cast(cast(left(t, -1) as double) * 1048576 as bigint)
       when lower(right(t, 1)) = 'k' then cast(cast(left(t, -1) as double) * 1024 as bigint)
       else coalesce(try_cast(t as bigint), 1073741824) end as bytes from f""")
def p07(i):
    size = F.col("p_size").cast("string")
    case = F.col("p_partkey") % 6
    t = (
        F.when(case == 0, F.concat(size, F.lit("g"))).when(case == 1, F.concat(size, F.lit(".5M")))
        .when(case == 2, F.concat(size, F.lit("k"))).when(case == 3, (F.col("p_size") * 1000).cast("string"))
        .when(case == 4, F.concat(size, F.lit(" bytes"))).otherwise(F.concat(size, F.lit("G")))
    )
    return i.table("part").select("p_partkey", text.parse_memory(t).alias("bytes"))


@query("p08_tile_path", """
select set_id, z, x, y, z || '/' || x || '_' || y || '.png' as flat, 'L' || z || '/X' || x || '/L' || z || '_X' || x || '_Y' || y || '.til' as folded,
       z as back_z, x as back_x, y as back_y, 'terrain' as ext from tile_store""")
def p08(i):
    back = text.parse_tile_path("path", "nested")
    return i.tile_store.select(
        "set_id", "z", "x", "y", text.tile_path("z", "x", "y", "flat").alias("flat"),
        text.tile_path("z", "x", "y", "folded").alias("folded"),
        *[back[k].alias(f"back_{k}") for k in "zxy"], back["ext"].alias("ext"),
    )


@query("p09_task_time", """
select event_id, case when kind = 'failed' then 0 else cast(substr(task_id, 8) as bigint) end as task_time from task_events""")
def p09(i):
    task = F.when(F.col("kind") == "failed", F.lit("terrain-x")).otherwise(F.col("task_id"))
    return i.task_events.select("event_id", text.task_time(task).alias("task_time"))


ECEF_SQL = """(6378137.0 / sqrt(1 - 0.00669437999014 * pow(sin(radians(lat)), 2)))"""


@query("p10_ecef", f"""
select pid, round(({ECEF_SQL} + h) * cos(radians(lat)) * cos(radians(lon)), 4) as ex,
       round(({ECEF_SQL} + h) * cos(radians(lat)) * sin(radians(lon)), 4) as ey,
       round(({ECEF_SQL} * (1 - 0.00669437999014) + h) * sin(radians(lat)), 4) as ez from points""")
def p10(i):
    return i.points.select("pid", *[r(c, 4).alias(n) for n, c in zip(("ex", "ey", "ez"), geodesy.ecef("lon", "lat", "h"))])


@query("p11_geographic", "select pid, round(lon, 6) as lon, round(lat, 6) as lat, round(h, 3) as h from points")
def p11(i):
    x, y, z = geodesy.ecef("lon", "lat", "h")
    e = i.points.select("pid", x.alias("ex"), y.alias("ey"), z.alias("ez"))
    return geodesy.geographic(e, "ex", "ey", "ez").select("pid", r(F.col("lon")).alias("lon"), r(F.col("lat")).alias("lat"), r(F.col("h"), 3).alias("h"))


@query("p12_ellipsoid_normal", f"""
with e as (select pid, lat, ({ECEF_SQL} + h) * cos(radians(lat)) * cos(radians(lon)) / 40680631590769.0 as a,
                  ({ECEF_SQL} + h) * cos(radians(lat)) * sin(radians(lon)) / 40680631590769.0 as b,
                  ({ECEF_SQL} * (1 - 0.00669437999014) + h) * sin(radians(lat)) / pow(6356752.3142, 2) as c from points)
select pid, round(a / sqrt(a*a+b*b+c*c), 8) as nx, round(b / sqrt(a*a+b*b+c*c), 8) as ny,
       round(c / sqrt(a*a+b*b+c*c), 8) as nz, round({ECEF_SQL}, 4) as radius from e""")
def p12(i):
    n = geodesy.ellipsoid_normal(*geodesy.ecef("lon", "lat", "h"))
    return i.points.select(
        "pid", *[r(c, 8).alias(a) for a, c in zip(("nx", "ny", "nz"), n)], r(geodesy.radius_at_lat("lat"), 4).alias("radius")
    )


@query("p13_split_antimeridian", """
select box_id, w, e, s, n from boxes where w <= e
union all select box_id, w, 180.0, s, n from boxes where w > e
union all select box_id, -180.0, e, s, n from boxes where w > e""")
def p13(i):
    return i.boxes.select("box_id", "s", "n", F.explode(text.split_antimeridian("w", "e")).alias("i")).select(
        "box_id", "i.w", "i.e", "s", "n"
    )


@query("p14_overview_levels", """
select file_id, unnest(case when size_bytes > 53687091200 then [2, 4, 8, 16, 32, 64, 128, 256]
       when size_bytes > 21474836480 then [2, 4, 8, 16, 32, 64, 128] else [2, 4, 8, 16, 32, 64] end) as factor
from footprints""")
def p14(i):
    return i.footprints.select("file_id", F.explode(text.overview_levels("size_bytes")).alias("factor"))


@query("p16_oct_encode", """
with n as (select pid, cos(radians(lat)) * cos(radians(lon)) as a, cos(radians(lat)) * sin(radians(lon)) as b, sin(radians(lat)) as c from points),
p as (select pid, c, a / (abs(a) + abs(b) + abs(c)) as u, b / (abs(a) + abs(b) + abs(c)) as v from n),
q as (select pid, case when c < 0 then (1 - abs(v)) * (case when u < 0 then -1 else 1 end) else u end as u,
             case when c < 0 then (1 - abs(u)) * (case when v < 0 then -1 else 1 end) else v end as v from p)
select pid, cast(round((u * 0.5 + 0.5) * 255) as bigint) as oct_x, cast(round((v * 0.5 + 0.5) * 255) as bigint) as oct_y from q""")
def p16(i):
    lam, phi = F.radians("lon"), F.radians("lat")
    x, y = encoding.oct_encode(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return i.points.select("pid", x.alias("oct_x"), y.alias("oct_y"))


@query("p17_zigzag", """
select pid, cast(round(h) as bigint) as v, case when round(h) < 0 then -2 * cast(round(h) as bigint) - 1 else 2 * cast(round(h) as bigint) end as folded,
       cast(round(h) as bigint) as back from points""")
def p17(i):
    v = i.points.select("pid", F.round("h").cast("bigint").alias("v")).withColumn("folded", encoding.zigzag("v"))
    return v.withColumn("back", encoding.unzigzag("folded"))


@query("p18_encode_height", """
select pid, cast(trunc((h + 1000) * 5) as int) as stored, round(trunc((h + 1000) * 5) / 5 - 1000, 6) as height from points""")
def p18(i):
    s = i.points.select("pid", encoding.encode_height("h").alias("stored"))
    return s.withColumn("height", r(encoding.decode_height("stored")))


@query("p19_child_flags", """
select set_id, z, x, y, f % 2 = 1 as sw, f // 2 % 2 = 1 as se, f // 4 % 2 = 1 as nw, f // 8 % 2 = 1 as ne
from (select *, size // 100 % 16 as f from tile_store) q""")
def p19(i):
    f = F.floor(F.col("size") / 100) % 16
    return i.tile_store.select(
        "set_id", "z", "x", "y", *[encoding.has_child(f, q).alias(q.lower()) for q in ("SW", "SE", "NW", "NE")]
    )
