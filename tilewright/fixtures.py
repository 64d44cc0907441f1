"""Geodata derived from the given tables, as SQL shared by Spark and the checking engine.

Every definition grows with the table it reads. Four tokens differ between the engines:

* ``{t:name}``   a given table,
* ``{s:name:c,d}`` columns of a given table whose rows are about to be multiplied: on Spark they
  are spread over all cores, and over more parts the more rows there are, when the table has fewer splits than that,
* ``{f:name}``   another derived input,
* ``{each:c:n}`` one row per value ``c`` = 0..n-1 for each row before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DEFINITIONS: dict[str, str] = {
    # positions all over the globe
    "points": """
        select c_custkey as pid,
               cast((c_custkey * 7919) % 36000 as double) / 100.0 - 180.0 as lon,
               cast((c_custkey * 104729) % 17000 as double) / 100.0 - 85.0 as lat,
               c_acctbal as h
        from {t:customer}""",
    # positions over the area the rasters cover
    "probes": """
        select o_orderkey as pid,
               cast((o_orderkey * 7919) % 5200 as double) / 100.0 - 26.0 as lon,
               cast((o_orderkey * 104729) % 5200 as double) / 100.0 - 26.0 as lat
        from {s:orders:o_orderkey} o""",
    "footprints": """
        select file_id, concat('f', cast(file_id as string), '.tif') as file_name,
               w, s, w + dx as e, s + dy as n, px, srs, size_bytes
        from (select o_orderkey as file_id,
                     cast((o_orderkey * 7919) % 35700 as double) / 100.0 - 180.0 as w,
                     cast((o_orderkey * 104729) % 16700 as double) / 100.0 - 85.0 as s,
                     cast((o_orderkey * 31) % 200 + 1 as double) / 100.0 as dx,
                     cast((o_orderkey * 17) % 200 + 1 as double) / 100.0 as dy,
                     cast(case when o_orderkey % 3 = 0 then 0.01 else 0.02 end as double) as px,
                     case when o_orderkey % 5 = 0 then 'EPSG:3857' else 'EPSG:4326' end as srs,
                     (o_orderkey * 7919) % 60000 * 1000000 as size_bytes
              from {s:orders:o_orderkey} o) q""",
    # search boxes, some of them reaching over the antimeridian
    "boxes": """
        select c_custkey as box_id,
               cast((c_custkey * 331) % 36000 as double) / 100.0 - 180.0 as w,
               cast((c_custkey * 613) % 16000 as double) / 100.0 - 84.0 as s,
               case when (c_custkey * 331) % 36000 + 400 > 36000
                    then cast((c_custkey * 331) % 36000 + 400 - 36000 as double) / 100.0 - 180.0
                    else cast((c_custkey * 331) % 36000 + 400 as double) / 100.0 - 180.0 end as e,
               cast((c_custkey * 613) % 16000 + 300 as double) / 100.0 - 84.0 as n
        from {t:customer}""",
    # dense rasters on a lattice of positions, overlapping their neighbours
    "rasters": """
        select k as file_id, cast(-2400 + 240 * (k % 20) as double) / 100.0 as w,
               cast(2400 - 240 * floor((k % 400) / 20) as double) / 100.0 as n,
               cast(case when k % 2 = 0 then 0.05 else 0.1 end as double) as px,
               cast(case when k % 2 = 0 then 64 else 32 end as bigint) as cols,
               cast(case when k % 2 = 0 then 64 else 32 end as bigint) as rows
        from (select s_suppkey as k from {s:supplier:s_suppkey} t) q""",
    "cells": """
        select f.file_id, c as col, r as row,
               case when (c * 7 + r * 3 + f.file_id) % 29 = 0 then cast(null as double)
                    else cast((c * 37 + r * 91 + f.file_id * 13) % 4000 - 500 as double) end as value
        from {f:rasters} f {each:c:64} {each:r:64}
        where c < f.cols and r < f.rows""",
    "sparse_cells": """
        select l_orderkey % 1024 as col, l_partkey % 1024 as row,
               count(*) as n, max(l_quantity) as value
        from {t:lineitem} group by l_orderkey % 1024, l_partkey % 1024""",
    "tile_store": """
        select set_id, z, x, y, max(size) as size,
               concat(cast(z as string), '/', cast(x as string), '/', cast(y as string), '.terrain') as path
        from (select l_suppkey % 4 as set_id, z, l_orderkey % p as x, l_partkey % p as y,
                     cast(l_quantity as bigint) * 100 as size
              from (select l_suppkey, l_orderkey, l_partkey, l_quantity,
                           cast(3 + l_linenumber % 5 as bigint) as z,
                           cast(case l_linenumber % 5 when 0 then 8 when 1 then 16 when 2 then 32
                                when 3 then 64 else 128 end as bigint) as p
                    from {t:lineitem}) a) b
        group by set_id, z, x, y""",
    # image cells; every 11th tile lacks one cell
    "tile_alpha": """
        select cast(14 as bigint) as z, p % 16384 as x, cast(floor(p / 16384) as bigint) as y,
               c as col, r as row,
               cast(case when p % 5 = 0 and (c + r) % 7 = 0 then 0 else 255 end as bigint) as alpha
        from (select p_partkey as p from {s:part:p_partkey} t) q {each:c:16} {each:r:16}
        where not (p % 11 = 0 and c = 15 and r = 15)""",
    # level-12 geodetic tiles in blocks of 8 x 8
    "mesh_tiles": """
        select cast(12 as bigint) as z,
               k % 8 + 8 * (cast(floor(k / 64) as bigint) % 512) as x,
               cast(floor(k / 8) as bigint) % 8 + 8 * cast(floor(k / 32768) as bigint) as y
        from (select s_suppkey as k from {s:supplier:s_suppkey} t) q""",
    # a 9 x 9 lattice per tile; heights follow the global lattice, so borders agree
    "vertices": """
        select z, x, y, j * 9 + i as vid, i, j,
               -180.0e0 + 0.0439453125e0 * (x + i / 8.0e0) as lon,
               -90.0e0 + 0.0439453125e0 * (y + j / 8.0e0) as lat,
               cast(((x * 8 + i) * 37 + (y * 8 + j) * 53 + ((x * 8 + i) * (y * 8 + j)) % 11 * 7) % 900 as double) as h
        from {f:mesh_tiles} q {each:i:9} {each:j:9}""",
    # two triangles per lattice square
    "triangles": """
        select z, x, y, (a * 8 + b) * 2 + k as tid, a * 9 + b as v0,
               case when k = 0 then a * 9 + b + 1 else (a + 1) * 9 + b + 1 end as v1,
               case when k = 0 then (a + 1) * 9 + b + 1 else (a + 1) * 9 + b end as v2
        from {f:mesh_tiles} q {each:a:8} {each:b:8} {each:k:2}""",
    # a 17 x 17 raster per tile, rows from the south; neighbours differ along their seams
    "tile_cells": """
        select z, x, y, c as col, r as row,
               cast(((x * 16 + c) * 37 + (y * 16 + r) * 53 + ((x * 16 + c) * (y * 16 + r)) % 13 * 11
                     + (x * 3 + y) % 5 * 2) % 900 as double) as value
        from {f:mesh_tiles} q {each:c:17} {each:r:17}""",
    "task_events": """
        select event_id, concat('terrain', cast(1700000000 + user_id as string)) as task_id, ts,
               case event_type when 'error' then 'failed' when 'signup' then 'started'
                    when 'purchase' then 'completed' else 'processed' end as kind,
               value as tiles
        from {t:events}""",
    "tasks": """
        select concat('terrain', cast(1700000000 + user_id as string)) as task_id,
               case when max(case when event_type = 'purchase' then 1 else 0 end) = 0 then 'running'
                    when sum(case when event_type = 'error' then 1 else 0 end) >
                         sum(case when event_type = 'purchase' then 1 else 0 end) then 'failed'
                    else 'completed' end as status,
               min(ts) as start_time, max(ts) as end_time,
               cast(sum(cast(round(value * 100) as bigint)) as bigint) as centitiles
        from {t:events} group by user_id""",
    # groups (type 1) above spaces (type 2)
    "workspace": """
        select concat('g', cast(n_nationkey as string)) as id, cast(null as string) as parent_id,
               n_name as name, 1 as type, 1 as status from {t:nation}
        union all
        select concat('w', cast(s_suppkey as string)), concat('g', cast(s_nationkey as string)),
               s_name, 2, cast(s_suppkey % 2 as int) from {t:supplier}""",
    # times at which a space is switched on or off
    "layer_changes": """
        select concat('w', cast(user_id % 100 as string)) as layer_id, ts as changed_at, max(cast(event_id % 2 as int)) as status
        from {t:events} where event_type in ('signup', 'error') group by user_id % 100, ts""",
    "map_record": """
        select cast(c_custkey as string) as id, n_name as workspace_group,
               concat('Supplier#', lpad(cast(c_custkey % 100 as string), 9, '0')) as workspace,
               concat('data/', c_name, '.tif') as file_path,
               cast(c_custkey % 4 as int) as zoom_min, cast(10 + c_custkey % 9 as int) as zoom_max
        from {t:customer} join {t:nation} on c_nationkey = n_nationkey""",
    "meta_text": """
        select p_partkey as file_id, k as line_no,
               case k
                 when 0 then case p_partkey % 4
                               when 0 then 'PROJCS["WGS 84 / Pseudo-Mercator",'
                               when 1 then 'GEOGCS["WGS 84",'
                               when 2 then concat('PROJCS["WGS 84 / UTM Zone ', cast(p_partkey % 60 + 1 as string), 'N",')
                               else 'PROJCS["Lambert Plate",' end
                 when 1 then concat('Size is ', cast(p_partkey % 512 + 256 as string), ', ', cast(p_partkey % 256 + 128 as string))
                 when 2 then concat('Pixel Size = (0.0', cast(p_partkey % 9 + 1 as string), ',-0.0', cast(p_partkey % 9 + 1 as string), ')')
                 when 3 then case when p_partkey % 4 = 1
                    then concat('Upper Left  (  ', cast(p_partkey % 170 as string), '.5, 40.25)')
                    else concat('Upper Left  (  ', cast(p_partkey % 170 * 1000 as string), '.000, 4000.000) (', cast(p_partkey % 170 as string), 'd30''15.00"W, 40d15'' 0.00"N)') end
                 else case when p_partkey % 4 = 1
                    then concat('Lower Right (  ', cast(p_partkey % 170 + 1 as string), '.5, -39.25)')
                    else concat('Lower Right (  ', cast(p_partkey % 170 * 1000 as string), '.000, 3000.000) (', cast(p_partkey % 170 + 2 as string), 'd30''15.00"E, 39d15'' 0.00"S)') end
               end as line
        from {s:part:p_partkey} t {each:k:5}""",
    "meta_json": """
        select p_partkey as file_id,
               concat('{"size":[', cast(p_partkey % 512 + 256 as string), ',', cast(p_partkey % 256 + 128 as string),
                      '],"geoTransform":[', cast(p_partkey % 170 - 85 as string), '.5,0.25,0.0,',
                      cast(p_partkey % 80 as string), '.25,0.0,-0.125],"bands":[{"type":"Float32","noDataValue":-9999.0}',
                      case when p_partkey % 3 = 0 then ',{"type":"Byte"}' else '' end,
                      '],"coordinateSystem":{"wkt":"',
                      case when p_partkey % 2 = 0 then 'EPSG:4326' else 'EPSG:3857' end, '"}}') as doc
        from {t:part}""",
    "listing": """
        select concat(folder, '/', name, ext) as rel_path, folder, name, ext, size_bytes
        from (select concat('d', cast(p_partkey % 7 as string)) as folder,
                     concat('r', cast(cast(floor(p_partkey / 2) as bigint) as string)) as name,
                     case cast(floor(p_partkey / 2) as bigint) % 5 when 0 then '.tif' when 1 then '.tiff'
                          when 2 then '.png' when 3 then '.txt' else '.TIF' end as ext,
                     cast(p_size as bigint) * 1048576 as size_bytes
              from {t:part}) q""",
    # lines of file lists: blanks, comments, absolute and relative paths
    "list_lines": """
        select p_partkey as line_no,
               case p_partkey % 6 when 0 then '   '
                 when 1 then concat('# r', cast(p_partkey as string), '.tif')
                 when 2 then concat('/data/d', cast(p_partkey % 7 as string), '/r', cast(cast(floor(p_partkey / 2) as bigint) as string), '.tif')
                 when 3 then concat('/etc/r', cast(p_partkey as string), '.tif')
                 else concat('  r', cast(cast(floor(p_partkey / 2) as bigint) as string), '.tif ') end as line
        from {t:part}""",
}

SPREAD_ROWS = 50_000  # rows that one task multiplies

_TABLE = re.compile(r"\{t:(\w+)\}")
_SPREAD = re.compile(r"\{s:(\w+):([\w,]+)\}")
_INPUT = re.compile(r"\{f:(\w+)\}")
_EACH = re.compile(r"\{each:(\w+):(\d+)\}")


def spark_sql(spark: SparkSession, name: str, sf_dir: str) -> str:
    text = _INPUT.sub(lambda m: f"({spark_sql(spark, m[1], sf_dir)})", DEFINITIONS[name])
    text = _SPREAD.sub(lambda m: f"(select {_hint(spark, sf_dir, m[1])} {m[2]} from {{t:{m[1]}}})", text)
    text = _TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text)
    return _EACH.sub(
        lambda m: f"lateral view explode(sequence(0L, {int(m[2]) - 1}L)) e_{m[1]} as {m[1]}", text
    )


def _hint(spark: SparkSession, sf_dir: str, table: str) -> str:
    """Spread a table over all cores, or parts of at most SPREAD_ROWS rows if these are more; leave it where it comes in as many splits."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // SPREAD_ROWS))  # counted from the footers of the files
    return f"/*+ repartition({parts}) */" if rows.rdd.getNumPartitions() < parts else ""


def check_sql(name: str) -> str:
    text = _INPUT.sub(lambda m: m[1], DEFINITIONS[name])
    text = _TABLE.sub(lambda m: m[1], _SPREAD.sub(lambda m: m[1], text))
    return _EACH.sub(
        lambda m: f"cross join (select range as {m[1]} from range({m[2]})) e_{m[1]}", text
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_sql(spark, name, sf_dir))


def _needs(sql: str) -> list[str]:
    """Derived inputs named in ``sql``, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in DEFINITIONS:
            if name in found or not re.search(rf"\b(from|join)\s+(\{{f:)?{name}\b", text):
                continue
            visit(DEFINITIONS[name])
            if name not in found:
                found.append(name)

    visit(sql)
    return found


def with_inputs(sql: str) -> str:
    """Put the derived inputs a checking statement names in front of it."""
    sql = sql.strip()
    ctes = [f"{n} as ({check_sql(n)})" for n in _needs(sql)]
    if not ctes:
        return sql
    head, recursive = ("with recursive ", True) if sql.startswith("with recursive ") else ("with ", False)
    if sql.startswith("with "):
        body = sql[len("with recursive "):] if recursive else sql[len("with "):]
        return head + ",\n".join(ctes) + ",\n" + body
    return head + ",\n".join(ctes) + "\n" + sql
