"""Queries over the tile index and over tile sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import text
from tilewright.operators import covers, index, projections, tilesets
from tilewright.sources import listing

from .grid_queries import r, xyz_range_sql, zooms
from .registry import query

ZMAX = 6

# every tile of the overall range against every raster
INDEX_SQL = f"""ext as (select min(w) as ew, min(s) as es, max(e) as ee, max(n) as en from footprints),
rg as (select z, {xyz_range_sql('ew', 'es', 'ee', 'en')} from ext {zooms(0, ZMAX)}),
tl as (select z, x, unnest(range(min_y, max_y + 1)) as y from (select *, unnest(range(min_x, max_x + 1)) as x from rg) q),
tb as (select z, x, y, x / pow(2, z) * 360 - 180 as west, (x + 1) / pow(2, z) * 360 - 180 as east,
              degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))) as south, degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))) as north from tl),
ts as (select tb.*, f.file_id, f.file_name, f.size_bytes, f.w, f.s, f.e, f.n from tb join footprints f
       on f.w <= tb.east and f.e >= tb.west and f.s <= tb.north and f.n >= tb.south),
ti as (select z, x, y, west, south, east, north, count(*) as source_count, (east - west) * (north - south) as area
       from ts group by z, x, y, west, south, east, north)"""


def sources(i):
    return index.tile_sources(i.footprints.select("file_id", "file_name", "w", "s", "e", "n"), 0, ZMAX)


def tile_index(i):
    slim = index.tile_sources(i.footprints.select("w", "s", "e", "n"), 0, ZMAX)
    return index.tile_index(slim)


@query("j01_tile_index", f"""with {INDEX_SQL}
select z, x, y, source_count, 256 as tile_size, round(west, 6) as west, round(south, 6) as south, round(east, 6) as east,
       round(north, 6) as north, round(area, 6) as area from ti""")
def j01(i):
    return tile_index(i).select(
        "z", "x", "y", "source_count", "tile_size", *[r(F.col(c)).alias(c) for c in ("west", "south", "east", "north", "area")]
    )


@query("j01_tile_sources", f"with {INDEX_SQL} select z, x, y, file_id from ts")
def j01_sources(i):
    return index.tile_sources(i.footprints.select("file_id", "w", "s", "e", "n"), 0, ZMAX).select("z", "x", "y", "file_id")


PAGE_SQL = """pg as (select ts.z, ts.x, ts.y, file_name, source_count, ('0x' || substr(md5(file_name), 1, 8))::bigint % cast(pow(4, greatest(0, 6 - ts.z)) as bigint) as page
  from ts join ti using (z, x, y))"""


@query("j01_index_of_mixed_systems", f"with {INDEX_SQL} select z, x, y, source_count from ti")
def j01_mixed(i):
    """Every fifth raster in web mercator metres, every seventh of the others in ellipsoidal ones: the index is that of their degrees."""
    srs = F.when(F.col("srs") == "EPSG:4326", F.when(F.col("file_id") % 7 == 0, "EPSG:3395").otherwise("EPSG:4326")).otherwise(F.col("srs"))
    f = i.footprints.select("file_id", srs.alias("srs"), "w", "s", "e", "n")
    corners = {}
    for a, b in (("w", "s"), ("e", "n")):
        at = {name: projections.projected(a, b, "EPSG:4326", name) for name in projections.SYSTEMS}
        for axis, k in enumerate((a, b)):
            corners[k] = F.coalesce(*[F.when(F.col("srs") == name, v[axis]) for name, v in at.items()])
    f = f.select("file_id", "srs", *[corners[k].alias(k) for k in ("w", "s", "e", "n")])
    return index.tile_index(index.tile_sources(projections.in_degrees(f).drop("srs"), 0, ZMAX)).select("z", "x", "y", "source_count")


@query("j01_source_pages", f"""with {INDEX_SQL}, {PAGE_SQL}
select z, x, y, page, max(source_count) as source_count, string_agg(file_name, ',' order by file_name) as files from pg group by z, x, y, page""")
def j01_pages(i):
    p = index.source_pages(sources(i))
    return p.select("z", "x", "y", "page", "source_count", F.array_join(F.transform("source_files", lambda f: f["file_name"]), ",").alias("files"))


@query("a01_union_extent", "select min(w) as w, min(s) as s, max(e) as e, max(n) as n from footprints")
def a01(i):
    return index.union_extent(i.footprints)


@query("a02_tile_index_stats", f"""with {INDEX_SQL}
select z, count(*) as tiles, cast(sum(source_count) as bigint) as sources, count(case when source_count > 1 then 1 end) as overlapped,
       max(source_count) as most_sources, round(sum(area), 4) as area from ti group by rollup(z)""")
def a02(i):
    return index.tile_index_stats(tile_index(i)).withColumn("area", r(F.col("area"), 4))


@query("j01_index_by_ranges", f"""with {INDEX_SQL} select z, x, y, source_count from ti""")
def j01_ranges(i):
    """The tile index from runs of tiles with equal sources, listed at the end."""
    return covers.listed(covers.index_runs(i.footprints, 0, ZMAX), ZMAX).select("z", "x", "y", "source_count")


@query("a02_stats_by_ranges", f"""with {INDEX_SQL}
select z, count(*) as tiles, cast(sum(source_count) as bigint) as sources, count(case when source_count > 1 then 1 end) as overlapped, max(source_count) as most_sources from ti group by z""")
def a02_ranges(i):
    return covers.run_stats(covers.index_runs(i.footprints, 0, ZMAX))


@query("a20_index_hash", f"""with {INDEX_SQL},
d as (select md5(z || '/' || x || '/' || y) as d from ti)
select count(*) as tiles, md5(count(*) || '|' || sum(('0x' || substr(d, 1, 15))::bigint) || '|' || sum(('0x' || substr(d, 16, 15))::bigint)) as hash from d""")
def a20(i):
    return index.index_hash(tile_index(i))


@query("snk04_index_geojson", f"""with {INDEX_SQL}, {PAGE_SQL},
pp as (select z, x, y, page, max(source_count) as source_count, string_agg('"' || file_name || '"', ',' order by file_name) as files from pg group by z, x, y, page)
select z, x, y, page, source_count, z || '/' || x || '/' || y || '.png' as tile_path, files,
       round(west, 6) as west, round(south, 6) as south, round(east, 6) as east, round(north, 6) as north
from pp join (select z, x, y, west, south, east, north from ti) b using (z, x, y)""")
def snk04(i):
    f = index.index_features(index.source_pages(sources(i), item=("file_name",)))

    def got(path, kind="string"):
        return F.get_json_object("feature", path).cast(kind)

    names = F.regexp_extract("feature", r'"sourceFiles":\[([^\]]*)\]', 1)
    corner = "$.geometry.coordinates[0]"
    return f.select(
        "z", "x", "y", "page", got("$.properties.sourceCount", "bigint").alias("source_count"),
        got("$.properties.tilePath").alias("tile_path"), names.alias("files"),
        got(corner + "[0][0]", "double").alias("west"), got(corner + "[0][1]", "double").alias("south"),
        got(corner + "[2][0]", "double").alias("east"), got(corner + "[2][1]", "double").alias("north"),
    )


@query("snk05_extents_geojson", f"""
with c as (select file_id, z, cast(floor((w + 180) * pow(2, z) / 180) as bigint) as x0, least(cast(pow(2, z + 1) as bigint) - 1, cast(floor((e + 180) * pow(2, z) / 180) as bigint)) as x1,
                  cast(floor((s + 90) * pow(2, z) / 180) as bigint) as y0, least(cast(pow(2, z) as bigint) - 1, cast(floor((n + 90) * pow(2, z) / 180) as bigint)) as y1
           from footprints {zooms(0, 6)}),
t as (select file_id, z, x, unnest(range(y0, y1 + 1)) as y from (select *, unnest(range(x0, x1 + 1)) as x from c) q)
select file_id, z, x, y, z || '-' || x || '-' || y as tile, x * 180 / pow(2, z) - 180 as west, (y + 1) * 180 / pow(2, z) - 90 as north from t""")
def snk05(i):
    f = index.extent_features(i.footprints.select("file_id", "w", "s", "e", "n"), 0, 6)

    def got(path, kind="string"):
        return F.get_json_object("feature", path).cast(kind)

    return f.select(
        "file_id", "z", "x", "y", got("$.properties.tile").alias("tile"),
        got("$.geometry.coordinates[0][0][0]", "double").alias("west"), got("$.geometry.coordinates[0][2][1]", "double").alias("north"),
    )


# pairs of boxes -------------------------------------------------------------------------------

CUT_SQL = """cb as (
  select box_id, w, e, s, n from boxes where w <= e
  union all select box_id, w, 180.0, s, n from boxes where w > e
  union all select box_id, -180.0, e, s, n from boxes where w > e)"""


@query("j02_footprints_for_boxes", f"""with {CUT_SQL}
select distinct box_id, file_id from cb b join footprints f on f.w <= b.e and f.e >= b.w and f.s <= b.n and f.n >= b.s""")
def j02(i):
    return index.footprints_for_boxes(i.footprints, i.boxes)


@query("f06_catalogue_filter", f"""with {CUT_SQL}
select file_id, file_name from footprints f
where exists (select 1 from cb b where f.w <= b.e and f.e >= b.w and f.s <= b.n and f.n >= b.s)""")
def f06(i):
    files = i.footprints.withColumn("ext", F.regexp_extract("file_name", r"(\.[^.]*)$", 1))
    return index.catalogue_filter(files, i.boxes, index.RASTER_EXTENSIONS).select("file_id", "file_name")


# listings -------------------------------------------------------------------------------------

@query("src01_discover", """
select distinct rel_path, size_bytes from listing
where folder in ('d0', 'd2', 'd3', 'd5') and lower(ext) in ('.tif', '.tiff') and (name || ext like 'r1%.tif' or name || ext like '%.tiff')""")
def src01(i):
    return listing.discover(i.listing, ["d0", "d2", "d3", "d5"], ["r1*.tif", "*.tiff"]).select("rel_path", "size_bytes")


@query("src02_file_list", """
with l as (select line_no, trim(line) as t from list_lines),
c as (select line_no, substr(t, 7) as p, 0 as o from l where t like '/data/%'
      union all select line_no, 'd' || k || '/' || t, k from l cross join (select range as k from range(7)) kk
      where t <> '' and t not like '#%' and t not like '/%'),
h as (select line_no, p, row_number() over (partition by line_no order by o) as rn from c
      where p in (select rel_path from listing where lower(ext) in ('.tif', '.tiff')))
select p as rel_path, min(line_no) as line_no from h where rn = 1 group by p""")
def src02(i):
    return listing.file_list(i.list_lines, i.listing, [f"d{k}" for k in range(7)], "/data")


@query("src06_scan_tiles", """
select set_id, path, z, x, y from tile_store where size <> 700""")
def src06(i):
    # names that do not fit are left out
    broken = F.when(F.col("size") == 700, F.concat(F.lit("a/"), "path")).otherwise(F.col("path"))
    files = i.tile_store.select("set_id", broken.alias("path"))
    return tilesets.scan_tiles(files, "nested", "terrain").select("set_id", "path", "z", "x", "y")


@query("s03_catalogue_listing", """
with a as (select case when position('/' in rel_path) > 0 then 'directory' else 'file' end as type, split_part(rel_path, '/', 1) as name, size_bytes from listing)
select type, name, name as path, cast(null as string) as parent_path, count(*) as files, cast(sum(size_bytes) as bigint) as size_bytes,
       case when sum(size_bytes) < 1073741824 then printf('%.1f MB', sum(size_bytes) / 1048576) else printf('%.1f GB', sum(size_bytes) / 1073741824) end as size_text
from a group by 1, 2
union all
select 'file', name || ext, 'd3/' || name || ext, '', count(*), cast(sum(size_bytes) as bigint),
       case when sum(size_bytes) < 1073741824 then printf('%.1f MB', sum(size_bytes) / 1048576) else printf('%.1f GB', sum(size_bytes) / 1073741824) end
from listing where folder = 'd3' group by name, ext""")
def s03(i):
    return listing.catalogue_listing(i.listing).unionByName(listing.catalogue_listing(i.listing, "d3"))


@query("a11_workspace_usage", """
select count(*) as total_files, count(distinct folder) as total_directories, cast(sum(size_bytes) as bigint) as total_bytes,
       printf('%.1f GB', sum(size_bytes) / 1073741824) as total_text from listing""")
def a11(i):
    return tilesets.workspace_usage(i.listing)


# tile sets ------------------------------------------------------------------------------------

FLAGS_SQL = """fl as (select z, x, y, count(*) as cells, count(case when alpha < 255 then 1 end) as nodata_cells,
  count(*) <> 256 or count(case when alpha < 255 then 1 end) > 0 as nodata from tile_alpha group by z, x, y)"""


def flags(i):
    return tilesets.nodata_tile_stats(i.tile_alpha, 256)


@query("a04_nodata_tile_stats", f"with {FLAGS_SQL} select z, x, y, cells, nodata_cells, round(nodata_cells / cells, 6) as nodata_ratio, nodata from fl")
def a04(i):
    return flags(i).withColumn("nodata_ratio", r(F.col("nodata_ratio")))


@query("f07_nodata_tiles", """
select z, x, y from tile_alpha group by z, x, y
having count(*) <> 256 or count(case when alpha < 255 then 1 end) / count(*) > 0.1""")
def f07(i):
    return tilesets.nodata_tile_stats(i.tile_alpha, 256, 0.1).filter("nodata").select("z", "x", "y")


@query("a05_nodata_scan", f"""with {FLAGS_SQL}
select z, count(*) as total, count(case when nodata then 1 end) as nodata_tiles, count(case when not nodata then 1 end) as valid_tiles,
       round(count(case when nodata then 1 end) * 100.0 / count(*), 2) as nodata_percent from fl group by rollup(z)""")
def a05(i):
    return tilesets.nodata_scan(flags(i))


@query("a05_nodata_names", f"""with {FLAGS_SQL}
select z || '/' || x || '/' || y || '.png' as path from fl where nodata order by 1 limit 100""")
def a05_names(i):
    return tilesets.nodata_names(flags(i))


def alpha_store(i):
    part = i.table("part").select(F.col("p_partkey").alias("p"), "p_size")
    return part.select(F.lit(14).cast("bigint").alias("z"), (F.col("p") % 16384).alias("x"), F.floor(F.col("p") / 16384).alias("y"), "p_size")


@query("u04_delete_nodata", f"""with {FLAGS_SQL},
st as (select cast(14 as bigint) as z, p_partkey % 16384 as x, p_partkey // 16384 as y, p_size from part)
select st.* from st where not exists (select 1 from fl where nodata and fl.z = st.z and fl.x = st.x and fl.y = st.y)""")
def u04(i):
    return tilesets.delete_nodata(alpha_store(i), flags(i))


@query("u04_delete_nodata_report", f"""with {FLAGS_SQL},
c as (select x, count(*) as n, count(case when nodata then 1 end) as d from fl group by z, x)
select cast(sum(n) as bigint) as checked, cast(sum(d) as bigint) as deleted, count(case when n = d then 1 end) as emptied_directories from c""")
def u04_report(i):
    return tilesets.delete_nodata_report(alpha_store(i), flags(i))


RANGE_SQL = "ar as (select set_id, z, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y from tile_store group by set_id, z)"
BOUNDS_SQL = """lb as (select set_id, z as max_zoom, greatest(-180, min_x * 180 / pow(2, z) - 180) as w, greatest(-90, min_y * 180 / pow(2, z) - 90) as s,
  least(180, (max_x + 1) * 180 / pow(2, z) - 180) as e, least(90, (max_y + 1) * 180 / pow(2, z) - 90) as n
  from ar where z = (select max(z) from ar b where b.set_id = ar.set_id))"""


@query("a06_available_ranges", f"""with {RANGE_SQL}
select * from ar where z > 0 union all select distinct set_id, 0, 0, 1, 0, 0 from ar""")
def a06(i):
    return tilesets.available_ranges(i.tile_store, ("set_id",), root_level=True)


@query("a07_layer_bounds", f"with {RANGE_SQL}, {BOUNDS_SQL} select * from lb")
def a07(i):
    return tilesets.layer_bounds(tilesets.available_ranges(i.tile_store, ("set_id",)), ("set_id",))


@query("a07_all_tiles_bounds", """
select set_id, min(x * 180 / pow(2, z) - 180) as w, min(y * 180 / pow(2, z) - 90) as s, max((x + 1) * 180 / pow(2, z) - 180) as e, max((y + 1) * 180 / pow(2, z) - 90) as n
from tile_store group by set_id""")
def a07_all(i):
    return tilesets.all_tiles_bounds(i.tile_store, ("set_id",))


@query("a08_merge_layers", f"""with {RANGE_SQL}, {BOUNDS_SQL}
select min(w) as w, min(s) as s, max(e) as e, max(n) as n, max(max_zoom) as max_zoom, count(*) as sources from lb""")
def a08(i):
    return tilesets.merge_layers(tilesets.layer_bounds(tilesets.available_ranges(i.tile_store, ("set_id",)), ("set_id",)))


@query("a08_global_ranges", """
with m as (select max(z) as mz from tile_store)
select z, cast(0 as bigint) as min_x, cast((1 << cast(z + 1 as int)) - 1 as bigint) as max_x, cast(0 as bigint) as min_y, cast((1 << cast(z as int)) - 1 as bigint) as max_y
from (select unnest(range(mz + 1)) as z from m) q""")
def a08_global(i):
    return tilesets.global_ranges(i.tile_store.agg(F.max("z").alias("max_zoom")))


@query("snk06_layer_json", f"""with {RANGE_SQL}, {BOUNDS_SQL},
av as (select set_id, string_agg('[{{"startX":' || min_x || ',"startY":' || min_y || ',"endX":' || max_x || ',"endY":' || max_y || '}}]', ',' order by z) as a from ar group by set_id)
select set_id, '[' || a || ']' as available, w, s, e, n, 'quantized-mesh-1.0' as format, 'tms' as scheme from av join lb using (set_id)""")
def snk06(i):
    doc = tilesets.layer_json(i.tile_store, ("set_id",))

    def got(path, kind="string"):
        return F.get_json_object("layer", path).cast(kind)

    return doc.select(
        "set_id", got("$.available").alias("available"), *[got(f"$.bounds[{k}]", "double").alias(c) for k, c in enumerate("wsen")],
        got("$.format").alias("format"), got("$.scheme").alias("scheme"),
    )


@query("a09_merge_tile_sets", """
select z, x, y, set_id, size, path, candidates from (
  select *, row_number() over (partition by z, x, y order by size desc, set_id) as rn, count(*) over (partition by z, x, y) as candidates from tile_store) q
where rn = 1""")
def a09(i):
    return tilesets.merge_tile_sets(i.tile_store)


@query("a09_merge_counts", """
with m as (select size > max(size) over (partition by z, x, y order by set_id rows between unbounded preceding and 1 preceding) as bigger from tile_store)
select count(*) as total, count(case when coalesce(bigger, true) then 1 end) as merged, count(case when not bigger then 1 end) as skipped from m""")
def a09_counts(i):
    return tilesets.merge_counts(i.tile_store)


@query("a10_tile_store_summary", """
select set_id, count(*) as tile_files, count(distinct z) as zoom_directories, max(z) as deepest from tile_store group by set_id""")
def a10(i):
    return tilesets.tile_store_summary(i.tile_store)


MANIFEST_SQL = """mf as (select s_suppkey as set_id, cast(round(s_acctbal) as bigint) as generated_at, 100 + s_suppkey as total_tiles from supplier)"""


def manifests(i):
    return i.table("supplier").select(
        F.col("s_suppkey").alias("set_id"), F.round("s_acctbal").cast("bigint").alias("generated_at"), (F.col("s_suppkey") + 100).alias("total_tiles"))


@query("a12_cache_summary", f"""with {MANIFEST_SQL},
c as (select set_id, count(*) as actual_tiles from (select l_suppkey * 2 as set_id from lineitem) q group by set_id)
select set_id, actual_tiles, generated_at, total_tiles, generated_at is not null as has_manifest from c left join mf using (set_id)""")
def a12(i):
    store = i.table("lineitem").select((F.col("l_suppkey") * 2).alias("set_id"))
    return tilesets.cache_summary(store, manifests(i))


@query("j08_neighbour_join", """
select a.set_id, a.z, a.x, a.y, b.x as n_x, b.y as n_y, case when b.x > a.x then 'right' else 'bottom' end as side
from tile_store a join tile_store b on a.set_id = b.set_id and a.z = b.z and ((b.x = a.x + 1 and b.y = a.y) or (b.x = a.x and b.y = a.y + 1))""")
def j08(i):
    return tilesets.neighbour_join(i.tile_store, ("set_id",))


NEXT_SQL = "nx as (select (set_id + 3) % 4 as set_id, z, x, y from tile_store)"


def following(i):
    """Each of the four sets under the number of the one before it."""
    return i.tile_store.withColumn("set_id", (F.col("set_id") + 3) % 4)


WANTED_SQL = "ix as (select z, x, y from tile_store where set_id in (1, 2) group by z, x, y)"


def wanted(i):
    return i.tile_store.filter("set_id in (1, 2)").select("z", "x", "y").distinct()


@query("j10_missing_tiles", f"with {NEXT_SQL} select set_id, z, x, y from tile_store except select * from nx")
def j10(i):
    return tilesets.missing_tiles(i.tile_store, following(i), ("set_id",))


@query("j11_present_tiles", f"with {NEXT_SQL} select set_id, z, x, y from tile_store intersect select * from nx")
def j11(i):
    return tilesets.present_tiles(i.tile_store, following(i), ("set_id",))


GAPS_SQL = """cd as (select distinct z, x, y from tile_store),
cs as (select z, x, min(y) as lo, max(y) as hi from cd group by z, x),
gp as (select z, x, y from (select z, x, unnest(range(lo, hi + 1)) as y from cs) q except select z, x, y from cd)"""


@query("w02_column_gaps", f"with {GAPS_SQL} select * from gp")
def w02(i):
    return tilesets.column_gaps(i.tile_store)


@query("w03_fill_gaps", f"""with {GAPS_SQL},
m as (select * from (select *, row_number() over (partition by z, x, y order by size desc, set_id) as rn from tile_store) q where rn = 1),
d as (select row_number() over (order by dx, dy) - 1 as o, dx, dy from (select a.range - 1 as dx, b.range - 1 as dy from range(3) a cross join range(3) b) q where dx <> 0 or dy <> 0),
h as (select g.z, g.x, g.y, m.path, m.set_id, m.size, o, row_number() over (partition by g.z, g.x, g.y order by o) as k
      from gp g cross join d join m on m.z = g.z and m.x = g.x + dx and m.y = g.y + dy)
select z, x, y, path as from_path, set_id, size, cast(o as int) as direction from h where k = 1""")
def w03(i):
    return tilesets.fill_gaps(i.tile_store)


@query("u01_union_tile_sets", "select set_id, z, x, y, size from tile_store")
def u01(i):
    cols = ["set_id", "z", "x", "y", "size"]
    return tilesets.union_tile_sets([i.tile_store.filter(F.col("set_id") == k).select(*cols) for k in range(4)])


@query("u02_same_sources", """
with a as (select distinct file_name from footprints where px = 0.01), b as (select distinct file_name from footprints where srs = 'EPSG:4326')
select (select count(*) from (select * from a except select * from b) q) as only_old,
       (select count(*) from (select * from b except select * from a) q) as only_new,
       not exists (select * from a except select * from b) and not exists (select * from b except select * from a) as same""")
def u02(i):
    return tilesets.same_sources(i.footprints.filter("px = 0.01"), i.footprints.filter("srs = 'EPSG:4326'"))


@query("u03_stale_rasters", f"""
with {NEXT_SQL}, a as (select set_id, z, x, y from tile_store)
select set_id, z, x, y, 'reuse' as action from (select * from a intersect select * from nx) q
union all select set_id, z, x, y, 'drop' from (select * from a except select * from nx) q
union all select set_id, z, x, y, 'load' from (select * from nx except select * from a) q""")
def u03(i):
    return tilesets.stale_rasters(i.tile_store, following(i), ("set_id",))


def layout_actions(i):
    files = i.tile_store.select("set_id", F.when(F.col("size") == 700, F.lit("layer.json")).otherwise(text.tile_path("z", "x", "y")).alias("path"))
    there = following(i).select("set_id", text.tile_path("z", "x", "y", "flat").alias("path"))
    return tilesets.convert_layout(files, there, "nested", "flat", by=("set_id",))


LAYOUT_SQL = f"""{NEXT_SQL},
la as (select set_id, case when size = 700 then 'layer.json' else z || '/' || x || '/' || y || '.png' end as path,
  case when size <> 700 then z end as z, case when size <> 700 then x end as x, case when size <> 700 then y end as y from tile_store),
th as (select set_id, z || '/' || x || '_' || y as there from nx),
lc as (select la.set_id, path, z, x, y, z || '/' || x || '_' || y || '.png' as target_path,
  case when y is null then 'error' when there is not null then 'skip' else 'process' end as action
  from la left join th on th.set_id = la.set_id and there = z || '/' || x || '_' || y)"""


@query("u05_convert_layout", f"with {LAYOUT_SQL} select * from lc")
def u05(i):
    return layout_actions(i)


@query("u05_convert_counts", f"with {LAYOUT_SQL} select action, count(*) as tiles from lc group by action")
def u05_counts(i):
    return tilesets.convert_counts(layout_actions(i))


@query("snk07_manifest", f"""with {INDEX_SQL},
r as (select (x * 31 + y * 17 + z) % 9 <> 0 as ok from ti)
select (select count(*) from ti) as total_tiles, count(case when ok then 1 end) as processed_tiles, count(case when not ok then 1 end) as failed_tiles,
       '0-6' as zoom_levels, 256 as tile_size, printf('%.1f%%', count(case when ok then 1 end) * 100.0 / (select count(*) from ti)) as success_rate from r""")
def snk07(i):
    ti = tile_index(i)
    return tilesets.manifest(ti, ti.select(((F.col("x") * 31 + F.col("y") * 17 + F.col("z")) % 9 != 0).alias("ok")), 0, ZMAX)


@query("a21_incremental_check", f"""with {NEXT_SQL},
f as (select s.set_id, file_name, file_id from footprints cross join (select distinct set_id from tile_store) s),
o as (select set_id, file_name from f where file_id % 4 = set_id or set_id = 0),
n as (select set_id, file_name from f where (file_id % 4 = set_id or set_id = 0) and not (set_id = 2 and file_id % 10 = 6) union select set_id, 'new' || file_name from f where set_id = 3 and file_id % 4 = 3 and file_id % 50 = 3),
d as (select coalesce(o.set_id, n.set_id) as set_id, count(case when n.file_name is null then 1 end) as only_old, count(case when o.file_name is null then 1 end) as only_new
  from o full join n on o.set_id = n.set_id and o.file_name = n.file_name group by 1),
m as (select t.set_id, count(*) as tiles, count(case when nx.z is null then 1 end) as missing from tile_store t left join nx on nx.set_id = t.set_id and nx.z = t.z and nx.x = t.x and nx.y = t.y group by 1)
select set_id, only_old, only_new, only_old = 0 and only_new = 0 as same, tiles, missing, only_old = 0 and only_new = 0 and missing / tiles <= 0.9 as reuse from d join m using (set_id)""")
def a21(i):
    """Every set against the one after it; the lists of two of the sets have lost or gained files."""
    sets = F.array_distinct(F.array(F.lit(0).cast("bigint"), F.col("file_id") % 4))
    old = i.footprints.select("file_id", "file_name", F.explode(sets).alias("set_id"))
    kept = old.filter(~((F.col("set_id") == 2) & (F.col("file_id") % 10 == 6))).select("set_id", "file_name")
    more = old.filter((F.col("set_id") == 3) & (F.col("file_id") % 50 == 3)).select("set_id", F.concat(F.lit("new"), "file_name").alias("file_name"))
    return tilesets.incremental_check(old, kept.unionByName(more), i.tile_store, following(i), True, 98.5, most_missing=0.9, by=("set_id",))
