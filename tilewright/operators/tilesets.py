"""Tile sets: scanning, merging, gaps, layers, layouts and reuse.

A tile set is a table with ``z, x, y`` and, where it matters, ``set_id``, ``size`` and ``path``.
Sets are never changed in place; every operator returns a new relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import grid, predicates, text
from tilewright.functions._cols import pow2

from .ordering import global_lead

KEY = ["z", "x", "y"]


def scan_tiles(files: DataFrame, layout: str = "nested", ext: str | None = None) -> DataFrame:
    """Tile keys from relative paths; names that do not fit the layout are left out."""
    f = files.withColumns(text.parse_tile_path("path", layout)).filter(F.col("y").isNotNull())
    return f if ext is None else f.filter(F.col("ext") == ext)


def nodata_tile_stats(cells: DataFrame, expected: int, threshold: float = 0.0) -> DataFrame:
    """Cells, transparent cells, their ratio and the nodata flag per tile."""
    g = cells.groupBy(*KEY).agg(
        F.count("*").alias("cells"), F.sum(F.when(F.col("alpha") < 255, 1).otherwise(0)).alias("nodata_cells")
    )
    return g.withColumns({
        "nodata_ratio": F.col("nodata_cells") / F.col("cells"),
        "nodata": predicates.nodata_tile("cells", "nodata_cells", expected, threshold),
    })


def nodata_scan(flags: DataFrame) -> DataFrame:
    """Totals per zoom and overall (z null) of tiles flagged as nodata."""
    return flags.rollup("z").agg(
        F.count("*").alias("total"), F.sum(F.col("nodata").cast("bigint")).alias("nodata_tiles"),
        F.sum((~F.col("nodata")).cast("bigint")).alias("valid_tiles"),
    ).withColumn("nodata_percent", F.round(F.col("nodata_tiles") * 100.0 / F.col("total"), 2))


def nodata_names(flags: DataFrame, n: int = 100) -> DataFrame:
    """First ``n`` names of nodata tiles; each task keeps its own best ``n`` only."""
    named = flags.filter("nodata").select(text.tile_path("z", "x", "y").alias("path"))
    return named.orderBy("path").limit(n)


def delete_nodata(store: DataFrame, flags: DataFrame) -> DataFrame:
    """The store without its nodata tiles."""
    return store.join(flags.filter("nodata").select(*KEY), KEY, "left_anti")


def delete_nodata_report(store: DataFrame, flags: DataFrame) -> DataFrame:
    """Tiles checked and deleted, and ``(z, x)`` directories left empty."""
    marked = store.select(*KEY).join(flags.select(*KEY, "nodata"), KEY, "left")
    dropped = F.coalesce(F.col("nodata"), F.lit(False))
    columns = marked.groupBy("z", "x").agg(
        F.count("*").alias("n"), F.sum(dropped.cast("bigint")).alias("d")
    )
    return columns.agg(
        F.sum("n").alias("checked"), F.sum("d").alias("deleted"),
        F.sum((F.col("n") == F.col("d")).cast("bigint")).alias("emptied_directories"),
    )


def available_ranges(tiles: DataFrame, by: tuple[str, ...] = (), root_level: bool = False) -> DataFrame:
    """Smallest and largest column and row per zoom; optionally the root level in full."""
    g = tiles.groupBy(*by, "z").agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )
    if not root_level:
        return g
    roots = g.select(*by, F.lit(1).alias("_one")).distinct().select(
        *by, *[F.lit(v).cast("bigint").alias(k) for k, v in (("z", 0), ("min_x", 0), ("max_x", 1), ("min_y", 0), ("max_y", 0))]
    )
    return g.filter("z > 0").unionByName(roots)


def layer_bounds(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Extent of the deepest level, clipped to the globe (rows counted from the south)."""
    pick = F.struct("z", "min_x", "max_x", "min_y", "max_y")
    deepest = ranges.groupBy(*by).agg(F.max_by(pick, "z").alias("d")).select(*by, "d.*")
    low = grid.geodetic_bounds("z", "min_x", "min_y")
    high = grid.geodetic_bounds("z", "max_x", "max_y")
    return deepest.select(
        *by, F.col("z").alias("max_zoom"),
        F.greatest(F.lit(-180.0), low["west"]).alias("w"), F.greatest(F.lit(-90.0), low["south"]).alias("s"),
        F.least(F.lit(180.0), high["east"]).alias("e"), F.least(F.lit(90.0), high["north"]).alias("n"),
    )


def all_tiles_bounds(tiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Union of the extents of all tiles."""
    b = grid.geodetic_bounds("z", "x", "y")
    return tiles.groupBy(*by).agg(
        F.min(b["west"]).alias("w"), F.min(b["south"]).alias("s"), F.max(b["east"]).alias("e"), F.max(b["north"]).alias("n")
    )


# fixed values: header fields of a layer description
TILEJSON, LAYER_VERSION, LAYER_SCHEME = "2.1.0", "1.1.0", "tms"
TILE_TEMPLATE, LAYER_PROJECTION = "{z}/{x}/{y}.terrain?v={version}", "EPSG:4326"


def layer_json(tiles: DataFrame, by: tuple[str, ...] = (), fmt: str = "quantized-mesh-1.0") -> DataFrame:
    """Layer description as JSON, one row per set (a few dozen ranges each, one per zoom)."""
    ranges = available_ranges(tiles, by)
    span = F.struct(
        F.col("min_x").alias("startX"), F.col("min_y").alias("startY"), F.col("max_x").alias("endX"), F.col("max_y").alias("endY")
    )
    listed = ranges.groupBy(*by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("z", span.alias("span")))), lambda p: F.array(p["span"])
        ).alias("available"),
        F.max_by(F.struct("z", "min_x", "max_x", "min_y", "max_y"), "z").alias("d"),
    )
    low = grid.geodetic_bounds(F.col("d.z"), F.col("d.min_x"), F.col("d.min_y"))
    high = grid.geodetic_bounds(F.col("d.z"), F.col("d.max_x"), F.col("d.max_y"))
    doc = F.struct(
        F.lit(TILEJSON).alias("tilejson"), F.lit(fmt).alias("format"), F.lit(LAYER_VERSION).alias("version"),
        F.lit(LAYER_SCHEME).alias("scheme"), F.array(F.lit(TILE_TEMPLATE)).alias("tiles"),
        F.lit(LAYER_PROJECTION).alias("projection"),
        F.array(
            F.greatest(F.lit(-180.0), low["west"]), F.greatest(F.lit(-90.0), low["south"]),
            F.least(F.lit(180.0), high["east"]), F.least(F.lit(90.0), high["north"]),
        ).alias("bounds"),
        F.col("available"),
    )
    return listed.select(*by, F.to_json(doc).alias("layer"))


def merge_layers(bounds: DataFrame) -> DataFrame:
    """One layer over several: union of bounds, deepest level, number of sources."""
    return bounds.agg(
        F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"),
        F.max("max_zoom").alias("max_zoom"), F.count("*").alias("sources"),
    )


def global_ranges(max_zoom: DataFrame) -> DataFrame:
    """Every tile of the globe per level up to ``max_zoom``, as an alternative to true ranges."""
    z = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("max_zoom")))
    zero = F.lit(0).cast("bigint")
    return max_zoom.select(z.alias("z")).select(
        "z", zero.alias("min_x"), (pow2(F.col("z") + 1) - 1).alias("max_x"), zero.alias("min_y"), (pow2("z") - 1).alias("max_y")
    )


def union_tile_sets(sets: list[DataFrame]) -> DataFrame:
    """Several tile sets under one key space."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out


def merge_tile_sets(store: DataFrame) -> DataFrame:
    """One row per key: the largest tile, the first set on ties. Reduced before the shuffle."""
    rank = F.struct(F.col("size").alias("size"), (-F.col("set_id")).alias("order"))
    return store.groupBy(*KEY).agg(
        F.max_by(F.struct("set_id", "size", "path"), rank).alias("best"), F.count("*").alias("candidates")
    ).select(*KEY, "best.*", "candidates")


def merge_counts(store: DataFrame) -> DataFrame:
    """Tiles seen, written (new or larger than all before) and skipped when sets come in order."""
    w = Window.partitionBy(*KEY).orderBy("set_id").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.coalesce(F.col("size") > F.max("size").over(w), F.lit(True))
    return store.select(wins.alias("wins")).agg(
        F.count("*").alias("total"), F.sum(F.col("wins").cast("bigint")).alias("merged"),
        F.sum((~F.col("wins")).cast("bigint")).alias("skipped"),
    )


def tile_store_summary(store: DataFrame) -> DataFrame:
    """Tile files and zoom directories per set; only one row per set and zoom is shuffled."""
    per_zoom = store.groupBy("set_id", "z").agg(F.count("*").alias("n"))
    return per_zoom.groupBy("set_id").agg(
        F.sum("n").alias("tile_files"), F.count("*").alias("zoom_directories"), F.max("z").alias("deepest")
    )


def workspace_usage(listing: DataFrame) -> DataFrame:
    """Files, directories and bytes below a root."""
    per_folder = listing.groupBy("folder").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return per_folder.agg(
        F.sum("n").alias("total_files"), F.count("*").alias("total_directories"), F.sum("b").alias("total_bytes")
    ).withColumn("total_text", text.format_size("total_bytes"))


def cache_summary(store: DataFrame, manifests: DataFrame) -> DataFrame:
    """Facts of each set's manifest beside the number of tiles really there, newest first."""
    actual = store.groupBy("set_id").agg(F.count("*").alias("actual_tiles"))
    return (
        actual.join(manifests, "set_id", "left")
        .withColumn("has_manifest", F.col("generated_at").isNotNull())
        .orderBy(F.col("generated_at").desc_nulls_last(), "set_id")
    )


def neighbour_join(tiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a tile and its right or lower neighbour, both present (in one set, if ``by`` names its columns)."""
    keys = tiles.select(*by, *KEY)
    near = grid.neighbours(keys, [(1, 0), (0, 1)])
    other = keys.select(*by, "z", F.col("x").alias("n_x"), F.col("y").alias("n_y"))
    side = F.when(F.col("n_ord") == 0, "right").otherwise("bottom")
    return near.join(other, [*by, "z", "n_x", "n_y"], "left_semi").select(*by, *KEY, "n_x", "n_y", side.alias("side"))


def missing_tiles(index: DataFrame, store: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    key = [*by, *KEY]
    return index.select(*key).join(store.select(*key), key, "left_anti")


def present_tiles(index: DataFrame, store: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    key = [*by, *KEY]
    return index.select(*key).join(store.select(*key), key, "left_semi")


def column_gaps(tiles: DataFrame, zmax: int | None = None) -> DataFrame:
    """Missing rows inside each column, on all levels (or up to ``zmax``); a column has at most 2^z rows."""
    nxt = F.lead("y").over(Window.partitionBy("z", "x").orderBy("y"))
    return (
        _keys_up_to(tiles, zmax).withColumn("_n", nxt).filter(F.col("_n") > F.col("y") + 1)
        .select("z", "x", F.explode(F.sequence(F.col("y") + 1, F.col("_n") - 1)).alias("y"))
    )


def _keys_up_to(tiles: DataFrame, zmax: int | None) -> DataFrame:
    kept = tiles if zmax is None else tiles.filter(F.col("z") <= zmax)
    return kept.select(*KEY).distinct()


def row_gaps(tiles: DataFrame, zmax: int | None = None) -> DataFrame:
    """Missing whole columns between columns that exist, for the rows of their left neighbour.

    A deep level has too many columns for one task, so the next column is found in the overall order.
    """
    distinct = _keys_up_to(tiles, zmax)
    columns = global_lead(distinct.select("z", "x").distinct(), ["z", "x"], ["z", "x"])
    holes = columns.filter((F.col("next_z") == F.col("z")) & (F.col("next_x") > F.col("x") + 1))
    joined = distinct.join(holes.select("z", "x", F.col("next_x").alias("_n")), ["z", "x"])
    return joined.select("z", F.explode(F.sequence(F.col("x") + 1, F.col("_n") - 1)).alias("x"), "y")


def fill_gaps(store: DataFrame, zmax: int | None = None, fill_columns: bool = False) -> DataFrame:
    """Each gap with the first of its eight neighbours that exists, in the fixed order."""
    merged = merge_tile_sets(store)
    gaps = column_gaps(store, zmax)
    if fill_columns:
        gaps = gaps.unionByName(row_gaps(store, zmax))
    near = grid.neighbours(gaps)
    have = merged.select("z", F.col("x").alias("n_x"), F.col("y").alias("n_y"), "path", "set_id", "size")
    hits = near.join(have, ["z", "n_x", "n_y"])
    return hits.groupBy(*KEY).agg(
        F.min_by(F.struct("path", "set_id", "size", "n_ord"), "n_ord").alias("b")
    ).select(*KEY, F.col("b.path").alias("from_path"), F.col("b.set_id"), F.col("b.size"), F.col("b.n_ord").alias("direction"))


def same_sources(old: DataFrame, new: DataFrame, key: str = "file_name", by: tuple[str, ...] = ()) -> DataFrame:
    """Whether two file lists (of each set of ``by``) hold the same names, and how many are on one side only."""
    sides = old.select(*by, key, F.lit(1).alias("side")).unionByName(new.select(*by, key, F.lit(2).alias("side")))
    per = sides.groupBy(*by, key).agg(F.bit_or("side").alias("sides"))
    return per.groupBy(*by).agg(
        F.coalesce(F.sum((F.col("sides") == 1).cast("bigint")), F.lit(0)).alias("only_old"),
        F.coalesce(F.sum((F.col("sides") == 2).cast("bigint")), F.lit(0)).alias("only_new"),
    ).withColumn("same", (F.col("only_old") == 0) & (F.col("only_new") == 0))


def stale_rasters(cached: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every key of either side as ``reuse`` (both), ``drop`` (cached only) or ``load`` (wanted only)."""
    key = [*by, *KEY]
    sides = cached.select(*key, F.lit(1).alias("side")).unionByName(wanted.select(*key, F.lit(2).alias("side")))
    per = sides.groupBy(*key).agg(F.bit_or("side").alias("sides"))
    action = F.when(F.col("sides") == 3, "reuse").when(F.col("sides") == 1, "drop").otherwise("load")
    return per.select(*key, action.alias("action"))


def convert_layout(files: DataFrame, existing: DataFrame, source: str, target: str, overwrite: bool = False, ext: str = "png",
                   by: tuple[str, ...] = ()) -> DataFrame:
    """What happens to each file when a set (or each set of ``by``) moves to another layout.

    ``action`` is ``process``, ``skip`` (the target exists and is not overwritten) or ``error``
    (the name does not fit the source layout).
    """
    f = files.withColumns(text.parse_tile_path("path", source))
    f = f.withColumn("target_path", text.tile_path("z", "x", "y", target, ext))
    there = existing.select(*by, F.col("path").alias("target_path"), F.lit(True).alias("_there"))
    joined = f.join(there, [*by, "target_path"], "left")
    action = (
        F.when(F.col("y").isNull(), "error")
        .when(F.col("_there") & F.lit(not overwrite), "skip").otherwise("process")
    )
    return joined.withColumn("action", action).drop("_there", "ext")


def convert_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("tiles"))


def manifest(index: DataFrame, results: DataFrame, zmin: int, zmax: int, tile_size: int = 256) -> DataFrame:
    """Counts and success rate of a run. ``results`` has one row per tile with ``ok``."""
    total = index.agg(F.count("*").alias("total_tiles"))
    done = results.agg(
        F.struct(
            F.coalesce(F.sum(F.col("ok").cast("bigint")), F.lit(0)).alias("processed"),
            F.coalesce(F.sum((~F.col("ok")).cast("bigint")), F.lit(0)).alias("failed"),
        )
    ).scalar()
    rate = F.when(F.col("total_tiles") > 0, F.bround(F.col("processed_tiles") * 100.0 / F.col("total_tiles"), 1)).otherwise(0.0)
    return total.withColumn("_d", done).select(
        "total_tiles", F.col("_d.processed").alias("processed_tiles"), F.col("_d.failed").alias("failed_tiles"),
        F.lit(f"{zmin}-{zmax}").alias("zoom_levels"), F.lit(tile_size).alias("tile_size"),
    ).withColumn("success_rate", F.format_string("%.1f%%", rate))


def incremental_check(old_files: DataFrame, new_files: DataFrame, index: DataFrame, store: DataFrame, same_options: bool, success_rate: float,
                      least_success: float = 50.0, most_missing: float = 0.3, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether an earlier run (or that of each set of ``by``) can be reused: same sources and options, good enough, tiles still there.

    A set needs file lists to be judged; one without tiles in the index can't be reused.
    """
    same = same_sources(old_files, new_files, by=by)
    key = [*by, *KEY]
    marked = index.select(*key).join(store.select(*key).distinct().withColumn("_h", F.lit(1)), key, "left")
    totals = F.struct(F.count("*").alias("tiles"), F.sum(F.col("_h").isNull().cast("bigint")).alias("missing"))
    if by:
        out = same.join(marked.groupBy(*by).agg(totals.alias("_g")), list(by), "left")
    else:
        out = same.withColumn("_g", marked.agg(totals).scalar())
    tiles, missing = (F.coalesce(F.col(f"_g.{k}"), F.lit(0)) for k in ("tiles", "missing"))
    out = out.select(*by, "only_old", "only_new", "same", tiles.alias("tiles"), missing.alias("missing"))
    share = F.col("missing") / F.greatest(F.col("tiles"), F.lit(1))
    ok = F.col("same") & F.lit(same_options) & F.lit(success_rate >= least_success) & (F.col("tiles") > 0) & (share <= most_missing)
    return out.withColumn("reuse", ok)
