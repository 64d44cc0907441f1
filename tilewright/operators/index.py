"""Which rasters feed which tile, and which rasters touch a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import grid, predicates
from tilewright.functions._cols import pow2
from tilewright.functions.text import split_antimeridian
from tilewright.session import cut_lineage

_EDGE = 1e-9  # in tiles; edges this close to a tile border are tested against both sides
SINGLE_PAGE_LEVEL = 6
BOX = {"w": "w", "s": "s", "e": "e", "n": "n"}


def union_extent(footprints: DataFrame) -> DataFrame:
    return footprints.agg(
        F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n")
    )


def tile_sources(footprints: DataFrame, zmin: int, zmax: int) -> DataFrame:
    """One row per tile and raster that meet (touching counts), with the tile's bounds.

    Every raster enumerates the tiles it covers itself, so there is no join at all; only tiles of
    the overall range count. The overall extent is a one-row scalar subquery.
    """
    ext = union_extent(footprints).select(F.struct("w", "s", "e", "n")).scalar()
    level = grid.explode_zooms(footprints.withColumn("_ext", ext), zmin, zmax)
    whole = grid.xyz_range("z", F.col("_ext.w"), F.col("_ext.s"), F.col("_ext.e"), F.col("_ext.n"))
    level = level.withColumns({f"_t_{k}": v for k, v in whole.items()})

    def fx(lon):
        return (F.col(lon) + 180.0) / 360.0 * pow2("z")

    def fy(lat):
        return grid._mercator_fraction(lat) * pow2("z")

    tiles = grid.enumerate_tiles(level.withColumns({
        "min_x": F.greatest(F.col("_t_min_x"), F.floor(fx("w") - _EDGE)),
        "max_x": F.least(F.col("_t_max_x"), F.floor(fx("e") + _EDGE)),
        "min_y": F.greatest(F.col("_t_min_y"), F.floor(fy("n") - _EDGE)),
        "max_y": F.least(F.col("_t_max_y"), F.floor(fy("s") + _EDGE)),
    }))
    tiles = tiles.withColumns(grid.xyz_bounds("z", "x", "y"))
    tile_box = {"w": "west", "s": "south", "e": "east", "n": "north"}
    return tiles.filter(predicates.bbox_intersects_closed(BOX, tile_box)).select(
        "z", "x", "y", *footprints.columns, "west", "south", "east", "north"
    )


def tile_index(sources: DataFrame, tile_size: int = 256) -> DataFrame:
    """One row per tile: bounds, number of sources, area. Counts combine before the shuffle."""
    g = sources.groupBy("z", "x", "y").agg(F.count("*").alias("source_count"))
    b = grid.xyz_bounds("z", "x", "y")
    return g.withColumns(b).withColumns({
        "tile_size": F.lit(tile_size),
        "area": (F.col("east") - F.col("west")) * (F.col("north") - F.col("south")),
    })


def name_bucket(name, buckets) -> Column:
    """Even, engine-independent spread of names over ``buckets``."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % buckets


def source_pages(sources: DataFrame, single: int = SINGLE_PAGE_LEVEL, item: tuple[str, ...] = ("file_name", "file_id", "w", "s", "e", "n")) -> DataFrame:
    """Nested source lists in pages: one page from level ``single`` on, four times as many on each level above it.

    Low zooms see every raster, so there a tile's sources are spread by a hash of the file name. The number of
    pages of a level is fixed, whatever the data; pages without sources don't appear. ``source_count`` is
    that of the whole tile. ``item`` names what is listed of a source, its file name first; only that is shuffled.
    """
    page = name_bucket(F.col("file_name"), F.pow(F.lit(4), F.greatest(F.lit(0), F.lit(single) - F.col("z"))).cast("bigint"))
    pages = sources.groupBy("z", "x", "y", page.alias("page")).agg(F.sort_array(F.collect_list(F.struct(*item))).alias("source_files"))
    counts = sources.groupBy("z", "x", "y").agg(F.count("*").alias("source_count"))
    return pages.join(counts, ["z", "x", "y"])


def index_features(pages: DataFrame, tile_size: int = 256) -> DataFrame:
    """One GeoJSON feature per tile and page of sources, as a JSON string column ``feature``."""
    b = pages.withColumns(grid.xyz_bounds("z", "x", "y"))
    b = b.withColumns({k: F.round(k, 6) for k in ("west", "south", "east", "north")})
    ring = F.array(*[F.array(F.col(a), F.col(c)) for a, c in (
        ("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            "z", "x", "y", F.col("source_count").alias("sourceCount"),
            F.round((F.col("east") - F.col("west")) * (F.col("north") - F.col("south")), 6).alias("area"),
            F.lit(tile_size).alias("tileSize"),
            F.transform("source_files", lambda f: f["file_name"]).alias("sourceFiles"),
            F.concat_ws("/", "z", "x", F.concat(F.col("y"), F.lit(".png"))).alias("tilePath"),
        ).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return b.select("z", "x", "y", "page", F.to_json(feature).alias("feature"))


def extent_features(bounds: DataFrame, zmin: int, zmax: int) -> DataFrame:
    """One GeoJSON feature per covered geodetic tile and zoom for each box of ``bounds``."""
    level = grid.explode_zooms(bounds, zmin, zmax)
    x1, y1 = grid.geodetic_x("e", "z"), grid.geodetic_y("n", "z")
    tiles = grid.enumerate_tiles(level.withColumns({
        "min_x": grid.geodetic_x("w", "z"), "max_x": F.least(x1, pow2(F.col("z") + 1) - 1),
        "min_y": grid.geodetic_y("s", "z"), "max_y": F.least(y1, pow2("z") - 1),
    })).withColumns(grid.geodetic_bounds("z", "x", "y"))
    ring = F.array(*[F.array(F.col(a), F.col(c)) for a, c in (
        ("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(F.concat_ws("-", "z", "x", "y").alias("tile")).alias("properties"),
    )
    return tiles.select(*bounds.columns, "z", "x", "y", F.to_json(feature).alias("feature"))


def tile_index_stats(index: DataFrame) -> DataFrame:
    """Tiles, source references, most sources and area per zoom, with a total row (z null)."""
    return index.rollup("z").agg(
        F.count("*").alias("tiles"), F.sum("source_count").alias("sources"),
        F.sum(F.when(F.col("source_count") > 1, 1).otherwise(0)).alias("overlapped"),
        F.max("source_count").alias("most_sources"), F.sum("area").alias("area"),
    )


def index_hash(tiles: DataFrame) -> DataFrame:
    """Fingerprint of a set of tile keys that ignores their order.

    Two 60-bit parts of each key's md5 are summed; sums combine on the map side, so the whole
    list never has to meet in one place.
    """
    digest = F.md5(F.concat_ws("/", "z", "x", "y"))

    def part(start):
        return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")).cast("string")

    sums = tiles.agg(F.count("*").cast("string").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return sums.select(F.col("n").cast("bigint").alias("tiles"), F.md5(F.concat_ws("|", "n", "a", "b")).alias("hash"))


# boxes ----------------------------------------------------------------------------------------

COVER_LEVELS = 2  # levels between a box and the cells it is said to cover
FINEST = 20  # finest lattice level boxes are filed under


def own_level(w: str, s: str, e: str, n: str) -> Column:
    """Level whose cells are just wider than the box (level 0: one cell of 360 degrees)."""
    size = F.greatest(F.col(e) - F.col(w), F.col(n) - F.col(s), F.lit(360.0 / 2**FINEST))
    return F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(360.0) / size)).cast("int")))


def filed(df: DataFrame, p: str, levels: Column) -> DataFrame:
    """One row per level and lattice cell the box touches; at most four cells on a level."""
    edge = [F.col(p + k) for k in "wsen"]
    df = df.withColumn("_lv", F.explode(levels))
    cells = F.pow(F.lit(2.0), F.col("_lv"))

    def at(v):
        return F.floor((v + 180.0) / 360.0 * cells)

    return df.withColumn("_cx", F.explode(F.sequence(at(edge[0]), at(edge[2])))).withColumn(
        "_cy", F.explode(F.sequence(at(edge[1]), at(edge[3])))
    )


SPLIT_LEAST = 1000  # rows of a cell that are never split
SPLITS = 4  # a cell is split that holds more than one part in so many times the shuffle partitions


def split_crowded(joins: list[tuple[DataFrame, DataFrame]], key: list[str]) -> tuple[list[tuple[DataFrame, DataFrame]], list[str]]:
    """The sides of joins on ``key``, and what to join them on so that no key is a large part of any side: two more columns where need be.

    A key that holds more than its share of a side is cut into parts of that share by a hash of its rows; every part of one side
    meets every part of the other. Such keys are few by definition (a fixed number per shuffle partition) and are broadcast;
    rows of other keys stay as they are. All sides are counted in one aggregate before anything is joined.
    """
    parts = SPLITS * int(joins[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = None
    for j, sides in enumerate(joins):
        for side, df in enumerate(sides):
            one = df.select(*key, F.lit(j).alias("_j"), F.lit(1 - side).alias("_a"), F.lit(side).alias("_b"))
            rows = one if rows is None else rows.unionByName(one)
    counts = rows.groupBy(*key, "_j").agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    totals = counts.groupBy("_j").agg(F.sum("_na").alias("_ta"), F.sum("_nb").alias("_tb"))  # a row per join

    def cuts(side: str) -> Column:
        share = F.greatest(F.lit(SPLIT_LEAST), F.ceil(F.col(f"_t{side}") / parts))
        return F.ceil(F.col(f"_n{side}") / share).cast("int").alias(f"_s{side}")

    crowded = counts.filter("_na > 0 and _nb > 0").join(F.broadcast(totals), "_j").select("_j", *key, cuts("a"), cuts("b"))
    crowded = cut_lineage(crowded.filter("_sa > 1 or _sb > 1"))
    if crowded.isEmpty():
        return joins, key

    def dealt(df: DataFrame, j: int, mine: str, other: str) -> DataFrame:
        cut = df.join(F.broadcast(crowded.filter(F.col("_j") == j).drop("_j")), key, "left")
        at = F.pmod(F.xxhash64(*df.columns), F.coalesce(f"_s{mine}", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(f"_s{other}", F.lit(1)) - 1))
        return cut.withColumn(f"_i{mine}", at).withColumn(f"_i{other}", every).drop("_sa", "_sb")

    return [(dealt(a, j, "a", "b"), dealt(b, j, "b", "a")) for j, (a, b) in enumerate(joins)], [*key, "_ia", "_ib"]


def box_pairs(left: DataFrame, right: DataFrame, on: tuple[str, ...] = (), apart: str | None = None) -> DataFrame:
    """Pairs of boxes that meet (touching counts), as an equi-join on lattice cells.

    Each box is filed at the level its own size asks for. Of two boxes that meet, the larger one
    is found at its own level and the smaller one at the same level among its ancestors, so cells
    are never much larger than the larger box and every candidate pair is close to a hit. A pair
    is kept only in the cell holding the south-west corner of the common part, which makes it
    unique without a ``distinct``. Columns: ``a_`` / ``b_`` before the columns of each side.

    Crowded cells are split (:func:`split_crowded`). ``on`` names columns that must be equal. With ``apart`` only pairs that differ in that column
    are wanted: cells where it has a single value never enter the join.
    """
    a = left.select(*[F.col(c).alias("a_" + c) for c in left.columns])
    b = right.select(*[F.col(c).alias("b_" + c) for c in right.columns])
    la, lb = own_level("a_w", "a_s", "a_e", "a_n"), own_level("b_w", "b_s", "b_e", "b_n")
    # Boxes are filed only at levels at which the other side has boxes of its own, and at their own level only if the other side reaches it.
    levels_a, levels_b = a.agg(F.collect_set(la)).scalar(), b.agg(F.collect_set(lb)).scalar()
    own_a = filed(a.filter(la <= F.array_max(levels_b)), "a_", F.array(la))
    up_to_b = filed(b.withColumns({"_l": lb, "_in": levels_a}), "b_", F.expr("filter(_in, l -> l <= _l)")).drop("_l", "_in")
    above_a = filed(a.withColumns({"_l": la, "_in": levels_b}), "a_", F.expr("filter(_in, l -> l < _l)")).drop("_l", "_in")
    own_b = filed(b.filter(lb < F.array_max(levels_a)), "b_", F.array(lb))
    lattice = ["_lv", "_cx", "_cy"]

    def named(df: DataFrame, p: str) -> DataFrame:
        return df.withColumns({"_k_" + c: F.col(p + c) for c in on})

    own_a, above_a = named(own_a, "a_"), named(above_a, "a_")
    up_to_b, own_b = named(up_to_b, "b_"), named(own_b, "b_")
    key = [*lattice, *["_k_" + c for c in on]]
    cells = F.pow(F.lit(2.0), F.col("_lv"))
    home = (
        F.floor((F.greatest("a_w", "b_w") + 180.0) / 360.0 * cells) == F.col("_cx")
    ) & (F.floor((F.greatest("a_s", "b_s") + 180.0) / 360.0 * cells) == F.col("_cy"))
    meet = predicates.bbox_intersects_closed(
        {k: "a_" + k for k in "wsen"}, {k: "b_" + k for k in "wsen"}
    )
    joins = [(own_a, up_to_b), (above_a, own_b)]
    if apart:
        meet = meet & (F.col("a_" + apart) != F.col("b_" + apart))
        joins = [(_mixed_cells(x, y, key, apart), y) for x, y in joins]
    ((x0, y0), (x1, y1)), parts = split_crowded(joins, key)
    both = x0.join(y0, parts).unionByName(x1.join(y1, parts))
    return both.filter(meet & home).drop(*parts)


def _mixed_cells(a: DataFrame, b: DataFrame, key: list[str], apart: str) -> DataFrame:
    """Rows of ``a`` in cells where the two sides hold more than one value of ``apart``."""
    seen = a.select(*key, F.col("a_" + apart).alias("_v")).unionByName(b.select(*key, F.col("b_" + apart).alias("_v")))
    mixed = seen.groupBy(*key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).filter("_lo <> _hi")
    return a.join(mixed.select(*key), key, "left_semi")


LIST = 256  # ids of equal boxes that one row holds at most


def _folded(boxes: DataFrame, ident: str, same: list[str]) -> DataFrame:
    """One row per up to LIST ids of rows that are equal in ``same``: ``ids`` and ``same``; a repeated row counts once."""
    place = F.dense_rank().over(Window.partitionBy(*same).orderBy(ident))
    lists = boxes.select(ident, *same).withColumn("_list", F.floor((place - 1) / LIST))
    return cut_lineage(lists.groupBy(*same, "_list").agg(F.collect_set(ident).alias("ids")).drop("_list"))


def footprints_for_boxes(footprints: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rasters touching each box; boxes over the antimeridian are cut in two first.

    Equal extents and equal boxes are compared once, their ids are listed after the join. Ids are taken to be unique.
    A raster that meets both halves of a cut box is reported with the western side of 180 degrees only.
    """
    cut = boxes.filter("w is not null and e is not null").withColumn("_i", F.explode(split_antimeridian("w", "e")))
    # the second half knows where the first one begins
    cut = cut.withColumn("first", F.when((F.col("w") > F.col("e")) & (F.col("_i.e") == F.col("e")) & (F.col("_i.w") == -180.0), F.col("w")))
    cut = cut.withColumns({"w": F.col("_i.w"), "e": F.col("_i.e")}).drop("_i")
    pairs = box_pairs(_folded(footprints, "file_id", ["w", "s", "e", "n"]), _folded(cut, "box_id", ["first", "w", "s", "e", "n"]))
    seen = (F.col("a_e") >= F.col("b_first")) & (F.col("a_w") <= 180.0)
    hits = pairs.filter(F.col("b_first").isNull() | ~seen).select("a_ids", F.explode("b_ids").alias("box_id"))
    return hits.select("box_id", F.explode("a_ids").alias("file_id"))


def catalogue_filter(files: DataFrame, boxes: DataFrame | None, extensions: list[str]) -> DataFrame:
    """Files of the given extensions; with boxes, those touching any box."""
    kept = files.filter(F.lower("ext").isin([x.lower() for x in extensions]))
    if boxes is None:
        return kept
    # equal extents and equal boxes are looked at once
    extent = ["w", "s", "e", "n"]
    cut = boxes.withColumn("_i", F.explode(split_antimeridian("w", "e"))).select("_i.w", "s", "_i.e", "n").distinct()
    cut = cut_lineage(cut)
    open_ = cut_lineage(kept.select(*extent).distinct())
    sure = cut_lineage(_touching_covered(open_, cut))
    rest = cut_lineage(open_.join(sure, extent, "left_anti"))
    found = box_pairs(rest, cut).select(*[F.col("a_" + k).alias(k) for k in extent]).distinct()
    return kept.join(sure.unionByName(found).hint("merge"), extent, "left_semi").select(*kept.columns)


def _touching_covered(extents: DataFrame, boxes: DataFrame) -> DataFrame:
    """Extents that reach into a lattice cell which some box covers wholly, and so meet that box; no pairs are formed.

    Cells are a few levels finer than the boxes, so that each box covers some; a covered cell is kept once, however many boxes lie over it.
    """
    level = F.least(F.lit(FINEST), own_level("w", "s", "e", "n") + COVER_LEVELS)
    cells = F.pow(F.lit(2.0), F.col("_lv"))

    def span(lo: str, hi: str) -> Column:
        first = F.ceil((F.col(lo) + 180.0) / 360.0 * cells)
        last = F.floor((F.col(hi) + 180.0) / 360.0 * cells) - 1
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    lattice = ["_lv", "_cx", "_cy"]
    covered = boxes.withColumn("_lv", level).withColumn("_cx", span("w", "e")).withColumn("_cy", span("s", "n")).select(*lattice).distinct()
    # an extent is looked up on levels whose cells are no smaller than a quarter of it, where it touches a bounded number of them
    levels = boxes.agg(F.collect_set(level)).scalar()
    mine = extents.filter("w <= e and s <= n").withColumns({"_in": levels, "_top": own_level("w", "s", "e", "n") + COVER_LEVELS})
    # a cell that is only touched from below doesn't count, as rounding could tell on its border
    inside = ((F.col("e") + 180.0) / 360.0 * cells > F.col("_cx")) & ((F.col("n") + 180.0) / 360.0 * cells > F.col("_cy"))
    reached = filed(mine, "", F.expr("filter(_in, l -> l <= _top)")).filter(inside).select(*extents.columns, *lattice)
    return reached.join(covered.hint("merge"), lattice, "left_semi").select(*extents.columns).distinct()


# fixed values: file kinds a catalogue lists
RASTER_EXTENSIONS = [".tif", ".tiff"]
