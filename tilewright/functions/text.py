"""Parsing and formatting of paths, sizes, metadata and reference systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._cols import col

KB, MB, GB = 1024, 1024**2, 1024**3

# fixed values: patterns and unit words of the formats read and written here
DMS = r"""(\d+)d\s*(\d+)'(\d+\.?\d*)"([EWNS])"""
DECIMAL_PAIR = r"\(\s*(-?\d+\.?\d*)[^,)]*,\s*(-?\d+\.?\d*)"
HOURS, MINUTES, SECONDS = "小时", "分", "秒"
FULL_MINUTES = "分钟"
NESTED_PATH = r"^(\d+)/(\d+)/(\d+)\.(\w+)$"
FLAT_PATH = r"^(\d+)/(\d+)_(\d+)\.(\w+)$"
FOLDED_PATH = r"^L(\d+)/X(\d+)/L\d+_X\d+_Y(\d+)\.(til)$"


def dms_to_deg(text) -> Column:
    """Signed degrees of text such as ``104d45'56.25"E``; null when it does not match."""
    text = col(text)

    def part(i):
        return F.regexp_extract(text, DMS, i)

    size = part(1).try_cast("double") + part(2).try_cast("double") / 60.0 + part(3).try_cast("double") / 3600.0
    return F.when(part(4).isin("W", "S"), -size).when(part(4) != "", size)


def classify_crs(text) -> dict[str, Column]:
    """Kind of reference system named in metadata text, with code, zone and tiling suitability."""
    t = col(text)
    projected = t.contains("PROJCS[")
    geographic = t.contains('GEOGCS["WGS 84"') & ~projected
    web = t.contains('PROJCS["WGS 84 / Pseudo-Mercator"') | t.contains('EPSG","3857"')
    world = t.contains('PROJCS["World_Mercator"') | t.contains('PROJCS["WGS 84 / World Mercator"')
    utm = projected & t.contains("UTM")
    kind = (
        F.when(geographic, "geographic").when(web, "webMercator").when(world, "worldMercator")
        .when(utm, "utm").when(projected, "customProjected").otherwise("unknown")
    )
    zone = F.regexp_extract(t, r"UTM Zone (\d+)", 1)
    name = F.regexp_extract(t, r'PROJCS\["([^"]+)"', 1)
    return {
        "crs_type": kind,
        "epsg": F.when(kind == "geographic", "4326").when(kind == "webMercator", "3857").when(kind == "worldMercator", "3395"),
        "zone": F.when((kind == "utm") & (zone != ""), zone.try_cast("int")),
        "crs_name": F.when((kind == "customProjected") & (name != ""), name),
        "suitable": kind.isin("geographic", "webMercator", "worldMercator"),
    }


def level0_suitable(width_deg, height_deg, width_px, height_px) -> Column:
    """Covers half the globe, or is large enough in pixels. Unknown degrees never suit."""
    wide = (col(width_deg) >= 180.0) & (col(height_deg) >= 90.0)
    fine = (col(width_px) >= 32768) & (col(height_px) >= 16384)
    return F.coalesce(wide | fine, F.lit(False)) & col(width_deg).isNotNull() & col(height_deg).isNotNull()


# fixed values: recommended settings as (size in GB below which they hold, ...)
TERRAIN_STEPS = [(0.5, 16), (2.0, 15), (8.0, 14), (None, 13)]
MAP_STEPS = [(1.0, 18, "png", 90), (5.0, 16, "webp", 85), (20.0, 15, "webp", 80), (None, 14, "webp", 75)]


def recommend_config(size_bytes, tile_kind) -> dict[str, Column]:
    """Zooms, format, quality and resampling for a raster of a size and a kind of tile."""
    gb, terrain = col(size_bytes) / float(GB), col(tile_kind) == "terrain"

    def stepped(steps, index):
        out = None
        for row in steps:
            if row[0] is None:
                return out.otherwise(row[index])
            out = F.when(gb < row[0], row[index]) if out is None else out.when(gb < row[0], row[index])

    return {
        "min_zoom": F.lit(0),
        "max_zoom": F.when(terrain, stepped(TERRAIN_STEPS, 1)).otherwise(stepped(MAP_STEPS, 1)),
        "tile_format": F.when(terrain, "terrain").otherwise(stepped(MAP_STEPS, 2)),
        "quality": F.when(terrain, 100).otherwise(stepped(MAP_STEPS, 3)),
        "resampling": F.when(~terrain, "bilinear"),
        "create_overview": ~terrain & (gb > 2),
    }


def overview_levels(size_bytes) -> Column:
    """Overview factors worth building for a file of a size."""
    gb = col(size_bytes) / float(GB)
    last = F.when(gb > 50, 8).when(gb > 20, 7).otherwise(6)
    return F.transform(F.sequence(F.lit(1), last), lambda k: F.pow(F.lit(2.0), k).cast("int"))


def _tenths(value: Column, unit: str) -> Column:
    """One decimal, exact halves to the even digit."""
    return F.format_string("%.1f" + unit, F.bround(value.cast("double"), 1))


def format_size(size_bytes) -> Column:
    b = col(size_bytes)
    return (
        F.when(b < KB, F.format_string("%d B", b.cast("bigint")))
        .when(b < MB, _tenths(b / float(KB), " KB"))
        .when(b < GB, _tenths(b / float(MB), " MB"))
        .otherwise(_tenths(b / float(GB), " GB"))
    )


def format_size_whole(size_bytes) -> Column:
    """Largest unit that fits, fraction dropped."""
    b = col(size_bytes).cast("bigint")
    return (
        F.when(b >= GB, F.format_string("%dGB", F.floor(b / GB)))
        .when(b >= MB, F.format_string("%dMB", F.floor(b / MB)))
        .when(b >= KB, F.format_string("%dKB", F.floor(b / KB)))
        .otherwise(F.format_string("%dbytes", b))
    )


def format_duration(seconds) -> Column:
    s = col(seconds)
    whole_minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(s < 60, _tenths(s, SECONDS))
        .when(s < 3600, F.format_string(f"%d{MINUTES}%.0f{SECONDS}", whole_minutes, F.bround((s - whole_minutes * 60).cast("double"), 0)))
        .otherwise(F.format_string(f"%d{HOURS}%d{FULL_MINUTES}", hours, F.floor((s - hours * 3600) / 60)))
    )


def format_millis(millis) -> Column:
    """Hours, minutes and seconds when not zero, then the milliseconds left."""
    m = col(millis).cast("bigint")
    h, mi, s = F.floor(m / 3600000), F.floor(m / 60000) % 60, F.floor(m / 1000) % 60
    return F.concat(
        F.when(h > 0, F.format_string("%dh ", h)).otherwise(""),
        F.when(mi > 0, F.format_string("%dm ", mi)).otherwise(""),
        F.when(s > 0, F.format_string("%ds ", s)).otherwise(""),
        F.format_string("%dms", m % 1000),
    )


def parse_memory(text, default: int = GB) -> Column:
    """Bytes of text such as ``8g``, ``512m``, ``1024k`` or a plain number; else the default."""
    t = col(text)
    number = F.regexp_extract(t, r"^\s*(\d+\.?\d*)\s*[gGmMkK]$", 1).try_cast("double")
    unit = F.lower(F.substring(t, -1, 1))
    scale = F.when(unit == "g", float(GB)).when(unit == "m", float(MB)).when(unit == "k", float(KB))
    return F.coalesce((number * scale).cast("bigint"), t.try_cast("bigint"), F.lit(default).cast("bigint"))


def tile_path(z, x, y, layout: str = "nested", ext: str = "png") -> Column:
    z, x, y = (col(v).cast("string") for v in (z, x, y))
    if layout == "flat":
        return F.concat(z, F.lit("/"), x, F.lit("_"), y, F.lit("." + ext))
    if layout == "folded":
        return F.concat(F.lit("L"), z, F.lit("/X"), x, F.lit("/L"), z, F.lit("_X"), x, F.lit("_Y"), y, F.lit(".til"))
    return F.concat(z, F.lit("/"), x, F.lit("/"), y, F.lit("." + ext))


def parse_tile_path(path, layout: str = "nested") -> dict[str, Column]:
    """Tile key and extension of a path; all null when the name does not fit the layout."""
    pattern = {"nested": NESTED_PATH, "flat": FLAT_PATH, "folded": FOLDED_PATH}[layout]
    p = col(path)
    number = {k: F.regexp_extract(p, pattern, i + 1).try_cast("bigint") for i, k in enumerate("zxy")}
    ext = F.regexp_extract(p, pattern, 4)
    return {**number, "ext": F.when(ext != "", ext)}


def task_time(task_id) -> Column:
    """Number at the end of a task id, 0 when there is none."""
    return F.coalesce(F.regexp_extract(col(task_id), r"(\d+)$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def split_antimeridian(w, e) -> Column:
    """Array of one or two ``(w, e)`` intervals; a box with west > east is cut at 180 degrees."""
    w, e = col(w), col(e)

    def interval(a, b):
        return F.struct(a.alias("w"), b.alias("e"))

    return F.when(w <= e, F.array(interval(w, e))).otherwise(
        F.array(interval(w, F.lit(180.0)), interval(F.lit(-180.0), e))
    )
