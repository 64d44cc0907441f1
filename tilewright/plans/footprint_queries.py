"""Queries over footprints: continuity, windows, pixel windows and merge groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.operators import footprints, groups

from .grid_queries import r
from .registry import query


def axis_sql(axis: str, low: str, high: str) -> str:
    return f"""select '{axis}' as axis, (({low} + {high}) / 2) as center, file_name as file1, px,
      lead(file_name) over (order by ({low} + {high}) / 2, file_id) as file2,
      lead({low}) over (order by ({low} + {high}) / 2, file_id) - {high} as gap from footprints"""


BREAKS_SQL = f"""br as (select axis, center, case when gap > px then 'gap' else 'overlap' end as kind, file1, file2, abs(gap) as size, abs(gap) / px as pixels
  from ({axis_sql('x', 'w', 'e')} union all {axis_sql('y', 's', 'n')}) q where gap > px or gap < -px)"""


@query("w01_continuity", f"with {BREAKS_SQL} select axis, kind, file1, file2, round(size, 6) as size, round(pixels, 3) as pixels from br")
def w01(i):
    return footprints.continuity(i.footprints).select("axis", "kind", "file1", "file2", r(F.col("size")).alias("size"), r(F.col("pixels"), 3).alias("pixels"))


@query("w01_continuity_report", f"""with {BREAKS_SQL}
select count(case when kind = 'gap' then 1 end) as gaps, count(case when kind = 'overlap' then 1 end) as overlaps, count(case when kind = 'gap' then 1 end) = 0 as continuous from br""")
def w01_report(i):
    return footprints.continuity_report(footprints.continuity(i.footprints))


@query("s05_first_gaps", f"with {BREAKS_SQL} select axis, kind, file1, file2, round(pixels, 1) as pixels from br where kind = 'gap' order by axis, center, file1 limit 3")
def s05(i):
    return footprints.first_breaks(footprints.continuity(i.footprints), "gap").select("axis", "kind", "file1", "file2", r(F.col("pixels"), 1).alias("pixels"))


def sized(i):
    return i.footprints.select(
        "file_id", F.round((F.col("e") - F.col("w")) * 1000).cast("bigint").alias("cols"),
        F.round((F.col("n") - F.col("s")) * 1000).cast("bigint").alias("rows"),
    )


SIZED_SQL = """sz as (select file_id, cast(round((e - w) * 1000) as bigint) as c, cast(round((n - s) * 1000) as bigint) as h from footprints),
wn as (select *, unnest(range(cast(ceil(h / 400) as bigint))) as wy from (select *, unnest(range(cast(ceil(c / 400) as bigint))) as wx from sz) q)"""


def mode_sql(mode: str) -> str:
    def one(k, full, a):
        if mode == "both":
            return f"greatest(0, {k} * 400 - 50) as {a}_off, least(500, {full} - greatest(0, {k} * 400 - 50)) as {a}_size"
        if mode == "far":
            return f"{k} * 400 as {a}_off, least(430, {full} - {k} * 400) as {a}_size"
        return f"""case when {k} > 0 then {k} * 400 - 4 else 0 end as {a}_off,
          case when ({k} + 1) * 400 < {full} then 404 else {full} - {k} * 400 end as {a}_size"""
    return f"select file_id, '{mode}' as mode, wx, wy, {one('wx', 'c', 'x')}, {one('wy', 'h', 'y')} from wn"


@query("r01_split_windows", f"with {SIZED_SQL} {mode_sql('both')} union all {mode_sql('far')} union all {mode_sql('margin')}")
def r01(i):
    out = None
    for mode, lap in (("both", 50), ("far", 30), ("margin", 0)):
        w = footprints.split_windows(sized(i), 400, mode, lap).select(
            "file_id", F.lit(mode).alias("mode"), "wx", "wy", "x_off", "y_off", "x_size", "y_size")
        out = w if out is None else out.unionByName(w)
    return out


def block_sql(k: str, full: str, a: str, size: str) -> str:
    base = f"({full} // 3)"
    own = f"(case when {k} = 2 then {full} - 2 * {base} else {base} end)"
    outer = f"greatest(0, {k} * {base} - lap)"
    return f"""{k} * {base} as {a}, {own} as {size}, {outer} as outer_{a},
      least({full} - {outer}, {own} + (case when {k} * {base} > 0 then lap else 0 end) + (case when {k} * {base} + {own} < {full} then lap else 0 end)) as outer_{size}"""


@query("r02_aligned_blocks", f"""
with sz as (select file_id, cast(round((e - w) * 1000) as bigint) as c, cast(round((n - s) * 1000) as bigint) as h from footprints),
b as (select *, greatest(50, least(c // 3, h // 3) // 10) as lap from sz cross join (select range as block_x from range(3)) p cross join (select range as block_y from range(3)) q)
select file_id, block_x, block_y, {block_sql('block_x', 'c', 'x', 'width')}, {block_sql('block_y', 'h', 'y', 'height')} from b""")
def r02(i):
    return footprints.aligned_blocks(sized(i), 3).drop("cols", "rows")


METRES_SQL = """im as (select file_id, cast(round((e - w) / px * 10) as bigint) as width, cast(round((n - s) / px * 10) as bigint) as height,
   radians(w) * 6378137.0 as x0, radians(e) * 6378137.0 as x1, asinh(tan(radians(s))) * 6378137.0 as y0, asinh(tan(radians(n))) * 6378137.0 as y1 from footprints)"""


def pixel_sql(g: int) -> str:
    t = "(40075016.685578488 / pow(2, 7))"
    return f"""
with {METRES_SQL},
rg as (select *, cast(floor((x0 + 20037508.342789244) / {t}) as bigint) as tx0, cast(ceil((x1 + 20037508.342789244) / {t}) as bigint) - 1 as tx1,
       cast(floor((20037508.342789244 - y1) / {t}) as bigint) as ty0, cast(ceil((20037508.342789244 - y0) / {t}) as bigint) - 1 as ty1 from im),
tl as (select *, unnest(range(ty0, ty1 + 1)) as y from (select *, unnest(range(tx0, tx1 + 1)) as x from rg) q),
ov as (select *, greatest(x * {t} - 20037508.342789244, x0) as ox0, least((x + 1) * {t} - 20037508.342789244, x1) as ox1,
       greatest(20037508.342789244 - (y + 1) * {t}, y0) as oy0, least(20037508.342789244 - y * {t}, y1) as oy1,
       x * {t} - 20037508.342789244 as tx, 20037508.342789244 - y * {t} as ty, {g}.0e0 / least(width, height) as gr from tl),
rt as (select *, greatest(0, (ox0 - x0) / (x1 - x0) - gr) as a0, least(1, (ox1 - x0) / (x1 - x0) + gr) as a1,
       greatest(0, (y1 - oy1) / (y1 - y0) - gr) as b0, least(1, (y1 - oy0) / (y1 - y0) + gr) as b1 from ov where ox1 > ox0 and oy1 > oy0),
sp as (select *, greatest(0, least(cast(floor(a0 * width + 0.5) as bigint), width - 1)) as src_x, greatest(0, least(cast(floor(b0 * height + 0.5) as bigint), height - 1)) as src_y,
       greatest(0, cast(floor((ox0 - tx) / {t} * 256) as bigint) - {g}) as dst_x, greatest(0, cast(floor((ty - oy1) / {t} * 256) as bigint) - {g}) as dst_y from rt)
select file_id, x, y, src_x, src_y, greatest(1, least(cast(floor((a1 - a0) * width + 0.5) as bigint), width - src_x)) as src_w,
       greatest(1, least(cast(floor((b1 - b0) * height + 0.5) as bigint), height - src_y)) as src_h, dst_x, dst_y,
       least(256 - dst_x, cast(ceil(round((ox1 - ox0) / {t} * 256, 6)) as bigint) + 2 * {g}) as dst_w, least(256 - dst_y, cast(ceil(round((oy1 - oy0) / {t} * 256, 6)) as bigint) + 2 * {g}) as dst_h
from sp"""


@query("r07_tile_pixel_windows", pixel_sql(2))
def r07(i):
    x0, y0 = grid.lonlat_to_metres("w", "s")
    x1, y1 = grid.lonlat_to_metres("e", "n")
    images = i.footprints.select(
        "file_id", x0.alias("min_x"), y0.alias("min_y"), x1.alias("max_x"), y1.alias("max_y"),
        F.round((F.col("e") - F.col("w")) / F.col("px") * 10).cast("bigint").alias("width"),
        F.round((F.col("n") - F.col("s")) / F.col("px") * 10).cast("bigint").alias("height"),
    )
    return footprints.tile_pixel_windows(images, F.lit(7)).drop("width", "height", "z")


@query("j15_connected_groups", """
with recursive ed as (select a.file_id as a, b.file_id as b from footprints a join footprints b on a.srs = b.srs and abs(a.px - b.px) <= 0.001
   and greatest(0, greatest(a.w - b.e, b.w - a.e)) <= 2 * greatest(a.px, b.px) and greatest(0, greatest(a.s - b.n, b.s - a.n)) <= 2 * greatest(a.px, b.px)),
rc(id, reach) as (select file_id, file_id from footprints union select rc.id, ed.b from rc join ed on ed.a = rc.reach)
select id as file_id, min(reach) as group_id from rc group by id""")
def j15(i):
    return groups.connected_groups(i.footprints)
