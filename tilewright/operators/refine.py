"""Adaptive refinement of a right-triangle mesh over tiles.

Triangles live on an integer lattice of 2^16 steps per tile: ``z`` and the corners a (right angle),
b, c (ends of the longest edge). A corner is the same two numbers in every tile that touches it, so
edges match by equality and a split is shared exactly across tile borders.

A tile's triangles are one row, and so are its cells; both are tables bucketed by tile, so that a round moves neither:
tests, splits and their consequences inside a tile run where the tile lies. Between tiles only the splits of edges on a
tile border travel, to the one tile on the other side.
"""

from __future__ import annotations

import itertools
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geodesy, grid
from tilewright.session import checkpoint_dir, cut_lineage

from .rasters import reconcile_seams

STEPS = 2**16
SHAPE = ["z", "ax", "ay", "bx", "by", "cx", "cy"]
TILE = ["z", "x", "y"]
MAX_ROUNDS = 15  # fixed value: rounds of refinement at most
MAX_SETTLE = 64
WIDE = 2 * STEPS + 1  # an edge is named by the sums of its ends' coordinates, 0 to twice the steps: its middle


def start(tiles: DataFrame) -> DataFrame:
    """Two triangles per tile, on either side of the diagonal from south-west to north-east."""
    w, s = F.col("x") * STEPS, F.col("y") * STEPS
    e, n = w + STEPS, s + STEPS

    def tri(*pts):
        return F.struct(*[c.alias(k) for k, c in zip(SHAPE[1:], [v for p in pts for v in p])])

    two = F.explode(F.array(tri((e, s), (w, s), (e, n)), tri((w, n), (w, s), (e, n))))
    return tiles.select("z", two.alias("t")).select("z", "t.*", F.lit(False).alias("checked"))


def owner(df: DataFrame) -> DataFrame:
    """Adds the tile the middle of a triangle lies in."""
    return df.withColumns({
        "x": F.floor((F.col("ax") + F.col("bx") + F.col("cx")) / (3 * STEPS)),
        "y": F.floor((F.col("ay") + F.col("by") + F.col("cy")) / (3 * STEPS)),
    })


# tables of one row per tile --------------------------------------------------------------------

class Store:
    """Tables bucketed by tile in the checkpoint folder. Their names leave the catalogue with the store; the files stay there."""

    def __init__(self, spark):
        self.spark, self.names = spark, []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def save(self, df: DataFrame, dealt: bool = True) -> DataFrame:
        """``df`` as a bucketed table. Rows that aren't ``dealt`` by tile yet are shuffled once."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"tilewright_{uuid.uuid4().hex}"
        rows = df if dealt else df.repartition(buckets, *TILE)
        rows.write.bucketBy(buckets, *TILE).option("path", f"{checkpoint_dir(self.spark)}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)


def _packed(side: int):
    @F.pandas_udf("binary")
    def dense(places: pd.Series, values: pd.Series) -> pd.Series:
        out = np.full((len(places), side * side), np.nan)
        for k, (i, v) in enumerate(zip(places, values)):
            out[k, i] = v
        return pd.Series([row.tobytes() for row in out])

    return dense


def tile_grids(tile_cells: DataFrame, n: int) -> DataFrame:
    """One row per tile: its ``n`` x ``n`` cells, rows from the south, as 64-bit floats (NaN: none): ``own``, and ``shared``
    with the mean of all tiles that meet there on borders and corners, so that both sides of a border see the same heights."""
    at = (F.col("row") * n + F.col("col")).cast("int")
    cells = tile_cells.select(*TILE, "col", "row", F.col("value").cast("double").alias("value"), F.col("value").cast("double").alias("own"))
    both = reconcile_seams(cells, n).groupBy(*TILE).agg(
        F.collect_list(at).alias("at"), F.collect_list(F.coalesce("own", F.lit(math.nan))).alias("own"), F.collect_list(F.coalesce("value", F.lit(math.nan))).alias("shared"))
    pack = _packed(n)
    return both.select(*TILE, pack("at", "own").alias("own"), pack("at", "shared").alias("shared"))


STATE = "z long, x long, y long, shapes binary, checked binary, marks binary, sent binary, asked int"


def tile_meshes(triangles: DataFrame) -> DataFrame:
    """One row per tile: its triangles as corners in steps from the tile's south-west, and which are ``checked``; no marks yet."""
    t = owner(triangles)
    local = [(F.col(k) - F.col(k[1]) * STEPS).cast("int") for k in SHAPE[1:]]
    rows = t.groupBy(*TILE).agg(F.array_sort(F.collect_list(F.struct(F.array(*local).alias("c"), "checked"))).alias("t"))

    @F.pandas_udf("binary")
    def shapes(corners: pd.Series) -> pd.Series:
        return corners.map(lambda c: np.concatenate(c).astype(np.int32).tobytes())

    @F.pandas_udf("binary")
    def flags(checked: pd.Series) -> pd.Series:
        return checked.map(lambda c: np.asarray(c, dtype=np.uint8).tobytes())

    none = F.lit(b"")
    return rows.select(*TILE, shapes("t.c").alias("shapes"), flags("t.checked").alias("checked"), none.alias("marks"), none.alias("sent"), F.lit(0).alias("asked"))


# inside a tile -----------------------------------------------------------------------------------

def _mesh(shapes: bytes, checked: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(shapes, dtype=np.int32).reshape(-1, 6), np.frombuffer(checked, dtype=np.uint8).astype(bool)


def _middle(shapes: np.ndarray, p: int, q: int) -> np.ndarray:
    """Names of the edges between two corners (0, 1, 2)."""
    s = shapes.astype(np.int64)
    return (s[:, 2 * p + 1] + s[:, 2 * q + 1]) * WIDE + s[:, 2 * p] + s[:, 2 * q]


def _close(shapes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """``marks`` and the longest edges of all triangles that must split before a marked short edge can, repeated until nothing is added."""
    longest, legs = _middle(shapes, 1, 2), (_middle(shapes, 0, 1), _middle(shapes, 0, 2))
    while True:
        reached = longest[np.isin(legs[0], marks) | np.isin(legs[1], marks)]
        grown = np.union1d(marks, reached)
        if len(grown) == len(marks):
            return grown
        marks = grown


def _bisected(shapes: np.ndarray, checked: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every triangle whose longest edge is marked becomes two, which aren't checked."""
    hit = np.isin(_middle(shapes, 1, 2), marks)
    a, b, c = shapes[hit, 0:2], shapes[hit, 2:4], shapes[hit, 4:6]
    m = (b + c) // 2
    halves = np.concatenate([np.concatenate([m, a, b], axis=1), np.concatenate([m, a, c], axis=1)])
    return np.concatenate([shapes[~hit], halves]), np.concatenate([checked[~hit], np.zeros(len(halves), dtype=bool)])


def _split(shapes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tile's mesh after a round. A split triangle's halves may have a marked edge as their longest: the second pass takes those."""
    return _bisected(*_bisected(shapes, np.ones(len(shapes), dtype=bool), marks), marks)


def _on_border(marks: np.ndarray) -> np.ndarray:
    """Those of the edges whose middle lies on the tile's border; such edges lie on it as a whole."""
    v, u = marks // WIDE, marks % WIDE
    return marks[(u == 0) | (u == 2 * STEPS) | (v == 0) | (v == 2 * STEPS)]


def heights_at(shared: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Bilinear heights at steps from the south-west. A place on a line of cells takes nothing from beyond it, so that it is the same in
    all tiles that meet there; with a cell missing the first one's value counts, 0 without that."""
    n = len(shared)
    u, v = px * (n - 1) / STEPS, py * (n - 1) / STEPS
    c0, r0 = np.floor(u).astype(int), np.floor(v).astype(int)
    fx, fy = u - c0, v - r0
    c1, r1 = c0 + (fx > 0), r0 + (fy > 0)
    first = shared[r0, c0]
    blend = (first * (1 - fx) + shared[r0, c1] * fx) * (1 - fy) + (shared[r1, c0] * (1 - fx) + shared[r1, c1] * fx) * fy
    return np.nan_to_num(np.where(np.isnan(blend), first, blend), nan=0.0)


def _step(steps: list[tuple[int, float]], beyond: float, z: int) -> float:
    return next((value for upto, value in steps if z <= upto), beyond)


def _ecef(lon: np.ndarray, lat: np.ndarray, h: np.ndarray) -> np.ndarray:
    lam, phi = np.radians(lon), np.radians(lat)
    v = geodesy.EQUATORIAL_RADIUS / np.sqrt(1 - np.sin(phi) ** 2 * geodesy.ECCENTRICITY_SQUARED)
    flat = (v + h) * np.cos(phi)
    return np.stack([flat * np.cos(lam), flat * np.sin(lam), (v * (1 - geodesy.ECCENTRICITY_SQUARED) + h) * np.sin(phi)], axis=-1)


def _deviations(lon: np.ndarray, lat: np.ndarray, h: np.ndarray, own: np.ndarray, west: float, south: float, angle: float) -> np.ndarray:
    """Largest distance of a tile's cells from the plane of the triangle they lie in (corners: k x 3), 0 without a cell.

    Scan conversion: a triangle is cut into rows of cells, and a row into the span between its edges.
    """
    n = len(own)
    step = angle / (n - 1)
    turn = np.sign((lon[:, 1] - lon[:, 0]) * (lat[:, 2] - lat[:, 0]) - (lon[:, 2] - lon[:, 0]) * (lat[:, 1] - lat[:, 0]))
    first = np.maximum(0, np.ceil((lat.min(axis=1) - south) / step - 1e-9)).astype(int)
    last = np.minimum(n - 1, np.floor((lat.max(axis=1) - south) / step + 1e-9)).astype(int)
    rows = np.maximum(0, last - first + 1)
    k = np.repeat(np.arange(len(lon)), rows)
    row = np.arange(len(k)) - np.repeat(np.cumsum(rows) - rows, rows) + first[k]
    y = south + step * row
    low, high = np.full(len(k), -np.inf), np.full(len(k), np.inf)
    tolerance = step * step * 1e-9
    for p, q in ((0, 1), (1, 2), (2, 0)):
        dx, dy = ((v[:, q] - v[:, p])[k] * turn[k] for v in (lon, lat))
        with np.errstate(divide="ignore", invalid="ignore"):
            # dx * (y - lat) - dy * (x - lon) >= -tolerance
            border = lon[k, p] + (dx * (y - lat[k, p]) + tolerance) / dy
        low = np.where(dy < 0, np.maximum(low, border), low)
        high = np.where(dy > 0, np.minimum(high, border), high)
        outside = (dy == 0) & (dx * (y - lat[k, p]) < -tolerance)
        low = np.where(outside, np.inf, low)
    left = np.maximum(0, np.ceil(np.minimum((low - west) / step - 1e-9, n))).astype(int)
    right = np.minimum(n - 1, np.floor((high - west) / step + 1e-9)).astype(int)
    width = np.maximum(0, right - left + 1)
    t = np.repeat(np.arange(len(k)), width)
    col = np.arange(len(t)) - np.repeat(np.cumsum(width) - width, width) + left[t]
    k, row = k[t], row[t]
    dx, dy = west + step * col - lon[k, 0], south + step * row - lat[k, 0]
    x1, x2, y1, y2 = (lon[:, 1] - lon[:, 0])[k], (lon[:, 2] - lon[:, 0])[k], (lat[:, 1] - lat[:, 0])[k], (lat[:, 2] - lat[:, 0])[k]
    det = x1 * y2 - x2 * y1
    plane = h[k, 0] + (dx * y2 - dy * x2) / det * (h[k, 1] - h[k, 0]) + (x1 * dy - y1 * dx) / det * (h[k, 2] - h[k, 0])
    gap = np.abs(own[row, col] - plane)
    out = np.zeros(len(lon))
    np.maximum.at(out, k[~np.isnan(gap)], gap[~np.isnan(gap)])
    return out


def must_split(shapes: np.ndarray, tile: tuple[int, int, int], own: np.ndarray, shared: np.ndarray, extent: tuple, intensity: float) -> np.ndarray:
    """Whether each triangle is too large, or (unless too small) too far from the cells in it; outside the data: whether it rises."""
    z, x, y = tile
    angle = 180.0 / 2.0**z
    size = math.radians(angle) * grid.EARTH_RADIUS
    largest = size / 2.5 * (0.2 if z < 11 else 1.0)
    smallest = size * 0.1 / intensity * _step(grid.MIN_SIZE_STEPS, grid.MIN_SIZE_BEYOND, z)
    most = size * _step(grid.MAX_DEVIATION_STEPS, grid.MAX_DEVIATION_BEYOND, z) / intensity
    px, py = shapes[:, 0::2], shapes[:, 1::2]
    lon, lat = angle / STEPS * (px + x * STEPS) - 180.0, angle / STEPS * (py + y * STEPS) - 90.0
    h = heights_at(shared, px, py)
    edges = [np.sqrt((lon[:, p] - lon[:, q]) ** 2 + (lat[:, p] - lat[:, q]) ** 2) for p, q in ((0, 1), (1, 2), (2, 0))]
    metres = np.radians(np.max(edges, axis=0)) * geodesy.EQUATORIAL_RADIUS
    box = np.maximum(lon.max(axis=1) - lon.min(axis=1), lat.max(axis=1) - lat.min(axis=1))
    w, s, e, n = extent
    outside = (lon.min(axis=1) > e) | (lon.max(axis=1) < w) | (lat.min(axis=1) > n) | (lat.max(axis=1) < s)
    rises = h.max(axis=1) > most * (np.radians(box) * geodesy.EQUATORIAL_RADIUS / size * 0.8 + 0.2)
    out = np.where(metres > largest, True, outside & rises) & ~(metres < smallest)
    left = np.flatnonzero(~((metres < smallest) | (metres > largest) | outside))
    if len(left):
        gap = _deviations(lon[left], lat[left], h[left], own, angle * x - 180.0, angle * y - 90.0, angle)
        if z > 10:
            e0, e1, e2 = (_ecef(lon[left, k], lat[left, k], h[left, k]) for k in range(3))
            normal = np.cross(e1 - e0, e2 - e0)
            lam, phi = np.radians(angle * (x + 0.5) - 180.0), np.radians(angle * (y + 0.5) - 90.0)
            up = np.array([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])
            gap = gap * np.abs(normal @ up) / np.linalg.norm(normal, axis=1)
        out[left] = gap > most * (metres[left] / size * 0.8 + 0.2)
    return out


# rounds --------------------------------------------------------------------------------------------

def _row(tile: tuple, shapes: np.ndarray, checked: np.ndarray, marks: np.ndarray, sent: np.ndarray, asked: int) -> pa.Table:
    packed = (shapes.astype(np.int32), checked.astype(np.uint8), marks.astype(np.int64), sent.astype(np.int64))
    columns = [*[pa.array([v], pa.int64()) for v in tile], *[pa.array([p.tobytes()], pa.binary()) for p in packed], pa.array([asked], pa.int32())]
    return pa.Table.from_arrays(columns, names=[*TILE, "shapes", "checked", "marks", "sent", "asked"])


EMPTY = np.empty((0, 6), dtype=np.int64)


def _grids(cells: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Own and shared cells of a tile; a tile without cells has none anywhere."""
    if not cells.num_rows:
        return np.full((n, n), np.nan), np.full((n, n), np.nan)
    return tuple(np.frombuffer(cells[k][0].as_py()).reshape(n, n) for k in ("own", "shared"))


def _tested(state: DataFrame, grids: DataFrame, n: int, extent: tuple, intensity: float) -> DataFrame:
    """State after the splits marked in it, with the edges its unchecked triangles ask to split and what follows from them inside the tile."""
    def run(key: tuple, mesh: pa.Table, cells: pa.Table) -> pa.Table:
        tile = tuple(int(k.as_py()) for k in key)
        if not mesh.num_rows:
            return _row(tile, EMPTY, EMPTY, EMPTY, EMPTY, 0).slice(1)
        r = mesh.to_pylist()[0]
        shapes, checked = _mesh(r["shapes"], r["checked"])
        marks = np.frombuffer(r["marks"], dtype=np.int64)
        if len(marks):
            shapes, checked = _split(shapes, marks)
        todo = np.flatnonzero(~checked)
        asked = todo[:0]
        if len(todo):
            own, shared = _grids(cells, n)
            asked = todo[must_split(shapes[todo], tile, own, shared, extent, intensity)]
        marks = np.unique(_middle(shapes[asked], 1, 2))
        if len(marks):
            marks = _close(shapes, marks)
        return _row(tile, shapes, np.ones(len(shapes)), marks, _on_border(marks), len(asked))

    return state.groupBy(*TILE).cogroup(grids.groupBy(*TILE)).applyInArrow(run, STATE)


def _crossing(state: DataFrame) -> DataFrame:
    """Splits to be handed on, under the tile on the other side of the border and with its own name for the edge."""
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                z, x, y = (b.column(c)[k].as_py() for c in TILE)
                sent = np.frombuffer(b.column("sent")[k].as_py(), dtype=np.int64)
                v, u = sent // WIDE, sent % WIDE
                dx, dy = (u == 2 * STEPS).astype(int) - (u == 0), (v == 2 * STEPS).astype(int) - (v == 0)
                mark = (v - dy * 2 * STEPS) * WIDE + u - dx * 2 * STEPS
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sent), z)), pa.array(x + dx), pa.array(y + dy), pa.array(mark)], names=[*TILE, "mark"])

    return state.where(F.length("sent") > 0).select(*TILE, "sent").mapInArrow(run, "z long, x long, y long, mark long")


def _joined(state: DataFrame, arrived: DataFrame) -> DataFrame:
    """State with the splits that came over its borders, and what follows from them."""
    def run(key: tuple, mesh: pa.Table, marks: pa.Table) -> pa.Table:
        tile = tuple(int(k.as_py()) for k in key)
        if not mesh.num_rows:  # no tile on the other side
            return _row(tile, EMPTY, EMPTY, EMPTY, EMPTY, 0).slice(1)
        r = mesh.to_pylist()[0]
        shapes, checked = _mesh(r["shapes"], r["checked"])
        known = np.frombuffer(r["marks"], dtype=np.int64)
        grown, came = known, EMPTY[:, 0]
        if marks.num_rows:
            came = np.setdiff1d(marks["mark"].to_numpy(), known)
        if len(came):
            grown = _close(shapes, np.union1d(known, came))
        sent = np.setdiff1d(_on_border(grown), np.union1d(known, came))
        return _row(tile, shapes, checked, grown, sent, r["asked"])

    return state.groupBy(*TILE).cogroup(arrived.groupBy(*TILE)).applyInArrow(run, STATE)


def _round(store: Store, state: DataFrame, grids: DataFrame, n: int, extent: tuple, intensity: float) -> tuple[DataFrame, int]:
    """State with everything marked that splits in this round, and how many triangles asked for it."""
    state = store.save(_tested(state, grids, n, extent, intensity))
    asked = state.agg(F.sum("asked")).first()[0] or 0
    for _ in range(MAX_SETTLE):
        arrived = cut_lineage(_crossing(state))
        if arrived.isEmpty():
            return state, asked
        state = store.save(_joined(state, arrived))
    raise RuntimeError("splitting did not settle")


def _begin(store: Store, triangles: DataFrame, tile_cells: DataFrame, n: int, data_extent: DataFrame) -> tuple[DataFrame, DataFrame, tuple]:
    grids = store.save(tile_grids(tile_cells, n), dealt=False)
    state = store.save(tile_meshes(triangles), dealt=False)
    return state, grids, tuple(data_extent.select("w", "s", "e", "n").first())


def _finished(state: DataFrame) -> DataFrame:
    """Triangles after the splits marked in ``state``; those that are new aren't checked."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                shapes, checked = _mesh(r["shapes"], r["checked"])
                marks = np.frombuffer(r["marks"], dtype=np.int64)
                if len(marks):
                    shapes, checked = _split(shapes, marks)
                corners = shapes.astype(np.int64) + np.array([r["x"], r["y"]] * 3) * STEPS
                columns = [pa.array(np.full(len(shapes), r["z"])), *[pa.array(np.ascontiguousarray(c)) for c in corners.T], pa.array(checked)]
                yield pa.RecordBatch.from_arrays(columns, names=[*SHAPE, "checked"])

    return cut_lineage(state.select(*TILE, "shapes", "checked", "marks").mapInArrow(run, ", ".join(f"{k} long" for k in SHAPE) + ", checked boolean"))


def refine_once(triangles: DataFrame, tile_cells: DataFrame, n: int, data_extent: DataFrame, intensity: float = 4.0, before: int = 0) -> tuple[DataFrame, int]:
    """One round: split what must be split together with its twins. Returns the mesh and the splits asked for.

    With ``before``, up to so many rounds come first, on the same tables: neither cells nor triangles are dealt out again.
    """
    with Store(triangles.sparkSession) as store:
        state, grids, extent = _begin(store, triangles, tile_cells, n, data_extent)
        for _ in range(before + 1):
            state, asked = _round(store, state, grids, n, extent, intensity)
            if asked == 0:
                break
        return _finished(state), asked


def refine(triangles: DataFrame, tile_cells: DataFrame, n: int, data_extent: DataFrame, rounds: int | None = MAX_ROUNDS, intensity: float = 4.0) -> tuple[DataFrame, bool]:
    """Refine until no triangle fails the test, or for ``rounds`` rounds (None: as many as it takes). Returns the mesh and whether it has settled.

    Only triangles made in the round before are tested. Cells and triangles are shuffled once, before the first round. A chain of splits
    can run from tile to tile, so the rounds it takes have no fixed bound; they end, since no triangle below the smallest size asks to be split.
    """
    with Store(triangles.sparkSession) as store:
        state, grids, extent = _begin(store, triangles, tile_cells, n, data_extent)
        for _ in itertools.count() if rounds is None else range(rounds):
            state, asked = _round(store, state, grids, n, extent, intensity)
            if asked == 0:
                return _finished(state), True
        # whether the halves of the last round are fine shows in one more test of them
        settled = _tested(state, grids, n, extent, intensity).where("asked > 0").isEmpty()
        return _finished(state), settled


def flag(triangles: DataFrame, tile_cells: DataFrame, n: int, data_extent: DataFrame, intensity: float = 4.0) -> DataFrame:
    """Unchecked triangles (SHAPE) that must be split: too large, or too far from the raster."""
    extent = tuple(data_extent.select("w", "s", "e", "n").first())

    def run(key: tuple, mesh: pa.Table, cells: pa.Table) -> pa.Table:
        z, x, y = tile = tuple(int(k.as_py()) for k in key)
        found = EMPTY
        if mesh.num_rows:
            shapes, checked = _mesh(mesh["shapes"][0].as_py(), mesh["checked"][0].as_py())
            found = shapes[~checked]
            found = found[must_split(found, tile, *_grids(cells, n), extent, intensity)].astype(np.int64) + np.array([x, y] * 3) * STEPS
        return pa.Table.from_arrays([pa.array(np.full(len(found), z)), *[pa.array(np.ascontiguousarray(c)) for c in found.T]], names=SHAPE)

    both = tile_meshes(triangles).groupBy(*TILE).cogroup(tile_grids(tile_cells, n).groupBy(*TILE))
    return both.applyInArrow(run, ", ".join(f"{k} long" for k in SHAPE))


def to_tables(triangles: DataFrame, tile_cells: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The refined mesh as the two mesh tables, numbered inside each tile; faces run counter-clockwise."""
    point, face = "struct<vid:long,lon:double,lat:double,h:double>", "struct<tid:long,v0:long,v1:long,v2:long>"

    def run(key: tuple, mesh: pa.Table, cells: pa.Table) -> pa.Table:
        z, x, y = (int(k.as_py()) for k in key)
        v, f = [], []
        if mesh.num_rows:
            shapes, _ = _mesh(mesh["shapes"][0].as_py(), mesh["checked"][0].as_py())
            shapes = shapes[np.lexsort(shapes.T[::-1])]
            corners = shapes.reshape(-1, 2)
            places, number = np.unique(corners[:, 1].astype(np.int64) * WIDE + corners[:, 0], return_inverse=True)
            px, py = places % WIDE, places // WIDE
            a = 180.0 / 2.0**z / STEPS
            h = heights_at(_grids(cells, n)[1], px, py)
            v = [dict(zip(("vid", "lon", "lat", "h"), p)) for p in zip(range(len(px)), (a * (px + x * STEPS) - 180.0).tolist(), (a * (py + y * STEPS) - 90.0).tolist(), h.tolist())]
            p = shapes.astype(np.int64)
            turn = (p[:, 2] - p[:, 0]) * (p[:, 5] - p[:, 1]) - (p[:, 3] - p[:, 1]) * (p[:, 4] - p[:, 0])
            ids = number.reshape(-1, 3)
            ids = np.where((turn > 0)[:, None], ids, ids[:, [0, 2, 1]])
            f = [dict(zip(("tid", "v0", "v1", "v2"), t)) for t in zip(range(len(ids)), *ids.T.tolist())]
        kept = [[k] if mesh.num_rows else [] for k in (z, x, y)]
        lists = [[k] if mesh.num_rows else [] for k in (v, f)]
        types = [pa.list_(pa.struct([("vid", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("h", pa.float64())])), pa.list_(pa.struct([(k, pa.int64()) for k in ("tid", "v0", "v1", "v2")]))]
        return pa.Table.from_arrays([*[pa.array(k, pa.int64()) for k in kept], *[pa.array(k, t) for k, t in zip(lists, types)]], names=[*TILE, "v", "f"])

    both = tile_meshes(triangles).groupBy(*TILE).cogroup(tile_grids(tile_cells, n).groupBy(*TILE))
    out = cut_lineage(both.applyInArrow(run, f"z long, x long, y long, v array<{point}>, f array<{face}>"))
    return out.select(*TILE, F.inline("v")), out.select(*TILE, F.inline("f"))
