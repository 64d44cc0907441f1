"""Terrain tile bytes: reading and writing whole batches with numpy.

Bytes enter and leave as a ``content`` column of small binaries (one tile each); everything around
the packing is DataFrame work.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import encoding, grid
from tilewright.operators import mesh

TILE = ["z", "x", "y"]
GZIP_MAGIC = "1F8B"
# fixed values: layout of a heightmap tile and of a mesh tile
MASK_SIZES = (1, 256 * 256)
MESH_HEADER = "<3d2f4d3d"
WIDE_INDEX_ABOVE = 65536
NORMALS_EXTENSION = 1


# compression ----------------------------------------------------------------------------------

def inflate(store: DataFrame, column: str = "content") -> DataFrame:
    """Gzipped contents inflated, others unchanged; ``inflated`` tells which were."""

    @F.pandas_udf("binary")
    def gunzip(content: pd.Series) -> pd.Series:
        return content.map(lambda b: gzip.decompress(b) if b is not None and bytes(b[:2]) == b"\x1f\x8b" else b)

    zipped = F.hex(F.substring(column, 1, 2)) == GZIP_MAGIC
    return store.withColumns({"inflated": F.coalesce(zipped, F.lit(False)), column: gunzip(column)})


def deflate(store: DataFrame, column: str = "content") -> DataFrame:
    @F.pandas_udf("binary")
    def zipped(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else gzip.compress(bytes(b), mtime=0))

    return store.withColumn(column, zipped(column))


# heightmap tiles ------------------------------------------------------------------------------

def write_heightmap_tiles(heights: DataFrame, flags: DataFrame | None = None, n: int = 65) -> DataFrame:
    """Tile bytes from stored heights (z, x, y, col, row, stored) and child flags: z, x, y, content, heights.

    Heights run row by row from the north as 16-bit numbers, then the child byte and a one-byte
    land mask. A tile must have each of its ``n`` * ``n`` heights once; for others ``content`` is null, and ``heights`` tells
    how many of its places have one. No tile is left out.
    """
    place = (F.lit(n - 1) - F.col("row")) * n + F.col("col")
    known = F.when(F.col("stored").isNotNull() & F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1), place)
    g = heights.groupBy(*TILE).agg(
        F.sort_array(F.collect_list(F.struct(place.alias("k"), F.col("stored").alias("s")))).alias("_l"), F.count_distinct(known).alias("heights"), F.count(F.lit(1)).alias("_rows"))
    whole = (F.col("heights") == n * n) & (F.col("_rows") == n * n)
    g = g.select(*TILE, "heights", F.when(whole, F.transform("_l", lambda p: p["s"])).alias("_h"))
    g = g.join(flags.select(*TILE, "child_flags"), TILE, "left") if flags is not None else g.withColumn("child_flags", F.lit(0))

    @F.pandas_udf("binary")
    def pack(values: pd.Series, child: pd.Series) -> pd.Series:
        return pd.Series([
            None if v is None else np.clip(np.asarray(v), 0, 65535).astype("<u2").tobytes() + bytes([int(c), 0]) for v, c in zip(values, child)
        ], dtype=object)

    return g.select(*TILE, pack("_h", F.coalesce("child_flags", F.lit(0)).cast("int")).alias("content"), "heights")


def read_heightmap_tiles(store: DataFrame, n: int = 65) -> DataFrame:
    """Tiles as arrays: heights from the north-west, child flags and the mask. Wrong sizes are rejected."""
    body = n * n * 2 + 1
    sized = store.filter(F.octet_length("content").isin(*[body + m for m in MASK_SIZES]))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[TILE].assign(
                heights=[np.frombuffer(c, "<u2", n * n).astype("int32") for c in b["content"]],
                child_flags=[c[body - 1] for c in b["content"]],
                mask=[bytes(c[body:]) for c in b["content"]],
            )

    return sized.select(*TILE, "content").mapInPandas(unpack, "z bigint, x bigint, y bigint, heights array<int>, child_flags int, mask binary")


def heightmap_cells(tiles: DataFrame, n: int = 65) -> DataFrame:
    """Cells of heightmap tiles, rows counted from the south, heights in metres."""
    e = tiles.select(*TILE, F.posexplode("heights").alias("k", "s"))
    return e.select(*TILE, (F.col("k") % n).cast("bigint").alias("col"), (F.lit(n - 1) - F.floor(F.col("k") / n)).alias("row"), encoding.decode_height("s").alias("value"))


# mesh tiles -----------------------------------------------------------------------------------

def _field(array: str, name: str):
    """One field of an array of structs, as integers."""
    return F.transform(array, lambda p: p[name].cast("int"))


def mesh_parts(vertices: DataFrame, triangles: DataFrame, normals: bool = True) -> DataFrame:
    """One row per tile with everything its bytes hold, as encoded arrays.

    All parts are grouped by the tile, so the (merge) joins between them meet rows already in place.
    """
    stream = mesh.index_stream(triangles)
    number = stream.select(*TILE, "vid", "idx").distinct().hint("merge")
    q = mesh.quantize(vertices).join(number, [*TILE, "vid"])

    def listed(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
        g = df.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct(by, *columns))).alias("_l"))
        return g.select(*TILE, *[_field("_l", c).alias(c) for c in columns])

    points = listed(mesh.delta_encode(q, "idx"), "idx", ["du", "dv", "dq"])
    codes = listed(mesh.highwater_encode(stream), "pos", ["code"])
    edges = mesh.edge_vertices(q).join(number, [*TILE, "vid"]).groupBy(*TILE).agg(*[
        F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("place", "idx")))), lambda p: p["idx"].cast("int")).alias(s)
        for s in ("west", "south", "east", "north")
    ])
    sphere = mesh.bounding_sphere(vertices)
    header = mesh.mesh_header(vertices).select(*TILE, "min_h", "max_h", *[F.col("center_" + c).alias("box_" + c) for c in ("ex", "ey", "ez")])
    occlusion = mesh.horizon_occlusion(vertices, sphere)
    occlusion = occlusion.select(*TILE, *[F.col(c) for c in occlusion.columns if c.startswith("occlusion_")])
    out = header
    for part in (sphere, occlusion, points, codes, edges):
        out = out.join(part.hint("merge"), TILE)
    if normals:
        vn = mesh.vertex_normals(triangles, vertices)
        ox, oy = encoding.oct_encode("nx", "ny", "nz")
        out = out.join(listed(vn.select(*TILE, "vid", ox.alias("ox"), oy.alias("oy")).join(number, [*TILE, "vid"]), "idx", ["ox", "oy"]).hint("merge"), TILE)
    return out


_HEAD = ["box_ex", "box_ey", "box_ez", "min_h", "max_h", "center_ex", "center_ey", "center_ez", "radius"]


def write_mesh_tiles(vertices: DataFrame, triangles: DataFrame, normals: bool = True) -> DataFrame:
    """Quantized mesh bytes per tile."""
    parts = mesh_parts(vertices, triangles, normals)
    occlusion = [c for c in parts.columns if c.startswith("occlusion_")]
    arrays = ["du", "dv", "dq", "code", "west", "south", "east", "north"] + (["ox", "oy"] if normals else [])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            contents = []
            for row in b.to_dict("records"):
                count = len(row["du"])
                index = "<u4" if count > WIDE_INDEX_ABOVE else "<u2"
                out = bytearray(struct.pack(MESH_HEADER, *[row[c] for c in _HEAD], *[row[c] for c in occlusion]))
                out += struct.pack("<I", count)
                for c in ("du", "dv", "dq"):
                    out += np.asarray(row[c]).astype("<u2").tobytes()
                if index == "<u4" and len(out) % 4:
                    out += bytes(4 - len(out) % 4)
                out += struct.pack("<I", len(row["code"]) // 3) + np.asarray(row["code"]).astype(index).tobytes()
                for side in ("west", "south", "east", "north"):
                    out += struct.pack("<I", len(row[side])) + np.asarray(row[side]).astype(index).tobytes()
                if normals:
                    pairs = np.stack([np.asarray(row["ox"]), np.asarray(row["oy"])], axis=1).astype("u1")
                    out += struct.pack("<BI", NORMALS_EXTENSION, pairs.size) + pairs.tobytes()
                contents.append(bytes(out))
            yield b[TILE].assign(content=contents)

    return parts.select(*TILE, *_HEAD, *occlusion, *arrays).mapInPandas(pack, "z bigint, x bigint, y bigint, content binary")


def _decode(content: bytes) -> dict:
    head = struct.unpack_from(MESH_HEADER, content, 0)
    at = struct.calcsize(MESH_HEADER)
    (count,) = struct.unpack_from("<I", content, at)
    at += 4
    folded = np.frombuffer(content, "<u2", 3 * count, at).reshape(3, count).astype("int64")
    at += 6 * count
    u, v, q = np.cumsum((folded >> 1) ^ -(folded & 1), axis=1)
    wide = count > WIDE_INDEX_ABOVE
    index, size = ("<u4", 4) if wide else ("<u2", 2)
    if wide and at % 4:
        at += 4 - at % 4
    (faces,) = struct.unpack_from("<I", content, at)
    at += 4
    codes = np.frombuffer(content, index, 3 * faces, at).astype("int64")
    at += 3 * faces * size
    zeros = codes == 0
    indices = np.cumsum(zeros) - zeros - codes
    sides = {}
    for side in ("west", "south", "east", "north"):
        (n,) = struct.unpack_from("<I", content, at)
        sides[side] = np.frombuffer(content, index, n, at + 4).astype("int32")
        at += 4 + n * size
    normals = None
    while at + 5 <= len(content):
        kind, n = struct.unpack_from("<BI", content, at)
        if kind == NORMALS_EXTENSION:
            normals = np.frombuffer(content, "u1", n, at + 5).reshape(-1, 2).astype("int32")
        at += 5 + n  # other extensions are passed over
    return {
        "box": list(head[0:3]), "sphere": list(head[5:8]), "radius": head[8], "occlusion": list(head[9:12]),
        "ox": None if normals is None else normals[:, 0], "oy": None if normals is None else normals[:, 1], "min_h": head[3], "max_h": head[4], "u": u.astype("int32"), "v": v.astype("int32"), "q": q.astype("int32"), "indices": indices.astype("int32"), **sides,
    }


MESH_ARRAYS = "min_h double, max_h double, u array<int>, v array<int>, q array<int>, indices array<int>, west array<int>, south array<int>, east array<int>, north array<int>, " \
    "box array<double>, sphere array<double>, radius double, occlusion array<double>, ox array<int>, oy array<int>"


def read_mesh_tiles(store: DataFrame) -> DataFrame:
    """Quantized meshes as decoded arrays, one row per tile; ``ox`` and ``oy`` are null without normals.

    ``box`` and ``sphere`` are the centres of the tile's box and bounding sphere, ``occlusion`` the horizon occlusion point.
    """
    names = [f.split()[0] for f in MESH_ARRAYS.split(", ")]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[TILE].reset_index(drop=True), pd.DataFrame([_decode(c) for c in b["content"]], columns=names)], axis=1)

    return store.select(*TILE, "content").mapInPandas(unpack, "z bigint, x bigint, y bigint, " + MESH_ARRAYS)


def mesh_vertices(tiles: DataFrame) -> DataFrame:
    """Vertex rows of decoded meshes with position and height."""
    b = grid.geodetic_bounds("z", "x", "y")
    e = tiles.select(*TILE, "min_h", "max_h", F.posexplode(F.arrays_zip("u", "v", "q")).alias("vid", "p"))
    top = float(encoding.QUANTIZED_MAX)
    return e.select(
        *TILE, F.col("vid").cast("bigint").alias("vid"), F.col("p.u").alias("u"), F.col("p.v").alias("v"), F.col("p.q").alias("q"),
        (b["west"] + F.col("p.u") / top * (b["east"] - b["west"])).alias("lon"), (b["south"] + F.col("p.v") / top * (b["north"] - b["south"])).alias("lat"),
        (F.col("min_h") + F.col("p.q") / top * (F.col("max_h") - F.col("min_h"))).alias("h"),
    )


def mesh_triangles(tiles: DataFrame) -> DataFrame:
    """Triangle rows of decoded meshes."""
    k = F.sequence(F.lit(0), F.floor(F.size("indices") / 3).cast("int") - 1)
    e = tiles.filter(F.size("indices") > 0).select(*TILE, "indices", F.explode(k).alias("tid"))
    return e.select(*TILE, F.col("tid").cast("bigint").alias("tid"), *[F.get("indices", F.col("tid") * 3 + n).cast("bigint").alias(f"v{n}") for n in range(3)])
