"""Terrain meshes as two tables.

``vertices``: z, x, y, vid, lon, lat, h. ``triangles``: z, x, y, tid, v0, v1, v2. Adjacency is
never stored. One tile's mesh is small (at most a few thousand vertices), so windows and lists per
tile are bounded; everything is keyed by the tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import encoding, geodesy, grid
from tilewright.functions._cols import col

from .rasters import sample_tile_bilinear

TILE = ["z", "x", "y"]


def with_ecef(vertices: DataFrame) -> DataFrame:
    ex, ey, ez = geodesy.ecef("lon", "lat", "h")
    return vertices.withColumns({"ex": ex, "ey": ey, "ez": ez})


def corners(triangles: DataFrame, vertices: DataFrame, columns: list[str]) -> DataFrame:
    """Triangles with ``columns`` of their three vertices as ``<column>0..2``.

    The corners become rows, so one join on the vertex key serves all three. It is a merge join: both sides may come from rows
    that were multiplied, whose size Spark underrates, and neither may pass through the driver.
    """
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"v{n}").alias("vid")) for n in range(3)]))
    t = triangles.select(*TILE, "tid", "v0", "v1", "v2", k.alias("_k")).select(*TILE, "tid", "v0", "v1", "v2", F.col("_k.k").alias("_k"), F.col("_k.vid").alias("vid"))
    j = t.join(vertices.select(*TILE, "vid", *columns).hint("merge"), [*TILE, "vid"])
    picks = [F.max(F.when(F.col("_k") == n, F.col(c))).alias(f"{c}{n}") for n in range(3) for c in columns]
    return j.groupBy(*TILE, "tid").agg(*[F.max(f"v{n}").alias(f"v{n}") for n in range(3)], *picks)


def mesh_header(vertices: DataFrame) -> DataFrame:
    """Height range, earth-centred box and its centre per tile."""
    g = with_ecef(vertices).groupBy(*TILE).agg(
        F.count("*").alias("vertices"), F.min("h").alias("min_h"), F.max("h").alias("max_h"),
        *[f(c).alias(f"{n}_{c}") for c in ("ex", "ey", "ez") for f, n in ((F.min, "min"), (F.max, "max"))],
    )
    return g.withColumns({f"center_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in ("ex", "ey", "ez")})


def _distance(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = col(ax) - col(bx), col(ay) - col(by), col(az) - col(bz)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def bounding_sphere(vertices: DataFrame) -> DataFrame:
    """Smaller of two spheres around each tile's vertices.

    One is centred in the box, the other halfway along the widest of the three axis pairs (the
    vertices that are lowest and highest along an axis). Both reach to the farthest vertex.
    """
    axes = ("ex", "ey", "ez")
    p = F.struct(*axes)
    w = Window.partitionBy(*TILE)
    v = with_ecef(vertices).select(*TILE, "vid", *axes)
    for c in axes:
        rank = F.struct(F.round(c, 6), F.col("vid"))
        v = v.withColumns({f"_lo_{c}": F.min_by(p, rank).over(w), f"_hi_{c}": F.max_by(p, rank).over(w)})

    def span(c):
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return _distance(lo["ex"], lo["ey"], lo["ez"], hi["ex"], hi["ey"], hi["ez"])

    v = v.withColumns({f"_s_{c}": span(c) for c in axes})

    def widest(side):
        return (
            F.when((F.col("_s_ex") >= F.col("_s_ey")) & (F.col("_s_ex") >= F.col("_s_ez")), F.col(f"_{side}_ex"))
            .when(F.col("_s_ey") >= F.col("_s_ez"), F.col(f"_{side}_ey")).otherwise(F.col(f"_{side}_ez"))
        )

    v = v.withColumns({"_lo": widest("lo"), "_hi": widest("hi")})
    v = v.withColumns({
        **{f"_box_{c}": (F.col(f"_lo_{c}")[c] + F.col(f"_hi_{c}")[c]) / 2 for c in axes},
        **{f"_mid_{c}": (F.col("_lo")[c] + F.col("_hi")[c]) / 2 for c in axes},
    })
    g = v.groupBy(*TILE).agg(
        *[F.first(f"_{n}_{c}").alias(f"_{n}_{c}") for n in ("box", "mid") for c in axes],
        *[F.max(_distance("ex", "ey", "ez", *[f"_{n}_{c}" for c in axes])).alias(f"_r_{n}") for n in ("box", "mid")],
    )
    mid = F.col("_r_mid") < F.col("_r_box")
    return g.select(
        *TILE, *[F.when(mid, F.col(f"_mid_{c}")).otherwise(F.col(f"_box_{c}")).alias(f"center_{c}") for c in axes],
        F.least("_r_box", "_r_mid").alias("radius"),
    )


# fixed value: polar radius positions are scaled by before occlusion
SCALE_POLAR = 6356752.3142451793


def horizon_occlusion(vertices: DataFrame, spheres: DataFrame) -> DataFrame:
    """Point below which a tile is hidden, in ellipsoid-scaled coordinates."""
    radii = {"ex": geodesy.EQUATORIAL_RADIUS, "ey": geodesy.EQUATORIAL_RADIUS, "ez": SCALE_POLAR}
    j = with_ecef(vertices).join(spheres.hint("merge"), TILE)
    j = j.withColumns({**{"_p" + c: F.col(c) / s for c, s in radii.items()}, **{"_c" + c: F.col("center_" + c) / s for c, s in radii.items()}})
    px, py, pz, cx, cy, cz = (F.col(k) for k in ("_pex", "_pey", "_pez", "_cex", "_cey", "_cez"))
    j = j.withColumn("_m2", px * px + py * py + pz * pz).withColumn("_m", F.sqrt("_m2"))
    m = F.col("_m")
    j = j.withColumns({"_dx": px / m, "_dy": py / m, "_dz": pz / m, "_m2": F.greatest(F.lit(1.0), "_m2"), "_m": F.greatest(F.lit(1.0), m)})
    dx, dy, dz = F.col("_dx"), F.col("_dy"), F.col("_dz")
    kx, ky, kz = dy * cz - dz * cy, dz * cx - dx * cz, dx * cy - dy * cx
    cos_b = F.lit(1.0) / F.col("_m")
    magnitude = F.lit(1.0) / (
        (dx * cx + dy * cy + dz * cz) * cos_b - F.sqrt(kx * kx + ky * ky + kz * kz) * F.sqrt(F.col("_m2") - 1.0) * cos_b
    )
    g = j.groupBy(*TILE, "_cex", "_cey", "_cez").agg(F.max(magnitude).alias("magnitude"))
    return g.select(*TILE, "magnitude", *[(F.col("_c" + c) * F.col("magnitude")).alias("occlusion_" + c[1]) for c in radii])


def with_face_normal(t: DataFrame) -> DataFrame:
    """Unit normal (nx, ny, nz) and ``space_area`` from corners ``ex0, ey0, ez0`` .. ``ez2``."""
    keep = t.columns
    t = t.withColumns({f"_{n}{c}": F.col(f"{c}{n}") - F.col(f"{c}0") for n in (1, 2) for c in ("ex", "ey", "ez")})
    ax, ay, az, bx, by, bz = (F.col(f"_{n}{c}") for n in (1, 2) for c in ("ex", "ey", "ez"))
    t = t.withColumns({"_nx": ay * bz - az * by, "_ny": az * bx - ax * bz, "_nz": ax * by - ay * bx})
    size = F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + F.col("_nz") * F.col("_nz"))
    t = t.withColumn("_len", F.nullif(size, F.lit(0.0)))
    return t.select(*keep, *[(F.col(f"_n{k}") / F.col("_len")).alias(f"n{k}") for k in "xyz"], (F.col("_len") / 2).alias("space_area"))


def face_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Unit normal and area of each triangle in earth-centred space."""
    t = with_face_normal(corners(triangles, with_ecef(vertices), ["ex", "ey", "ez"]))
    return t.select(*TILE, "tid", "v0", "v1", "v2", "nx", "ny", "nz", F.col("space_area").alias("area"))


def vertex_normals(triangles: DataFrame, vertices: DataFrame, weight: str = "unit") -> DataFrame:
    """Normal per vertex: sum of its faces' normals, each counted once or by area."""
    f = face_normals(triangles, vertices)
    w = F.col("area") if weight == "area" else F.lit(1.0)
    each = f.select(*TILE, F.explode(F.array("v0", "v1", "v2")).alias("vid"), *[(F.col(f"n{k}") * w).alias(f"n{k}") for k in "xyz"])
    g = each.groupBy(*TILE, "vid").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"])
    g = g.withColumn("_l", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")))
    return g.select(*TILE, "vid", *[(F.col(f"n{k}") / F.col("_l")).alias(f"n{k}") for k in "xyz"])


def bucket_faces(points: DataFrame, depth: int, low: tuple, high: tuple) -> DataFrame:
    """Points per octant cell of a box, ``depth`` halvings deep (coordinates px, py, pz)."""
    n = 2**depth

    def index(c, lo, hi):
        v = F.floor((F.col(c) - lo) / (hi - lo) * n)
        return F.greatest(F.lit(0).cast("bigint"), F.least(v, F.lit(n - 1).cast("bigint")))

    cells = [index(c, lo, hi).alias(a) for a, c, lo, hi in zip(("ox", "oy", "oz"), ("px", "py", "pz"), low, high)]
    return points.select(*cells).groupBy("ox", "oy", "oz").agg(F.count("*").alias("points"))


def measured(t: DataFrame) -> DataFrame:
    """Plane area, longest edge (degrees) and size in metres from corners ``lon0, lat0`` .. ``lat2``."""

    def edge(a, b):
        dx, dy = F.col(f"lon{a}") - F.col(f"lon{b}"), F.col(f"lat{a}") - F.col(f"lat{b}")
        return F.sqrt(dx * dx + dy * dy)

    cross = (F.col("lon1") - F.col("lon0")) * (F.col("lat2") - F.col("lat0")) - (F.col("lon2") - F.col("lon0")) * (F.col("lat1") - F.col("lat0"))
    longest = F.greatest(edge(0, 1), edge(1, 2), edge(2, 0))
    return t.withColumns({"area": F.abs(cross) / 2, "longest": longest}).withColumn("metres", geodesy.to_metres("longest"))


def triangle_sizes(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with corner positions, plane area, longest edge (degrees) and size in metres."""
    return measured(corners(triangles, vertices, ["lon", "lat", "h"]))


def triangle_stats(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    s = triangle_sizes(triangles, vertices)
    return s.groupBy(*TILE).agg(
        F.count("*").alias("triangles"), F.sum("area").alias("area"), F.max("longest").alias("longest_edge"), F.max("metres").alias("largest_metres"),
    )


def edge_adjacency(triangles: DataFrame) -> DataFrame:
    """Each undirected edge with its one or two triangles; ``twin`` is null on the border."""
    edges = F.array(*[F.struct(F.least(f"v{a}", f"v{b}").alias("p"), F.greatest(f"v{a}", f"v{b}").alias("q")) for a, b in ((0, 1), (1, 2), (2, 0))])
    e = triangles.select(*TILE, "tid", F.explode(edges).alias("e"))
    g = e.groupBy(*TILE, F.col("e.p").alias("p"), F.col("e.q").alias("q")).agg(
        F.count("*").alias("faces"), F.min("tid").alias("tid"), F.max("tid").alias("_hi"))
    return g.select(*TILE, "p", "q", "faces", "tid", F.when(F.col("faces") > 1, F.col("_hi")).alias("twin"))


def plane_height(lon, lat, suffixes=("0", "1", "2")) -> Column:
    """Height at a position of the plane through the corners ``lon0, lat0, h0`` .. ``h2``."""
    (x0, y0, h0), (x1, y1, h1), (x2, y2, h2) = ((F.col("lon" + s), F.col("lat" + s), F.col("h" + s)) for s in suffixes)
    dx, dy = col(lon) - x0, col(lat) - y0
    det = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
    s = (dx * (y2 - y0) - dy * (x2 - x0)) / det
    t = ((x1 - x0) * dy - (y1 - y0) * dx) / det
    return h0 + s * (h1 - h0) + t * (h2 - h0)


def cells_in_triangles(sized: DataFrame, n: int) -> DataFrame:
    """Lattice cells (``n`` per side, edge to edge) lying inside each triangle or on its border.

    Scan conversion: a triangle yields its rows of cells, a row the span of columns between the edges, so that no cell
    outside is made. Edges may run either way round; a triangle without area holds no cells.
    """
    b = grid.geodetic_bounds("z", "x", "y")
    a = grid.tile_angle("z") / (n - 1)
    zero, top = F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")
    cross = (F.col("lon1") - F.col("lon0")) * (F.col("lat2") - F.col("lat0")) - (F.col("lon2") - F.col("lon0")) * (F.col("lat1") - F.col("lat0"))
    t = sized.withColumns({"_w": b["west"], "_s": b["south"], "_a": a, "_turn": F.signum(cross)}).filter("_turn <> 0")

    def listed(low, high, base):
        first = F.greatest(zero, F.ceil((low - F.col(base)) / F.col("_a") - 1e-9))
        last = F.least(top, F.floor((high - F.col(base)) / F.col("_a") + 1e-9))
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    t = t.withColumn("row", listed(F.least("lat0", "lat1", "lat2"), F.greatest("lat0", "lat1", "lat2"), "_s"))
    t = t.withColumn("clat", F.col("_s") + F.col("_a") * F.col("row"))
    tolerance = F.col("_a") * F.col("_a") * 1e-9
    lows, highs, level = [F.least("lon0", "lon1", "lon2")], [F.greatest("lon0", "lon1", "lon2")], F.lit(True)
    for p, q in ((0, 1), (1, 2), (2, 0)):
        dx, dy = (F.col(f"lon{q}") - F.col(f"lon{p}")) * F.col("_turn"), (F.col(f"lat{q}") - F.col(f"lat{p}")) * F.col("_turn")
        # inside: dx * (clat - lat) - dy * (clon - lon) >= -tolerance
        reach = dx * (F.col("clat") - F.col(f"lat{p}")) + tolerance
        border = F.col(f"lon{p}") + F.try_divide(reach, dy)
        lows.append(F.when(dy < 0, border))
        highs.append(F.when(dy > 0, border))
        level = level & ((dy != 0) | (reach >= 0))
    t = t.filter(level).withColumn("col", listed(F.greatest(*lows), F.least(*highs), "_w"))
    return t.withColumn("clon", F.col("_w") + F.col("_a") * F.col("col")).drop("_w", "_s", "_a", "_turn")


def normal_cosine() -> Column:
    """Cosine between a triangle's normal and the ellipsoid normal at its tile's centre.

    Uses the face normal columns nx, ny, nz of :func:`face_normals`.
    """
    b = grid.geodetic_bounds("z", "x", "y")
    lam, phi = F.radians((b["west"] + b["east"]) / 2), F.radians((b["south"] + b["north"]) / 2)
    return F.col("nx") * F.cos(phi) * F.cos(lam) + F.col("ny") * F.cos(phi) * F.sin(lam) + F.col("nz") * F.sin(phi)


def triangle_deviation(triangles: DataFrame, vertices: DataFrame, tile_cells: DataFrame, n: int, intensity: float = 4.0) -> DataFrame:
    """Largest distance between raster cells and the plane of each triangle, against the limit.

    The distance counts along the surface normal beyond level 10. The limit shrinks with the
    triangle: 0.8 * (size / tile size) + 0.2 of the level's deviation.
    """
    sized = triangle_sizes(triangles, vertices)
    normals = face_normals(triangles, vertices).select(*TILE, "tid", F.abs(normal_cosine()).alias("cosine"))
    return deviations(sized.join(normals.hint("merge"), [*TILE, "tid"]), tile_cells, n, [*TILE, "tid"], intensity)


def deviations(sized: DataFrame, tile_cells: DataFrame, n: int, keys: list[str], intensity: float = 4.0) -> DataFrame:
    """:func:`triangle_deviation` for triangles that carry their corners, ``metres`` and ``cosine``."""
    got = cells_in_triangles(sized, n).join(tile_cells.select(*TILE, "col", "row", "value").hint("merge"), [*TILE, "col", "row"])
    cosine = F.when(F.col("z") > 10, F.col("cosine")).otherwise(1.0)
    gap = F.abs(F.col("value") - plane_height("clon", "clat")) * cosine
    worst = got.groupBy(*dict.fromkeys([*TILE, *keys])).agg(F.max(gap).alias("deviation"), F.max("metres").alias("metres"))
    limit = grid.refine_limits("z", intensity)["max_deviation"] * (F.col("metres") / grid.tile_size_metres("z") * 0.8 + 0.2)
    return worst.select(*dict.fromkeys([*TILE, *keys]), "deviation", limit.alias("limit"), (F.col("deviation") > limit).alias("exceeds"))


def must_refine(sized: DataFrame, data_extent: DataFrame, intensity: float = 4.0) -> DataFrame:
    """Cheap arms of the refinement test: ``refine`` is null where the deviation must decide.

    Too small: no. Too large: yes. Outside the data: yes when a corner rises above the limit.
    """
    lim = grid.refine_limits("z", intensity)
    ext = data_extent.select(F.struct("w", "s", "e", "n")).scalar()
    s = sized.withColumn("_x", ext)
    lo = {a: F.least(*[a + k for k in "012"]) for a in ("lon", "lat")}
    hi = {a: F.greatest(*[a + k for k in "012"]) for a in ("lon", "lat")}
    outside = (lo["lon"] > F.col("_x.e")) | (hi["lon"] < F.col("_x.w")) | (lo["lat"] > F.col("_x.n")) | (hi["lat"] < F.col("_x.s"))
    share = F.greatest(hi["lon"] - lo["lon"], hi["lat"] - lo["lat"])
    limit = lim["max_deviation"] * (geodesy.to_metres(share) / grid.tile_size_metres("z") * 0.8 + 0.2)
    verdict = (
        F.when(F.col("metres") < lim["min_triangle"], False).when(F.col("metres") > lim["max_triangle"], True)
        .when(outside, F.greatest("h0", "h1", "h2") > limit)
    )
    return s.withColumn("refine", verdict).drop("_x")


def initial_mesh(tiles: DataFrame, tile_cells: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Two triangles per tile over its corners; heights from the tile raster, 0 without data."""
    b = grid.geodetic_bounds("z", "x", "y")
    order = (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"))
    corner = F.explode(F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("vid"), b[x].alias("lon"), b[y].alias("lat")) for k, (x, y) in enumerate(order)
    ]))
    v = tiles.select(*TILE, corner.alias("c")).select(*TILE, "c.*")
    v = sample_tile_bilinear(v, tile_cells, n).select(*TILE, "vid", "lon", "lat", F.coalesce("value", F.lit(0.0)).alias("h"))
    faces = F.explode(F.array(*[
        F.struct(*[F.lit(i).cast("bigint").alias(a) for a, i in zip(("tid", "v0", "v1", "v2"), f)]) for f in ((0, 0, 1, 2), (1, 0, 2, 3))
    ]))
    return v, tiles.select(*TILE, faces.alias("f")).select(*TILE, "f.*")


def refresh_elevation(vertices: DataFrame, tile_cells: DataFrame, n: int) -> DataFrame:
    """Heights taken again from the raster of the tile each vertex lies in; kept where it has none."""
    got = sample_tile_bilinear(vertices, tile_cells, n)
    return got.withColumn("h", F.coalesce("value", "h")).drop("value")


def to_children(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Owner of each triangle on the next level: the quarter its barycentre lies in."""
    t = corners(triangles, vertices, ["lon", "lat"])
    b = grid.geodetic_bounds("z", "x", "y")
    mid_x, mid_y = (b["west"] + b["east"]) / 2, (b["south"] + b["north"]) / 2
    lon, lat = (F.col("lon0") + F.col("lon1") + F.col("lon2")) / 3, (F.col("lat0") + F.col("lat1") + F.col("lat2")) / 3
    return t.select(
        *TILE, "tid", (F.col("z") + 1).alias("child_z"),
        (F.col("x") * 2 + (lon >= mid_x).cast("bigint")).alias("child_x"), (F.col("y") * 2 + (lat >= mid_y).cast("bigint")).alias("child_y"),
    )


def split_to_sets(triangles: DataFrame, owners: DataFrame) -> DataFrame:
    """Triangles under the key of the tile that owns them; faces are renumbered per owner."""
    t = triangles.join(owners.hint("merge"), [*TILE, "tid"])
    number = F.row_number().over(Window.partitionBy("child_z", "child_x", "child_y").orderBy("x", "y", "tid")) - 1
    return t.select(
        F.col("child_z").alias("z"), F.col("child_x").alias("x"), F.col("child_y").alias("y"), number.cast("bigint").alias("tid"), "v0", "v1", "v2")


def clamp_edges(vertices: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Vertices on the border moved to the exact tile bounds."""
    b = grid.geodetic_bounds("z", "x", "y")

    def snap(c, lo, hi):
        v = F.col(c)
        return F.when(F.abs(v - lo) <= tolerance, lo).when(F.abs(v - hi) <= tolerance, hi).otherwise(v)

    return vertices.withColumns({"lon": snap("lon", b["west"], b["east"]), "lat": snap("lat", b["south"], b["north"])})


def quantize(vertices: DataFrame, mode: str = "round") -> DataFrame:
    """u, v, q: position and height of each vertex as 0..32767 in its tile's box."""
    b = grid.geodetic_bounds("z", "x", "y")
    w = Window.partitionBy(*TILE)
    v = vertices.withColumns({"_lo": F.min("h").over(w), "_hi": F.max("h").over(w)})
    return v.withColumns({
        "u": encoding.quantize("lon", b["west"], b["east"], mode), "v": encoding.quantize("lat", b["south"], b["north"], mode),
        "q": encoding.quantize("h", "_lo", "_hi", mode),
    }).drop("_lo", "_hi")


def weld_vertices(vertices: DataFrame, triangles: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Vertices in the same cell of an ``eps`` lattice become the first of them.

    Returns the vertices kept and the triangles over them; triangles left without area are dropped.
    """
    cell = [F.floor(F.col(c) / eps + 0.5) for c in ("lon", "lat")]
    w = Window.partitionBy(*TILE, *cell)
    keyed = vertices.withColumn("_to", F.min("vid").over(w))
    kept = keyed.filter(F.col("vid") == F.col("_to")).drop("_to")
    t = corners(triangles, keyed, ["_to"])
    t = t.select(*TILE, "tid", *[F.col(f"_to{k}").alias(f"v{k}") for k in range(3)])
    return kept, t.filter("v0 <> v1 and v1 <> v2 and v2 <> v0")


def delta_encode(quantized: DataFrame, order: str = "vid") -> DataFrame:
    """First differences of u, v and q in vertex order, sign folded."""
    w = Window.partitionBy(*TILE).orderBy(order)
    return quantized.select(*TILE, order, *[
        encoding.zigzag(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(f"d{c}") for c in ("u", "v", "q")])


def delta_decode(deltas: DataFrame, order: str = "vid") -> DataFrame:
    w = Window.partitionBy(*TILE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select(*TILE, order, *[F.sum(encoding.unzigzag(f"d{c}")).over(w).alias(c) for c in ("u", "v", "q")])


def index_stream(triangles: DataFrame) -> DataFrame:
    """Corners in writing order with vertices renumbered by first use: z, x, y, pos, vid, idx."""
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"v{n}").alias("vid")) for n in range(3)]))
    s = triangles.select(*TILE, "tid", k.alias("c")).select(*TILE, (F.col("tid") * 3 + F.col("c.k")).alias("pos"), F.col("c.vid").alias("vid"))
    first = F.min("pos").over(Window.partitionBy(*TILE, "vid"))
    s = s.withColumn("_first", first)
    # dense_rank over first positions numbers vertices in the order they appear
    return s.withColumn("idx", (F.dense_rank().over(Window.partitionBy(*TILE).orderBy("_first")) - 1).cast("bigint")).drop("_first")


def highwater_encode(stream: DataFrame) -> DataFrame:
    """Each index as its distance below the highest index seen so far plus one."""
    w = Window.partitionBy(*TILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return stream.select(*TILE, "pos", (F.coalesce(F.max("idx").over(w) + 1, F.lit(0)) - F.col("idx")).alias("code"))


def highwater_decode(codes: DataFrame) -> DataFrame:
    w = Window.partitionBy(*TILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    zeros = F.sum((F.col("code") == 0).cast("bigint")).over(w)
    return codes.select(*TILE, "pos", (F.coalesce(zeros, F.lit(0)) - F.col("code")).alias("idx"))


def edge_vertices(quantized: DataFrame) -> DataFrame:
    """Vertices on each side of a tile in writing order.

    West runs down, south to the right, east up, north to the left.
    """
    top = encoding.QUANTIZED_MAX
    sides = F.array(
        F.when(F.col("u") == 0, F.struct(F.lit("west").alias("side"), (-F.col("v")).alias("along"))),
        F.when(F.col("v") == 0, F.struct(F.lit("south").alias("side"), F.col("u").alias("along"))),
        F.when(F.col("u") == top, F.struct(F.lit("east").alias("side"), F.col("v").alias("along"))),
        F.when(F.col("v") == top, F.struct(F.lit("north").alias("side"), (-F.col("u")).alias("along"))),
    )
    e = quantized.select(*TILE, "vid", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("e"))
    w = Window.partitionBy(*TILE, "e.side").orderBy("e.along", "vid")
    return e.select(*TILE, F.col("e.side").alias("side"), (F.row_number().over(w) - 1).alias("place"), "vid")
