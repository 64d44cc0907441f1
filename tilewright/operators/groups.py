"""Groups of rasters that can be merged into one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import cut_lineage

from .index import FINEST, box_pairs, filed, own_level

PIXEL_TOLERANCE = 0.001  # fixed value: pixel sizes this close may be merged
GAP_PIXELS = 2  # fixed value: largest gap between merged rasters
SUBLEVELS = 2


BLOCK = 1 << 18  # edges that one task can take: a graph of no more is settled in one step, a larger one in rounds
HUBS = 1000  # a hub has more than 1 / HUBS of all edges, so there are fewer than HUBS of them


def _with_low(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (a, b; at most ``total``) with the smallest neighbour ``m`` of a.

    Hubs get theirs by broadcast, which leaves their edges where they are; the others by a join.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
    hubs = F.broadcast(low.filter(F.col("_n") * HUBS > total).select("a", "m"))
    rest = low.filter(F.col("_n") * HUBS <= total).select("a", "m")
    return edges.join(hubs, "a").unionByName(edges.join(hubs.select("a"), "a", "left_anti").join(rest, "a"))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all edges of a graph: node and root of every node but the roots, by hooking roots to smaller ones."""
    parts = [[b.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b")] for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] < root).any():
            root = root[root]
    below = np.flatnonzero(root < np.arange(len(names)))
    for k in range(0, len(below), 10_000):
        some = below[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[root[some]])], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id (``root``) of every node on an edge but the roots.

    ``edges`` has columns a and b. Up to BLOCK edges are settled by one task, whatever they look like; more by
    alternating star contraction, in which every step reduces neighbours to their minimum before it joins
    and the number of rounds grows with the logarithm of the number of nodes.
    """
    e = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")))
    last, total = None, e.count()
    if total <= BLOCK:
        return e.coalesce(1).mapInArrow(_settled, "node long, root long")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_low(both, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = _with_low(cut_lineage(large), 2 * total)
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = cut_lineage(small)
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        total = state["n"]
        if state == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state
    raise RuntimeError("components did not settle; raise the number of rounds")


def _relabel(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``comp`` of each node replaced by its root where it has one."""
    r = roots.select(F.col("node").alias("comp"), "root")
    return nodes.join(r, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")


def connected_groups(footprints: DataFrame, tolerance: float = PIXEL_TOLERANCE, gap_pixels: int = GAP_PIXELS) -> DataFrame:
    """``group_id`` (smallest file_id) of rasters linked by being mergeable.

    Mergeable: same reference system, pixel sizes within the tolerance, gap of at most two pixels
    in x and in y. Crowded places do not lead to all pairs being formed:

    1. identical extents become one node;
    2. a raster that wholly covers a small lattice cell meets every raster touching that cell, so
       they are linked to one coverer of the cell: other coverers by all cells they touch, the rest by two corners;
    3. rasters outside the largest group of their pixel size are compared with all others, in lattice
       cells that still hold different groups.
    """
    same = ["srs", "px", "w", "s", "e", "n"]
    nodes = footprints.groupBy(*same).agg(F.min("file_id").alias("comp"))
    nodes = cut_lineage(nodes.withColumn("node", F.col("comp")))
    lv = F.least(F.lit(FINEST + SUBLEVELS), own_level("w", "s", "e", "n") + SUBLEVELS)
    cells = F.pow(F.lit(2.0), F.col("_lv"))

    def span(lo: str, hi: str):
        first = F.ceil((F.col(lo) + 180.0) / 360.0 * cells)
        last = F.floor((F.col(hi) + 180.0) / 360.0 * cells) - 1
        return F.when(first <= last, F.sequence(first, last))

    covered = (
        nodes.withColumn("_lv", lv).withColumn("_cx", F.explode(span("w", "e"))).withColumn("_cy", F.explode(span("s", "n")))
    )
    key = ["srs", "px", "_lv", "_cx", "_cy"]
    hubs = cut_lineage(covered.groupBy(*key).agg(F.min("node").alias("hub")))
    lowest = nodes.agg(F.min(lv)).scalar()
    # hubs look at all cells they touch, the others, of which there may be any number in a cell, at those of two corners
    among = nodes.join(hubs.select(F.col("hub").alias("node")).distinct(), "node", "left_semi")
    corners = nodes.withColumn("_lv", F.explode(F.sequence(lowest, lv))).select("node", "srs", "px", "_lv", F.inline(F.array_distinct(F.array(*[
        F.struct(*[F.floor((F.col(v) + 180.0) / 360.0 * cells).alias(k) for v, k in ((x, "_cx"), (y, "_cy"))]) for x, y in ("ws", "en")]))))
    touching = filed(among.select("node", *same), "", F.sequence(lowest, lv)).select("node", *key).unionByName(corners)
    # the hubs a node touches, a bounded number, are linked with one of them; the node follows that one
    lists = cut_lineage(touching.join(hubs, key).groupBy("node").agg(F.collect_set("hub").alias("hubs")).withColumn("m", F.array_min("hubs")))
    lists_of = lists.select("node", "m")
    linked = lists.filter(F.size("hubs") > 1).select(F.explode("hubs").alias("a"), F.col("m").alias("b")).distinct()
    classes = _relabel(lists_of.groupBy(F.col("m").alias("comp")).agg(F.min("node").alias("low")).withColumn("m", F.col("comp")), components(linked))
    lowest_of = classes.groupBy("comp").agg(F.min("low").alias("root"))
    labels = classes.join(lowest_of, "comp").select("m", "root")
    nodes = nodes.join(lists_of, "node", "left").join(labels, "m", "left")
    nodes = cut_lineage(nodes.withColumn("comp", F.coalesce("root", "comp")).drop("m", "root"))

    reach = F.lit(float(gap_pixels)) * (F.col("px") + tolerance)
    band = F.floor(F.col("px") / tolerance)
    wide = nodes.select(
        "comp", "srs", "px", band.alias("band"), "w", "s", (F.col("e") + reach).alias("e"), (F.col("n") + reach).alias("n"),
        F.col("e").alias("e0"), F.col("n").alias("n0"),
    )
    wide = cut_lineage(wide)
    # two rasters of different groups: one of them is outside the largest group of its band, or the groups of two adjacent bands differ
    sizes = wide.groupBy("srs", "band", "comp").agg(F.count(F.lit(1)).alias("_n"))
    largest = cut_lineage(sizes.groupBy("srs", "band").agg(F.max_by("comp", F.struct("_n", "comp")).alias("_own")))
    above = largest.select("srs", (F.col("band") - 1).alias("band"), F.col("_own").alias("_above"))
    few = wide.join(largest.join(above, ["srs", "band"], "left"), ["srs", "band"]).filter("comp <> _own or _above <> _own").select(*wide.columns)
    few = cut_lineage(few.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))))
    pairs = box_pairs(few, wide, on=("srs", "band"), apart="comp")
    limit = F.greatest("a_px", "b_px") * gap_pixels
    gap_x = F.greatest(F.lit(0.0), F.col("a_w") - F.col("b_e0"), F.col("b_w") - F.col("a_e0"))
    gap_y = F.greatest(F.lit(0.0), F.col("a_s") - F.col("b_n0"), F.col("b_s") - F.col("a_n0"))
    close = (gap_x <= limit) & (gap_y <= limit) & (F.abs(F.col("a_px") - F.col("b_px")) <= tolerance)
    links = pairs.filter(close).select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct()
    nodes = _relabel(nodes, components(links))
    return footprints.select("file_id", *same).join(nodes.select(*same, "comp"), same).select("file_id", F.col("comp").alias("group_id"))
