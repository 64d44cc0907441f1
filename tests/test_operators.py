"""Operators against brute force and invariants, with crowded keys."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import groups, index, ordering, rasters, refine, tilesets
from tilewright.sources import codecs, listing, sinks


def find_groups(boxes):
    root = list(range(len(boxes)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(boxes)):
        for b in range(a):
            p, q = boxes[a], boxes[b]
            lim = 2 * max(p["px"], q["px"])
            gx = max(0, p["w"] - q["e"], q["w"] - p["e"])
            gy = max(0, p["s"] - q["n"], q["s"] - p["n"])
            if p["srs"] == q["srs"] and abs(p["px"] - q["px"]) <= 0.001 and gx <= lim and gy <= lim:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {boxes[a]["file_id"]: boxes[find(a)]["file_id"] for a in range(len(boxes))}


def test_groups_with_a_crowded_place(spark):
    rnd = random.Random(7)
    boxes = []
    for k in range(240):
        crowded = k % 3 == 0
        w, s = (10 + rnd.random() * 0.5, 10 + rnd.random() * 0.5) if crowded else (rnd.uniform(-60, 60), rnd.uniform(-40, 40))
        if k % 12 == 0:
            w, s = 10.0, 10.0
        dx, dy = rnd.choice([0.02, 0.5, 1.0, 6.0]), rnd.choice([0.02, 0.5, 1.0, 6.0])
        boxes.append({"file_id": k, "w": w, "s": s, "e": w + dx, "n": s + dy, "px": rnd.choice([0.01, 0.0104, 0.05]), "srs": rnd.choice(["a", "b"])})
    df = spark.createDataFrame(boxes, "file_id long, w double, s double, e double, n double, px double, srs string")
    got = {r.file_id: r.group_id for r in groups.connected_groups(df).collect()}
    assert got == find_groups(boxes)


def test_components_of_a_long_chain(spark):
    n = 3000
    edges = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("a"), ((F.col("id") + 1) * 7919 % n).alias("b"))
    c = groups.components(edges)
    assert c.count() == n - 1 and c.select("root").distinct().collect() == [(0,)]


def test_components_of_a_star(spark):
    hub = spark.range(1, 4000).select(F.lit(9000).cast("long").alias("a"), "id").toDF("a", "b")
    tail = spark.createDataFrame([(9001, 9000), (9002, 9001), (5000, 9002), (7000, 7001)], "a long, b long")
    c = {r.node: r.root for r in groups.components(hub.unionByName(tail)).collect()}
    assert set(c.values()) == {1, 7000} and c[7001] == 7000 and c[5000] == c[9002] == c[3999] == 1 and len(c) == 3999 - 1 + 4 + 1


def test_components_of_graphs_up_to_a_block_and_beyond(spark, monkeypatch):
    """A graph that one task can take is written once; a larger one goes on in rounds. Both give the same."""
    rnd = random.Random(11)
    edges = [(rnd.randrange(2000) * 3, rnd.randrange(2000) * 3) for _ in range(1500)] + [(k, k + 1) for k in range(10_000, 10_300)] + [(7, 7)] * 2
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {v: find(v) for v in root if find(v) != v}
    df = spark.createDataFrame(edges + edges[:50], "a long, b long").repartition(3)
    cuts = []
    monkeypatch.setattr(groups, "cut_lineage", lambda d, real=groups.cut_lineage: cuts.append(1) or real(d))
    assert sorted(groups.components(df).collect()) == sorted(want.items()) and len(cuts) == 1
    monkeypatch.setattr(groups, "BLOCK", 100)
    assert sorted(groups.components(df).collect()) == sorted(want.items()) and len(cuts) > 2
    assert groups.components(df.limit(0)).count() == 0


def test_box_pairs_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(k, w := rnd.uniform(-170, 150), s := rnd.uniform(-80, 60), w + rnd.choice([0, 0.001, 1, 20]), s + rnd.choice([0, 0.001, 1, 20])) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, w double, s double, e double, n double")
    got = {(r.a_id, r.b_id) for r in index.box_pairs(df, df).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]}
    assert got == want
    assert index.box_pairs(df, df).count() == len(want)


def test_running_values_of_one_crowded_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id", (F.col("id") * 37 % 101).alias("v"))
    got = ordering.running(df, ["k"], ["id"], {"total": F.col("v")}, {"top": F.col("v")}).collect()
    sums, tops = {}, {}
    for r in sorted(got, key=lambda r: r.id):
        sums[r.k] = sums.get(r.k, 0) + r.v
        tops[r.k] = max(tops.get(r.k, -1), r.v)
        assert (r.total, r.top) == (sums[r.k], tops[r.k])
    assert len(got) == 5000


def test_global_lead_and_position(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("a"), F.col("id").alias("b"))
    lead = {r.a: r.next_a for r in ordering.global_lead(df, ["a"], ["a"]).collect()}
    assert all(lead[k] == (k + 1 if k < 1999 else None) for k in range(2000))
    assert all(r.position == r.a + 1 for r in ordering.global_position(df, ["a"]).collect())


def test_first_set_wins_a_tie(spark):
    s = spark.sql("select * from values (2L,1L,0L,0L,5L,'b'),(1L,1L,0L,0L,5L,'a'),(3L,1L,0L,0L,4L,'c') t(set_id,z,x,y,size,path)")
    assert tilesets.merge_tile_sets(s).first().path == "a"
    assert tuple(tilesets.merge_counts(s).first()) == (3, 1, 2)


def test_gaps_stay_inside_their_column(spark):
    s = spark.sql("select * from values (0L,4L,1L,3L,5L,'a'),(0L,4L,1L,6L,5L,'b'),(0L,4L,3L,4L,5L,'c') t(set_id,z,x,y,size,path)")
    assert sorted(map(tuple, tilesets.column_gaps(s).collect())) == [(4, 1, 4), (4, 1, 5)]
    filled = {(r.x, r.y): (r.from_path, r.direction) for r in tilesets.fill_gaps(s).collect()}
    assert filled == {(1, 4): ("a", 3), (1, 5): ("b", 4)}
    wide = {(r.x, r.y) for r in tilesets.fill_gaps(s, fill_columns=True).collect()}
    assert {(2, 3), (2, 6)} <= wide


def test_source_pages_keep_everything(spark, inputs):
    src = index.tile_sources(inputs.footprints.select("file_id", "file_name", "w", "s", "e", "n"), 0, 3)
    pages = index.source_pages(src)
    assert pages.select(F.explode("source_files")).count() == src.count()
    assert pages.filter("page >= pow(4, 6 - z)").isEmpty()
    few = index.source_pages(src.filter("file_id % 5 = 0"))
    same = pages.select("z", "x", "y", "page", F.explode("source_files.file_name").alias("n")).join(
        few.select("z", "x", "y", F.col("page").alias("other"), F.explode("source_files.file_name").alias("n")), ["z", "x", "y", "n"])
    assert same.filter("page <> other").isEmpty() and not same.isEmpty()


def test_incremental_check_needs_its_tiles(spark):
    files = spark.sql("select explode(array('a', 'b')) as file_name")
    ix = spark.range(10).select(F.lit(3).alias("z"), F.col("id").alias("x"), F.lit(0).alias("y"))
    assert tilesets.incremental_check(files, files, ix, ix.filter("x < 7"), True, 90.0).first().reuse
    assert not tilesets.incremental_check(files, files, ix, ix.filter("x < 6"), True, 90.0).first().reuse
    assert not tilesets.incremental_check(files, files.limit(1), ix, ix, True, 90.0).first().reuse
    assert not tilesets.incremental_check(files, files, ix, ix, True, 40.0).first().reuse


def test_no_seams_after_reconciling(spark, inputs):
    c = rasters.reconcile_seams(inputs.tile_cells, 17)
    spread = c.groupBy((F.col("x") * 16 + F.col("col")).alias("gx"), (F.col("y") * 16 + F.col("row")).alias("gy")).agg((F.max("value") - F.min("value")).alias("d"))
    assert spread.agg(F.max("d")).first()[0] < 1e-9
    assert c.count() == inputs.tile_cells.count()


def test_pyramid_keeps_its_sums(spark, inputs):
    base = inputs.sparse_cells.select(F.lit(6).cast("bigint").alias("z"), F.floor(F.col("col") / 16).alias("x"), F.floor(F.col("row") / 16).alias("y"), (F.col("col") % 16).alias("col"), (F.col("row") % 16).alias("row"), "value")
    assert len({(r.t, r.n) for r in rasters.pyramid(base, 6, 0, 16).groupBy("z").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).collect()}) == 1


def test_equal_positions_keep_their_rows(spark):
    cells = spark.range(130 * 70).selectExpr("1L AS file_id", "id % 130 AS col", "id div 130 AS row", "CAST(id % 130 * 2 + id div 130 AS double) AS value").filter("col <> 100")
    one = spark.sql("select 1L file_id, 10.0D w, 20.0D n, 0.1D px, 130L cols, 70L rows")
    at = [(12.34, 18.77), (12.34, 18.77), (16.4, 13.6), (16.39, 16.38), (19.97, 15.0), (22.99, 13.01)]
    points = spark.createDataFrame(at, "lon double, lat double")
    near = rasters.sample_nearest(points, one, cells).collect()
    between = rasters.sample_bilinear(points, one, cells).collect()
    assert sorted((r.lon, r.lat) for r in near) == sorted((r.lon, r.lat) for r in between) == sorted(at)
    for r in between:
        x, y = (r.lon - 10.0) / 0.1, (20.0 - r.lat) / 0.1
        c, q = int(x), int(y)
        if 100 in (c, min(c + 1, 129)):
            assert r.value == (None if c == 100 else c * 2 + q)
        else:
            fx, fy = (x - c if c < 129 else 0), (y - q if q < 69 else 0)
            assert abs(r.value - (2 * (c + fx) + q + fy)) < 1e-6
    assert rasters.mosaic(points, one, cells).count() == len(at)
    tiles = spark.createDataFrame([(0, 0, 0, -90.0, 5.0)] * 2, "z long, x long, y long, lon double, lat double")
    assert rasters.sample_tile_bilinear(tiles, spark.range(9).selectExpr("0L z", "0L x", "0L y", "id % 3 AS col", "id div 3 AS row", "id * 1.0D AS value"), 3).count() == 2


def test_unknown_resampling(spark, inputs):
    with pytest.raises(ValueError):
        rasters.warp_tile(inputs.mesh_tiles, inputs.rasters, inputs.cells, 4, "sinc")


def test_gaps_on_deep_levels(spark):
    s = spark.createDataFrame([(0, 9, 5, 3, 1, "p"), (0, 9, 5, 6, 1, "p"), (0, 20, 1, 1, 1, "p"), (0, 20, 4, 1, 1, "p"), (0, 21, 0, 1, 1, "p")], "set_id long, z long, x long, y long, size long, path string")
    assert sorted(map(tuple, tilesets.column_gaps(s).collect())) == [(9, 5, 4), (9, 5, 5)]
    assert sorted(map(tuple, tilesets.row_gaps(s).collect())) == [(20, 2, 1), (20, 3, 1)]


def test_streams_read_folder_tables_and_count_late_repeats_once(spark, tmp_path):
    from tilewright.streaming import progress

    rows = [(k % 7, k % 3, f"2024-01-01 {k:02d}:00:00") for k in range(24)]
    for k, r in enumerate(rows):  # one file and so one batch per hour, each far beyond the watermark of the one before
        spark.createDataFrame([r], "task_id int, tiles int, ts string").selectExpr("task_id", "tiles", "CAST(ts AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "e.parquet"))
    events = progress.read_events(spark, str(tmp_path), "e.parquet", "task_id int, tiles int, ts timestamp", per_trigger=6)
    done = progress.dedup(events, ["task_id", "tiles"]).read()
    assert done.count() == done.select("task_id", "tiles").distinct().count() == len({r[:2] for r in rows})
    speed = progress.run_to_end(progress.speed(progress.read_events(spark, str(tmp_path), "e.parquet", "task_id int, tiles int, ts timestamp", per_trigger=6), "1 hour"), "update")
    assert progress.latest(spark, speed, ["start", "end"]).agg(F.sum("events")).first()[0] <= len(rows)


def test_refinement_tells_whether_it_settled(spark, inputs):
    tiles = inputs.mesh_tiles.limit(4)
    ext = spark.sql("select -180.0D w, -90.0D s, 180.0D e, 90.0D n")
    assert not refine.refine(refine.start(tiles), inputs.tile_cells, 17, ext, rounds=1)[1]
    t, settled = refine.refine(refine.start(tiles), inputs.tile_cells, 17, ext)
    assert settled and refine.flag(t, inputs.tile_cells, 17, ext, 4.0).isEmpty()


def test_no_crack_between_tiles(spark):
    from tilewright.operators import rtin

    rnd = random.Random(2)
    rows = [(9, x, y, [rnd.choice([-1, -1, 0, 1, 2, 3]) for _ in range(17 * 17)]) for x in (4, 5) for y in (7, 8)]
    got = {(r.x, r.y): r.levels for r in rtin.border_activation(spark.createDataFrame(rows, "z long, x long, y long, levels array<int>"), 17).collect()}
    for y in (7, 8):
        assert [got[4, y][k * 17 + 16] for k in range(17)] == [got[5, y][k * 17] for k in range(17)]
    for x in (4, 5):
        assert got[x, 7][16 * 17 :] == got[x, 8][:17]


def test_incomplete_heightmaps_come_back(spark):
    heights = spark.range(9 + 8).selectExpr("0L z", "id div 9 AS x", "0L y", "id % 3 AS col", "id % 9 div 3 AS row", "CAST(id AS int) AS stored")
    twice = heights.filter("x = 0").selectExpr("z", "2L x", "y", "IF(col = 2, 1, col) AS col", "row", "stored")
    got = {r.x: (r.content is not None, r.heights) for r in codecs.write_heightmap_tiles(heights.unionByName(twice), n=3).collect()}
    assert got == {0: (True, 9), 1: (False, 8), 2: (False, 6)}


def test_progress_of_a_hot_task(spark):
    from tilewright.operators import tasks

    e = spark.range(500).selectExpr("id AS event_id", "IF(id % 10 = 0, 'b', 'a') AS task_id", "timestamp_seconds(id * 10) AS ts", "id % 7 <> 0 AS ok", "2L AS tiles")
    got = {r.event_id: r for r in tasks.task_progress(e).collect()}
    done = {"a": 0, "b": 0}
    for k in range(500):
        t = "b" if k % 10 == 0 else "a"
        done[t] += 2 * (k % 7 != 0)
        assert got[k].processed == done[t] and got[k].total == (100 if t == "b" else 900)


def edge(p, q):
    """Undirected edge between two corners."""
    a, b = F.struct(F.col(p + "x").alias("x"), F.col(p + "y").alias("y")), F.struct(F.col(q + "x").alias("x"), F.col(q + "y").alias("y"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.struct("z", lo["x"].alias("x0"), lo["y"].alias("y0"), hi["x"].alias("x1"), hi["y"].alias("y1"))


@pytest.mark.parametrize("rounds", [2])
def test_refined_mesh_is_whole(spark, inputs, rounds):
    tiles = inputs.mesh_tiles
    ext = spark.sql("select -180.0D w, -90.0D s, 180.0D e, 90.0D n")
    t, _ = refine.refine(refine.start(tiles), inputs.tile_cells, 17, ext, rounds=rounds)
    assert t.count() > 2 * tiles.count()
    edges = t.select(F.explode(F.array(edge("a", "b"), edge("a", "c"), edge("b", "c"))).alias("e")).groupBy("e").count()
    assert edges.agg(F.max("count")).first()[0] == 2
    # an edge with one triangle lies on the outline of the tiles: nothing hangs inside
    inner = edges.filter("count = 1").select("e.*").withColumns({
        "vx": F.when(F.col("x0") == F.col("x1"), F.col("x0")), "vy": F.when(F.col("y0") == F.col("y1"), F.col("y0")),
    })
    assert inner.filter((F.col("vx").isNull() | (F.col("vx") % refine.STEPS != 0)) & (F.col("vy").isNull() | (F.col("vy") % refine.STEPS != 0))).count() == 0
    v, faces = refine.to_tables(t, inputs.tile_cells, 17)
    assert faces.count() == t.count()
    back = codecs.read_mesh_tiles(codecs.write_mesh_tiles(v, faces))
    assert codecs.mesh_triangles(back).count() == t.count()


def test_wrong_size_and_plain_contents(spark):
    body = bytes(65 * 65 * 2) + bytes([15, 0])
    s = spark.createDataFrame([(0, 0, 0, bytearray(body)), (0, 1, 0, bytearray(body[:-1])), (0, 2, 0, bytearray(gzip.compress(body)))], "z long, x long, y long, content binary")
    assert codecs.read_heightmap_tiles(s).count() == 1
    i = codecs.inflate(s)
    assert i.filter("inflated").count() == 1
    got = codecs.read_heightmap_tiles(i).orderBy("x").collect()
    assert [r.x for r in got] == [0, 2] and got[0].child_flags == 15


def test_listing_and_sinks(spark, inputs, tmp_path):
    os.makedirs(tmp_path / "a" / "b")
    for name in ("a/x.tif", "a/b/y.TIF", "a/z.png"):
        (tmp_path / name).write_bytes(b"123")
    files = listing.list_files(spark, str(tmp_path), recursive=True)
    assert {(r.folder, r.name, r.ext, r.size_bytes) for r in files.collect()} == {("a", "x", ".tif", 3), ("a/b", "y", ".TIF", 3), ("a", "z", ".png", 3)}
    assert [r.rel_path for r in listing.discover(files, ["a"]).collect()] == ["a/x.tif"]
    assert listing.discover(files, ["a"], ["*.tif", "*.TIF"], recursive=True).count() == 2
    out = str(tmp_path / "tiles")
    bad = spark.sql("select 0L set_id, 2L z, 9L x, 0L y, 1L size, 'p' path")
    assert sinks.write_tiles(inputs.tile_store.unionByName(bad), out).count() == bad.count()
    assert sinks.read_tiles(spark, out).filter("z = 2").count() == 0
    sinks.write_layer(tilesets.layer_json(inputs.tile_store.filter("set_id = 0")), str(tmp_path / "layer"))
    assert '"scheme":"tms"' in spark.read.text(str(tmp_path / "layer")).first()[0]
    f = index.extent_features(inputs.footprints.select("w", "s", "e", "n"), 0, 2)
    sinks.write_features(f, str(tmp_path / "features"))
    assert spark.read.text(str(tmp_path / "features")).count() == f.count()


def test_root_level_of_one_set(spark):
    t = spark.sql("select * from values (3L, 5L, 6L), (3L, 7L, 2L), (0L, 1L, 0L) t(z, x, y)")
    got = sorted(map(tuple, tilesets.available_ranges(t, root_level=True).collect()))
    assert got == [(0, 0, 1, 0, 0), (3, 5, 7, 2, 6)]
