"""Covers by whole subtrees: exact, as short as the outline, listed in bounded steps."""

import random

from pyspark.sql import functions as F

from tilewright.operators import covers, index

RANGES = "id long, z long, min_x long, max_x long, min_y long, max_y long"


def test_numbers_go_there_and_back(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(2**k), rnd.randrange(2**k)) for k in range(1, 31) for _ in range(20)]
    df = spark.createDataFrame(rows, "x long, y long").withColumn("n", covers.number_of("x", "y"))
    for r in df.select("n", F.col("x").alias("x0"), F.col("y").alias("y0")).withColumns(covers.tile_of("n")).collect():
        assert (r.x, r.y) == (r.x0, r.y0) and r.n == sum((r.x >> k & 1) << 2 * k | (r.y >> k & 1) << 2 * k + 1 for k in range(31))


def test_every_tile_once(spark):
    rnd = random.Random(3)
    rows = [(0, 0, 0, 0, 0, 0), (1, 3, 0, 7, 0, 7), (2, 5, 7, 7, 0, 31), (3, 5, 3, 4, 9, 9), (4, 4, 5, 4, 0, 3), (5, 7, 1, 126, 1, 126), (6, 7, 63, 64, 63, 64)]
    for k in range(7, 60):
        z = rnd.randrange(8)
        x, y = sorted(rnd.randrange(2**z) for _ in "ab"), sorted(rnd.randrange(2**z) for _ in "ab")
        rows.append((k, z, *x, *y))
    ranges = spark.createDataFrame(rows, RANGES)
    cover = covers.covers(ranges, 7)
    got = sorted((r.id, r.z, r.x, r.y) for r in covers.listed(cover, 7).collect())
    assert got == sorted((i, z, x, y) for i, z, x0, x1, y0, y1 in rows for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))
    short = {r.id: r["count"] for r in cover.groupBy("id").count().collect()}
    assert short[1] == short[0] == 1 and all(short[i] <= 4 * (x1 - x0 + y1 - y0 + 2) for i, _, x0, x1, y0, y1 in rows if i in short)


def test_a_world_raster_is_one_row_and_a_large_one_is_its_outline(spark):
    top = 2**18 - 1
    rows = [(0, 18, 0, top, 0, top), (1, 18, 1, top - 1, 1, top - 1), (2, 18, 5, 5, 0, top)]
    cover = covers.covers(spark.createDataFrame(rows, RANGES), 18)
    sums = {r.id: (r.n, r.tiles) for r in cover.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("last") - F.col("first") + 1).alias("tiles")).collect()}
    assert sums[0] == (1, 4**18) and sums[1][1] == (top - 1) ** 2 and sums[1][0] < 9 * 2**18 and sums[2] == (2**18, 2**18)


def test_runs_are_the_index(spark):
    rnd = random.Random(5)
    boxes = []
    for k in range(60):
        w, s = rnd.uniform(-170, 150), rnd.uniform(-80, 70)
        boxes.append((k, w, s, w + rnd.choice([0.0, 0.3, 20.0]), s + rnd.choice([0.0, 0.2, 10.0])))
    boxes += [(60, -180.0, -85.0, 180.0, 85.0), (61, 0.0, 0.0, 45.0, 10.0), (62, 0.0, 0.0, 45.0, 10.0)]
    f = spark.createDataFrame(boxes, "file_id long, w double, s double, e double, n double")
    want = {(r.z, r.x, r.y): r.source_count for r in index.tile_index(index.tile_sources(f, 0, 7)).collect()}
    runs = covers.index_runs(f, 0, 7)
    got = covers.listed(runs, 7).collect()
    assert len(got) == len(want) and {(r.z, r.x, r.y): r.source_count for r in got} == want
    for r in covers.run_stats(runs).collect():
        counts = [n for (z, _, _), n in want.items() if z == r.z]
        assert (r.tiles, r.sources, r.overlapped, r.most_sources) == (len(counts), sum(counts), sum(n > 1 for n in counts), max(counts))
    assert covers.index_runs(f.limit(0), 0, 3).count() == 0
