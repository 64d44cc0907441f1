"""Steps whose work or memory must not grow faster than the input."""

import random

import numpy as np
import pandas as pd

from tilewright import fixtures
from tilewright.operators import covers, groups, index, rtin


BOXES = [(1, 10.0, 10.0, 14.0, 13.0), (2, 10.0, 10.0, 14.0, 13.0), (3, 178.0, -5.0, -178.0, 0.0), (4, -20.0, 30.0, -20.0, 30.0)]
FILES = [
    (1, 11.0, 11.0, 11.5, 11.5), (2, 14.0, 13.0, 15.0, 14.0), (3, 9.0, 9.0, 10.0, 10.0), (4, 14.01, 10.0, 15.0, 11.0), (5, -179.5, -2.0, -179.0, -1.0),
    (6, 179.0, -1.0, 179.5, 1.0), (7, 176.0, -1.0, 177.9, 1.0), (8, -21.0, 29.0, -19.0, 31.0), (9, 11.0, 11.0, 11.5, 11.5), (10, 10.0, 10.0, 10.0, 10.0),
]


def test_catalogue_finds_covered_files_without_pairs(spark):
    box = spark.createDataFrame(BOXES, "box_id long, w double, s double, e double, n double")
    files = spark.createDataFrame([(*f, ".tif") for f in FILES], "file_id long, w double, s double, e double, n double, ext string")
    got = index.catalogue_filter(files, box, [".TIF"])
    assert got.columns == files.columns
    assert sorted(r.file_id for r in got.collect()) == [1, 2, 3, 5, 6, 8, 9, 10]
    plain = box.filter("w <= e").select("w", "s", "e", "n")
    sure = [tuple(r) for r in index._touching_covered(files.select("w", "s", "e", "n").distinct(), plain).collect()]
    assert (11.0, 11.0, 11.5, 11.5) in sure and (14.01, 10.0, 15.0, 11.0) not in sure
    assert len(sure) == len(set(sure))


def test_multiplied_tables_are_spread(spark, inputs, monkeypatch):
    assert inputs.meta_text.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fixtures, "SPREAD_ROWS", 100)
    rows = inputs.table("orders").count()
    assert inputs.footprints.rdd.getNumPartitions() == -(-rows // 100) > spark.sparkContext.defaultParallelism


def test_lattices_are_computed_in_slices():
    seen = []

    def step(part):
        seen.append(len(part))
        return np.stack(list(part)).reshape(len(part), 1, 2)

    values = pd.Series([np.array([k, -k]) for k in range(2 * rtin.SLICE + 1)])
    got = rtin._sliced(step, values)
    assert seen == [rtin.SLICE, rtin.SLICE, 1]
    assert [tuple(v) for v in got] == [(k, -k) for k in range(len(values))]
    assert len(rtin._sliced(step, values.iloc[:0])) == 0


def test_equal_boxes_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(index, "LIST", 3)
    compared = []
    plain = index.box_pairs
    monkeypatch.setattr(index, "box_pairs", lambda a, b: compared.append((a.count(), b.count())) or plain(a, b))
    cut = [(20 + k, 178.0, -5.0, -178.0, 0.0) for k in range(4)]
    around = [(40 + k, -180.0, -3.0, 180.0, -2.0) for k in range(7)]  # meets both halves
    box = spark.createDataFrame([*BOXES, *cut, BOXES[0]], "box_id long, w double, s double, e double, n double")
    files = spark.createDataFrame([*FILES, *around, FILES[0], around[0]], "file_id long, w double, s double, e double, n double")
    got = [tuple(r) for r in index.footprints_for_boxes(files, box).select("box_id", "file_id").collect()]
    want = set()
    for b, bw, bs, be, bn in [*BOXES, *cut]:
        for w, e in [(bw, be)] if bw <= be else [(bw, 180.0), (-180.0, be)]:
            want |= {(b, f[0]) for f in [*FILES, *around] if f[1] <= e and f[3] >= w and f[2] <= bn and f[4] >= bs}
    assert len(got) == len(set(got)) and set(got) == want
    assert compared == [(12, 6)]


FILE = "file_id long, srs string, px double, w double, s double, e double, n double"


def _plain_groups(files):
    """Smallest id of each group, by comparing all pairs."""
    group = {f[0]: f[0] for f in files}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in files:
        for b in files:
            limit = 2 * max(a[2], b[2])
            gap = max(0, a[3] - b[5], b[3] - a[5]), max(0, a[4] - b[6], b[4] - a[6])
            if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 0.001 and max(gap) <= limit:
                p, q = sorted((top(a[0]), top(b[0])))
                group[q] = p
    return {(k, top(k)) for k in group}


def test_groups_compare_only_what_is_outside_the_largest(spark, monkeypatch):
    compared = []
    plain = groups.box_pairs
    monkeypatch.setattr(groups, "box_pairs", lambda a, b, **on: compared.append((a.count(), b.count())) or plain(a, b, **on))
    crowd = [(10 + k, "A", 0.0105, 5 + k % 10 * 0.3, 5 + k // 10 * 0.3, 6.5 + k % 10 * 0.3, 6.5 + k // 10 * 0.3) for k in range(100)]
    files = [*crowd, (3, "A", 0.0105, 60.0, 60.0, 61.0, 61.0), (2, "A", 0.0105, 9.71, 9.0, 9.72, 9.01)]
    got = groups.connected_groups(spark.createDataFrame(files, FILE))
    assert {tuple(r) for r in got.collect()} == _plain_groups(files)
    assert len(compared) == 1 and compared[0][0] < len(files) // 4 and compared[0][1] == len(files)


def test_groups_equal_all_pairs(spark):
    rnd = random.Random(5)
    files = []
    for k in range(240):
        w, s, size = rnd.uniform(0, 9), rnd.uniform(0, 9), rnd.choice([0.02, 0.3, 1.0, 2.0])
        files.append((k, rnd.choice("AB"), rnd.choice([0.0104, 0.0109, 0.0112, 0.0205]), w, s, w + size * rnd.random(), s + size))
    # the largest groups of two adjacent bands touch
    files += [(900 + k, "C", 0.0109, 20.0, 20.0, 24.0, 24.0 + k) for k in range(3)] + [(800 + k, "C", 0.0111, 24.01, 20.0, 28.0, 24.0 + k) for k in range(3)]
    got = groups.connected_groups(spark.createDataFrame(files, FILE))
    assert {tuple(r) for r in got.collect()} == _plain_groups(files)


def test_equal_rectangles_are_covered_once(spark, monkeypatch):
    seen = []
    plain = covers.covers
    monkeypatch.setattr(covers, "covers", lambda r, deepest: seen.append(r.count()) or plain(r, deepest))
    files = [(10.0 + k * 1e-4, 10.0, 12.0, 12.0) for k in range(50)] + [(-40.0, -40.0, 40.0, 40.0)]
    boxes = spark.createDataFrame(files, "w double, s double, e double, n double")
    got = covers.listed(covers.index_runs(boxes, 0, 5), 5).select("z", "x", "y", "source_count")
    want = index.tile_index(index.tile_sources(boxes, 0, 5)).select("z", "x", "y", "source_count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(seen) == 1 and seen[0] <= 12


def test_features_need_names_only(spark):
    boxes = spark.createDataFrame([(k, f"f{k % 7}.tif", *FILES[k][1:]) for k in range(len(FILES))], "file_id long, file_name string, w double, s double, e double, n double")
    sources = index.tile_sources(boxes, 0, 7)
    slim = index.source_pages(sources, item=("file_name",))
    assert slim.schema["source_files"].dataType.elementType.names == ["file_name"]
    got = index.index_features(slim).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, index.index_features(index.source_pages(sources)).collect())) and got
