"""State tables of streams: repeated batches, late rows, constant number of files, exact de-duplication."""

import datetime
import os
import pathlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilewright.operators import index
from tilewright.session import cut_lineage
from tilewright.streaming import progress, state


def total(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def test_upsert_is_idempotent_and_keeps_its_files_few(spark, tmp_path):
    t = state.StateTable(spark, str(tmp_path / "t"), "k long, n long", ["k"], buckets=4)
    assert t.read().count() == 0
    rnd, want, sizes = random.Random(1), Counter(), []
    for number in range(12):
        rows = [(rnd.choice([None, *range(40)]), rnd.randrange(9)) for _ in range(30)]
        for _ in range(2 if number % 3 == 0 else 1):  # every third batch runs twice
            t.upsert(total(spark.createDataFrame(rows, "k long, n long")), number, total)
        for k, n in rows:
            want[k] += n
        sizes.append(sum(1 for _ in (tmp_path / "t" / "rows").rglob("*.parquet")))
        assert {r.k: r.n for r in t.read().collect()} == dict(want)
    assert len(t.folders()) == 4 and max(sizes[2:]) <= 8  # those of the last two manifests
    assert len(list((tmp_path / "t" / "manifest").glob("[0-9]*"))) == 2


def test_a_batch_that_failed_half_way_is_made_up_for(spark, tmp_path):
    t = state.StateTable(spark, str(tmp_path / "t"), "k long, n long", ["k"], buckets=2)
    rows = spark.createDataFrame([(1, 1), (2, 5)], "k long, n long")
    t.upsert(rows, 0, total)
    t._write(rows, 1)  # rows are there, the manifest isn't
    assert {r.k: r.n for r in t.read().collect()} == {1: 1, 2: 5}
    t.upsert(rows, 1, total)
    assert {r.k: r.n for r in t.read().collect()} == {1: 2, 2: 10}


def test_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PARTS", 3)
    t = state.StateTable(spark, str(tmp_path / "t"), "k long", ["k"], buckets=1)
    for number in range(8):
        t.append(spark.createDataFrame([(number,)], "k long"), number)
        assert len(t.folders()) <= 3 and sorted(r.k for r in t.read().collect()) == list(range(number + 1))


def test_unseen_keys_are_exact(spark, tmp_path):
    seen = state.SeenKeys(spark, str(tmp_path / "s"), "a long, b string", buckets=3)
    rnd, known = random.Random(2), set()
    for number in range(7):
        rows = [(rnd.choice([None, *range(6000)]), rnd.choice(["x", "y", None])) for _ in range(800)]
        rows += rows[:50]
        df = spark.createDataFrame(rows, "a long, b string")
        for _ in range(1 + number % 2):
            got = [tuple(r) for r in seen.unseen(df, number, cut_lineage).collect()]
            assert len(got) == len(set(got)) and set(got) == set(rows) - known
        known |= set(rows)
        assert {tuple(r) for r in seen.table.read().collect()} == known
    bits = [(r.keys, 8 * len(r.bits)) for r in seen.filters.read().collect()]
    assert sum(n for n, _ in bits) == len(known) and all(size >= state.BITS_PER_KEY * n for n, size in bits)
    # strangers are nearly all told apart by the filters alone
    strangers = seen._hashed(spark.range(100_000, 103_000).selectExpr("id AS a", "'x' AS b"))
    assert seen._doubtful(strangers, 99).count() < 60
    assert seen._doubtful(seen._hashed(seen.table.read()), 99).count() == len(known)


def stream(spark, folder, batches, schema):
    """One file per batch; files are read in the order they were written."""
    known = set()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for path in set(pathlib.Path(folder).glob("*.parquet")) - known:
            os.utime(path, (time.time() - 1000 + k,) * 2)
            known.add(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_status_of_late_and_repeated_events(spark, tmp_path):
    schema = "task_id string, ts timestamp, event_id long, kind string, tiles long"
    def row(task, hour, event):
        return task, datetime.datetime(2024, 1, 1, hour), event, f"k{event}", event

    batches = [[row("a", 5, 1), row("b", 1, 2)], [row("a", 3, 3), row("b", 1, 4)], [row("a", 5, 1), row("c", 0, 5)]]
    events = stream(spark, str(tmp_path / "e"), batches, schema)
    t = progress.status(events, str(tmp_path / "t"), str(tmp_path / "p"))
    assert {r.task_id: r.event_id for r in t.read().collect()} == {"a": 1, "b": 4, "c": 5}
    # a later run goes on where this one ended
    spark.createDataFrame([row("a", 9, 6)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    t = progress.status(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), str(tmp_path / "t"), str(tmp_path / "p"))
    assert {r.task_id: r.event_id for r in t.read().collect()} == {"a": 6, "b": 4, "c": 5}


def test_index_counts_a_footprint_once(spark, tmp_path):
    schema = "file_id long, w double, s double, e double, n double"
    boxes = [(1, 0.5, 0.5, 1.0, 1.0), (2, 0.6, 0.6, 60.0, 50.0), (3, -10.0, -10.0, -9.0, -9.0)]
    events = stream(spark, str(tmp_path / "e"), [boxes[:2], [boxes[0], boxes[2], boxes[2]], boxes], schema)
    got = progress.merged_index(progress.index_updates(events, 0, 3), spark.createDataFrame([(0, 0, 0)], "z long, x long, y long"))
    want = index.tile_index(index.tile_sources(spark.createDataFrame(boxes, schema), 0, 3))
    assert {(r.z, r.x, r.y): r.source_count for r in got.collect()} == {(r.z, r.x, r.y): r.source_count for r in want.collect()}
    assert {(r.z, r.x, r.y) for r in got.filter("not missing").collect()} <= {(0, 0, 0)}


@pytest.mark.parametrize("life", [1, 1800])
def test_statuses_by_period(spark, tmp_path, life):
    rnd = random.Random(life)
    changes = [(rnd.choice("abc"), rnd.randrange(40_000)) for _ in range(60)]
    changes = [(layer, t, k % 2) for k, (layer, t) in enumerate(dict.fromkeys(changes))]
    asked = [(rnd.choice("aabcx"), k, rnd.randrange(40_000)) for k in range(400)]
    lookups = spark.createDataFrame(asked, "layer_id string, lookup_id long, s long")
    lookups.repartition(5).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("layer_id string, lookup_id long, s long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "e"))
    table = spark.createDataFrame(changes, "layer_id string, s long, status int").select("layer_id", F.timestamp_seconds("s").alias("changed_at"), "status")
    path = progress.enabled(events.select("layer_id", "lookup_id", F.timestamp_seconds("s").alias("ts")), table, life)
    got = {r.lookup_id: r.status for r in spark.read.parquet(path + "/batch=*").collect()}
    want = {}
    for layer, k, s in asked:
        known = [(t, status) for name, t, status in changes if name == layer and t <= s // life * life]
        if layer != "x":
            want[k] = max(known)[1] if known else None
    assert got == want
