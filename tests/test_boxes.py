"""Pairs of boxes where nearly all of them crowd into one place."""

import random

from pyspark.sql import functions as F

from tilewright.operators import index

BOX = "file_id long, w double, s double, e double, n double"


def city(count, seed, first=0):
    """Nine tenths of the boxes lie in a hundredth of a degree."""
    rnd = random.Random(seed)
    out = []
    for k in range(count):
        crowded = k % 10 > 0
        w, s = (10.001 + rnd.random() * 0.005, 50.001 + rnd.random() * 0.005) if crowded else (rnd.uniform(-170, 170), rnd.uniform(-80, 80))
        size = rnd.choice([0.0005, 0.001]) if crowded else rnd.choice([0.001, 1.0, 5.0])
        out.append((first + k, w, s, w + size, s + size))
    return out


def test_crowded_place(spark, monkeypatch):
    monkeypatch.setattr(index, "SPLIT_LEAST", 10)
    a, b = city(700, 1), city(500, 2, 10_000)
    pairs = index.box_pairs(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX))
    got = [(r.a_file_id, r.b_file_id) for r in pairs.select("a_file_id", "b_file_id").collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_parts_are_even(spark, monkeypatch):
    monkeypatch.setattr(index, "SPLIT_LEAST", 10)
    key = ["k"]
    a = spark.range(9000).selectExpr("IF(id % 10 > 0, 7L, id) AS k", "id AS a")
    b = spark.range(3000).selectExpr("IF(id % 10 > 0, 7L, id) AS k", "id AS b")
    ((x, y), _), on = index.split_crowded([(a, b), (b.limit(5), a)], key)
    assert on == ["k", "_ia", "_ib"]
    share = index.SPLITS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df, n in ((x, 9000), (y, 3000)):
        assert df.groupBy("k", "_ia", "_ib").count().agg(F.max("count")).first()[0] <= 1.5 * n / share
    assert x.join(y, ["k", "_ia", "_ib"]).count() == a.join(b, key).count()
    assert index.split_crowded([(a.limit(0), b)], key)[1] == key


def test_boxes_finer_than_all_others_are_not_filed_at_their_own_level(spark, monkeypatch):
    rnd = random.Random(3)
    small = [(k, w, s, w + 0.01, s + 0.01) for k in range(300) for w, s in [(rnd.uniform(10, 20), rnd.uniform(10, 20))]]
    large = [(k, w, s, w + 3.0, s + 2.0) for k in range(20) for w, s in [(rnd.uniform(8, 20), rnd.uniform(8, 20))]]
    filed, plain = [], index.split_crowded
    monkeypatch.setattr(index, "split_crowded", lambda joins, key: filed.append([(a.count(), b.count()) for a, b in joins]) or plain(joins, key))
    want = {(p[0], q[0]) for p in small for q in large if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    for a, b, turned in ((small, large, False), (large, small, True)):
        pairs = index.box_pairs(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)).select("a_file_id", "b_file_id").collect()
        assert sorted((r[1], r[0]) if turned else (r[0], r[1]) for r in pairs) == sorted(want)
    assert filed[0][0][0] == 0 and filed[1][1][1] == 0 and all(sum(map(sum, f)) > 0 for f in filed)
    assert index.box_pairs(spark.createDataFrame(small, BOX), spark.createDataFrame([], BOX)).count() == 0
