"""Reference systems there and back, and boxes around bent edges."""

import math

import pytest
from pyspark.sql import functions as F

from tilewright.operators import projections

AT = [(0.0, 0.0), (12.5, 48.25), (-179.99, -84.9), (180.0, 85.0), (45.0, -0.01), (-70.1, 66.6)]


@pytest.mark.parametrize("name", list(projections.SYSTEMS))
def test_there_and_back(spark, name):
    df = spark.createDataFrame(AT, "lon double, lat double")
    x, y = projections.projected("lon", "lat", "EPSG:4326", name)
    df = df.withColumns({"x": x, "y": y})
    lon, lat = projections.projected("x", "y", name, "EPSG:4326")
    for r in df.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(r.lon - r.lon2) < 1e-11 and abs(r.lat - r.lat2) < 1e-11
        if name == "EPSG:3395" and r.lat == 48.25:
            e, phi = math.sqrt(6.69437999014e-3), math.radians(48.25)
            want = 6378137.0 * math.log(math.tan(math.pi / 4 + phi / 2) * ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2))
            assert abs(r.y - want) < 1e-6


def test_mixed_extents(spark):
    boxes = [(k, "EPSG:4326", 10.0, 20.0, 11.0, 22.5) for k in range(3)]
    f = spark.createDataFrame(boxes, "file_id int, srs string, w double, s double, e double, n double")
    parts = []
    for k, name in enumerate(projections.SYSTEMS):
        box = projections.outline_box("w", "s", "e", "n", "EPSG:4326", name)
        parts.append(f.where(F.col("file_id") == k).select("file_id", F.lit(name).alias("srs"), *[box[c].alias(f"_{c}") for c in "wsen"]).toDF("file_id", "srs", "w", "s", "e", "n"))
    got = projections.in_degrees(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()
    assert {tuple(r) for r in got} == {tuple(b) for b in boxes}
    null = f.where("file_id = 0").withColumn("srs", F.lit(None).cast("string"))
    assert tuple(projections.in_degrees(null).first())[2:] == (10.0, 20.0, 11.0, 22.5)
    with pytest.raises(Exception, match="unknown reference system EPSG:1"):
        projections.in_degrees(f.withColumn("srs", F.lit("EPSG:1"))).collect()
    with pytest.raises(ValueError):
        projections.projected("w", "s", "EPSG:1", "EPSG:4326")


def test_corners_tell_between_cylindrical_systems(spark, monkeypatch):
    """The same boxes as from the whole outline, without looking at every part of every edge."""
    rows = [(-179.5, -84.0, 179.25, 84.75), (12.1, 48.3, 12.7, 48.9), (5.0, -3.0, 5.0, -3.0), (8.0, 9.0, 7.0, 4.0), (None, 1.0, 2.0, 3.0)]
    f = spark.createDataFrame(rows, "w double, s double, e double, n double")
    for source, target in (("EPSG:4326", "EPSG:3857"), ("EPSG:4326", "EPSG:3395"), ("EPSG:3857", "EPSG:4326"), ("EPSG:3395", "EPSG:4326")):
        got = f.select(*[v.alias(f"_{k}") for k, v in projections.outline_box("w", "s", "e", "n", source, target).items()])
        assert "transform" not in got._jdf.queryExecution().analyzed().toString()
        with monkeypatch.context() as m:
            m.setattr(projections, "CYLINDRICAL", set())
            want = f.select(*[v.alias(f"_{k}") for k, v in projections.outline_box("w", "s", "e", "n", source, target).items()])
        assert got.collect() == want.collect()
