"""Writing tile sets, indexes and layer descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import predicates, text


def checked_tiles(tiles: DataFrame, grid: str = "xyz") -> tuple[DataFrame, DataFrame]:
    """Tiles with a key inside their level, and the others."""
    ok = F.coalesce(predicates.valid_tile("z", "x", "y", grid), F.lit(False))
    return tiles.filter(ok), tiles.filter(~ok)


def write_tiles(tiles: DataFrame, path: str, grid: str = "xyz", partitions: int | None = None) -> DataFrame:
    """Write the valid tiles as Parquet, one folder per zoom; returns the others.

    Rows are range-partitioned on (z, x, y): a zoom level with most of the tiles is spread over
    many tasks and files, small levels share one, and each file covers a narrow range of x.
    """
    valid, rejected = checked_tiles(tiles, grid)
    n = partitions or int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = valid.repartitionByRange(n, "z", "x", "y").sortWithinPartitions("z", "x", "y")
    ordered.write.mode("overwrite").partitionBy("z").parquet(path)
    return rejected


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """A written tile set; filters on z prune folders, filters on x prune row groups."""
    return spark.read.parquet(path).withColumn("z", F.col("z").cast("bigint"))


def write_features(features: DataFrame, path: str, by: str | None = "z") -> None:
    """GeoJSON features, one per line; one folder per value of ``by``."""
    keep = [F.col("feature").alias("value")] + ([by] if by else [])
    writer = features.select(*keep).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def write_layer(layer: DataFrame, path: str) -> None:
    """The one row of a layer description as a text file."""
    layer.select(F.col("layer").alias("value")).coalesce(1).write.mode("overwrite").text(path)
