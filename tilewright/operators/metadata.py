"""Raster metadata from text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import text
from tilewright.functions._cols import col

RASTER_JSON = T.StructType([
    T.StructField("size", T.ArrayType(T.LongType())),
    T.StructField("geoTransform", T.ArrayType(T.DoubleType())),
    T.StructField("bands", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("noDataValue", T.DoubleType()),
    ]))),
    T.StructField("coordinateSystem", T.StructType([T.StructField("wkt", T.StringType())])),
])


def join_lines(lines: DataFrame) -> DataFrame:
    """One ``body`` per file from its metadata lines (a document of a few dozen lines each)."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda p: p["line"]), "\n").alias("body"))


def bounds_from_text(lines: DataFrame) -> DataFrame:
    """Extent per file from its corner lines: DMS for projected systems, decimals for geographic ones.

    Corner lines are reduced on the map side; only one row per file crosses the shuffle.
    """
    line = F.trim("line")
    projected = F.max(line.startswith("PROJCS["))

    def corner(kind: str, style: str, part: int):
        is_kind = line.startswith(kind)
        if style == "dms":
            half = F.split_part(F.split_part(line, F.lit(")"), F.lit(2)), F.lit(","), F.lit(part))
            value = text.dms_to_deg(half)
        else:
            value = F.regexp_extract(line, text.DECIMAL_PAIR, part).try_cast("double")
        return F.max(F.when(is_kind, value))

    aggs = [projected.alias("projected")]
    for name, kind, part in (("west", "Upper Left", 1), ("north", "Upper Left", 2), ("east", "Lower Right", 1), ("south", "Lower Right", 2)):
        aggs += [corner(kind, s, part).alias(f"{name}_{s}") for s in ("dms", "decimal")]
    g = lines.groupBy("file_id").agg(*aggs)
    for name in ("west", "north", "east", "south"):
        g = g.withColumn(name, F.when(F.col("projected"), F.col(f"{name}_dms")).otherwise(F.col(f"{name}_decimal")))
    width = F.col("east") - F.col("west")
    return g.select(
        "file_id", "west", "south", "east", "north",
        F.when(width < 0, width + 360.0).otherwise(width).alias("width_deg"),
        F.abs(F.col("north") - F.col("south")).alias("height_deg"),
    )


def footprints_from_json(docs: DataFrame, doc="doc") -> DataFrame:
    """Size, pixel size, band facts and extent from JSON metadata, read with a declared schema."""
    d = docs.withColumn("_m", F.from_json(col(doc), RASTER_JSON))
    gt, size = F.col("_m.geoTransform"), F.col("_m.size")
    x0, px, y0, py = gt[0], gt[1], gt[3], gt[5]
    x1, y1 = x0 + size[0] * px, y0 + size[1] * py
    return d.select(
        *[c for c in docs.columns if c != doc],
        size[0].alias("cols"), size[1].alias("rows"),
        F.abs(px).alias("px"), F.abs(py).alias("py"),
        F.size("_m.bands").alias("bands"),
        F.col("_m.bands")[0]["type"].alias("band_type"), F.col("_m.bands")[0]["noDataValue"].alias("nodata"),
        F.least(x0, x1).alias("w"), F.least(y0, y1).alias("s"),
        F.greatest(x0, x1).alias("e"), F.greatest(y0, y1).alias("n"),
        F.col("_m.coordinateSystem.wkt").alias("srs"),
    ).withColumns({"center_x": (F.col("w") + F.col("e")) / 2, "center_y": (F.col("s") + F.col("n")) / 2})


def footprints_from_text(lines: DataFrame) -> DataFrame:
    """Size, pixel size and extent from text metadata."""
    def pick(pattern, i, kind):
        got = F.regexp_extract("line", pattern, i).try_cast(kind)
        return F.max(got)

    facts = lines.groupBy("file_id").agg(
        pick(r"^Size is (\d+), (\d+)", 1, "bigint").alias("cols"),
        pick(r"^Size is (\d+), (\d+)", 2, "bigint").alias("rows"),
        pick(r"^Pixel Size = \((-?[\d.]+),", 1, "double").alias("px"),
    )
    return facts.join(bounds_from_text(lines), "file_id")
