"""File listings: discovering rasters, file lists and catalogue pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import text

RASTER_NAME = r"(?i)\.tiff?$"
STORE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?"


def list_files(spark: SparkSession, root: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Names, folders and sizes below ``root``; file contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # Paths come back with the scheme (and host) of their store, whether or not ``root`` names it.
    base = F.lit(STORE + re.escape(re.sub(STORE, "", root).rstrip("/")) + "/")
    f = reader.load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    rel = F.regexp_replace("path", base, F.lit(""))
    name = F.substring_index(rel, "/", -1)
    return f.select(
        rel.alias("rel_path"), F.regexp_replace(rel, F.lit(r"/?[^/]*$"), F.lit("")).alias("folder"),
        F.regexp_replace(name, F.lit(r"\.[^.]*$"), F.lit("")).alias("name"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"), "size_bytes", "modified",
    )


def _glob(pattern: str) -> str:
    """Regular expression of a file name pattern with ``*``, ``?`` and ``[...]``."""
    out = re.escape(pattern).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return "^" + out.replace(r"\[", "[").replace(r"\]", "]") + "$"


def discover(listing: DataFrame, folders: list[str] | None = None, patterns: list[str] | None = None,
             recursive: bool = False) -> DataFrame:
    """Raster files in any of the folders whose name fits any pattern, each once.

    Without ``recursive`` only files directly in a folder count.
    """
    patterns = patterns or ["*.tif", "*.tiff"]
    full = F.concat("name", "ext")
    fits = F.lit(False)
    for p in patterns:
        fits = fits | full.rlike(_glob(p))
    found = listing.filter(full.rlike(RASTER_NAME) & fits)
    if folders:
        inside = F.lit(False)
        for folder in folders:
            inside = inside | (F.col("folder") == folder)
            if recursive:
                inside = inside | F.col("folder").startswith(folder.rstrip("/") + "/")
        found = found.filter(inside)
    elif not recursive:
        found = found.filter(F.col("folder") == "")
    return found.dropDuplicates(["rel_path"])


def file_list(lines: DataFrame, listing: DataFrame, folders: list[str], root: str) -> DataFrame:
    """Rasters named by the lines of a file list.

    Blank lines and ``#`` comments are dropped. An absolute path must lie below ``root``; a
    relative one is taken from the first folder that has it.
    """
    line = F.trim("line")
    kept = lines.select("line_no", line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    root = root.rstrip("/") + "/"
    absolute = F.col("line").startswith("/")
    order = F.explode(F.array(*[
        F.struct(F.lit(k).alias("ord"), F.lit(f + "/" if f else "").alias("prefix")) for k, f in enumerate(folders)
    ]))
    inside = kept.filter(absolute & F.col("line").startswith(root)).select(
        "line_no", F.substr(F.col("line"), F.lit(len(root) + 1)).alias("rel_path"), F.lit(0).alias("ord")
    )
    relative = kept.filter(~absolute).select("line_no", "line", order.alias("o")).select(
        "line_no", F.concat("o.prefix", "line").alias("rel_path"), F.col("o.ord").alias("ord")
    )
    rasters = listing.filter(F.col("ext").rlike(RASTER_NAME)).select("rel_path")
    hits = inside.unionByName(relative).join(rasters, "rel_path", "left_semi")
    first = hits.groupBy("line_no").agg(F.min_by("rel_path", "ord").alias("rel_path"))
    return first.groupBy("rel_path").agg(F.min("line_no").alias("line_no"))


def catalogue_listing(listing: DataFrame, folder: str = "") -> DataFrame:
    """Directories and files directly in a folder, by kind and name, with the parent folder."""
    inside = listing if not folder else listing.filter(
        (F.col("folder") == folder) | F.col("folder").startswith(folder + "/"))
    rest = F.substr(F.col("rel_path"), F.lit(len(folder) + 2 if folder else 1))
    head = F.substring_index(rest, "/", 1)
    parent = "/".join(folder.split("/")[:-1]) if folder else None
    tagged = inside.select(
        F.when(rest.contains("/"), "directory").otherwise("file").alias("type"), head.alias("name"), "size_bytes"
    )
    grouped = tagged.groupBy("type", "name").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))
    prefix = folder + "/" if folder else ""
    return grouped.select(
        "type", "name", F.concat(F.lit(prefix), "name").alias("path"), F.lit(parent).cast("string").alias("parent_path"),
        "files", "size_bytes", text.format_size("size_bytes").alias("size_text"),
    ).orderBy("type", "name")
