"""Structured Streaming over task events and arriving footprints.

Functions on windows take a streaming (or batch) DataFrame of events with ``task_id, ts`` (timestamp) and more, and return the
transformed one, for :func:`run_to_end`; rows older than the watermark are dropped. The others run a stream to the end of
its input and keep what they know in tables (:mod:`.state`): any row counts, however late, and a repeated batch changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.operators import index, tilesets
from tilewright.session import checkpoint_dir, cut_lineage

from .state import SeenKeys, StateTable

LATENESS = "10 minutes"
STATUS_LIFE_SECONDS = 30 * 60  # fixed value: how long a layer's status is trusted


def read_events(spark: SparkSession, folder: str, name: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Stream of the Parquet table ``name`` in a folder, with a declared schema.

    A table is a folder of part files, which is read as it is; a single file is picked out of its folder.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def speed(events: DataFrame, size: str = "1 minute", slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Tiles per window, tumbling or sliding, and the rate per second."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", lateness).groupBy(w.alias("w")).agg(F.sum("tiles").alias("tiles"), F.count("*").alias("events"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tiles", "events", (F.col("tiles") / seconds).alias("per_second"))


def runs(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Bursts of activity per task, closed after a quiet gap."""
    g = events.withWatermark("ts", lateness).groupBy("task_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("events"), F.sum("tiles").alias("tiles"))
    return g.select("task_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "tiles")


# sinks ----------------------------------------------------------------------------------------

def _fresh(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def run_to_end(df: DataFrame, mode: str = "append", path: str | None = None) -> str:
    """Run a stream over all input there is into Parquet files; returns their folder.

    ``append`` uses the exactly-once file sink. ``update`` and ``complete`` write each batch under
    its number, see :func:`latest`; a repeated batch overwrites itself.
    """
    spark = df.sparkSession
    path = path or _fresh(spark, "stream")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", _fresh(spark, "progress")).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", path).start()
    else:
        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        q = writer.foreachBatch(save).start()
    q.awaitTermination()
    return path


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current state from written updates: the row of the last batch per key."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def for_each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], progress: str | None = None) -> None:
    """Hand every batch of a stream and its number to ``work``, to the end of the input. ``progress`` (a folder) lets a later run go on."""
    spark = df.sparkSession
    q = df.writeStream.option("checkpointLocation", progress or _fresh(spark, "progress")).trigger(availableNow=True).foreachBatch(work).start()
    q.awaitTermination()


def status(events: DataFrame, path: str | None = None, progress: str | None = None) -> StateTable:
    """Latest event of each task (of equal times that with the largest id), merged into a table batch by batch.

    Columns: task_id, ts, event_id, kind, tiles. Events may come in any order.
    """
    spark = events.sparkSession
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    names = ["task_id", "ts", "event_id", "kind", "tiles"]
    table = StateTable(spark, path or _fresh(spark, "status"), ", ".join(f"{k} {fields[k]}" for k in names), ["task_id"])

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("task_id").agg(F.max(F.struct(*names[1:])).alias("e")).select("task_id", "e.*")

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(cut_lineage(newest(batch)), number, newest)

    for_each_batch(events, merge, progress)
    return table


def dedup(events: DataFrame, keys: list[str], path: str | None = None, progress: str | None = None) -> StateTable:
    """Distinct ``keys`` of a stream, however far apart repeats lie.

    Stored keys are looked at only for rows that a Bloom filter of their bucket can't tell to be new.
    """
    spark = events.sparkSession
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    seen = SeenKeys(spark, path or _fresh(spark, "seen"), ", ".join(f"{k} {fields[k]}" for k in keys))
    for_each_batch(events, lambda batch, number: seen.unseen(batch, number, cut_lineage), progress)
    return seen.table


def statuses_at(asked: DataFrame, changes: DataFrame) -> DataFrame:
    """Status of a layer at a time (layer_id, at): that of its last change (layer_id, at, status) by then; null before the first.

    Both are put in one order per layer, so that a layer costs the sum of its rows, not their product.
    """
    both = asked.select("layer_id", "at", F.lit(1).alias("_asked"), F.lit(None).cast("int").alias("status")).unionByName(
        changes.select("layer_id", "at", F.lit(0).alias("_asked"), "status"))
    last = F.last("status", ignorenulls=True).over(Window.partitionBy("layer_id").orderBy("at", "_asked", "status").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("status", last).filter("_asked = 1").select("layer_id", "at", "status")


def enabled(lookups: DataFrame, changes: DataFrame, life: int = STATUS_LIFE_SECONDS, path: str | None = None, progress: str | None = None) -> str:
    """Status each lookup (layer_id, lookup_id, ts) sees when a layer's status is read once and trusted for ``life`` seconds.

    Time is cut into periods of ``life`` seconds; in each of them the status valid at its beginning is served. A batch
    asks once per layer and period, and lookups meet the answers on both, so that a layer asked for by everyone is
    spread over its periods and no state is kept. Layers without any change are unknown and left out; before a
    layer's first change its status is null. Returns the folder of layer_id, lookup_id, status.
    """
    spark = lookups.sparkSession
    path = path or _fresh(spark, "enabled")
    changes = changes.select("layer_id", F.unix_micros("changed_at").alias("at"), "status")
    period = life * 1_000_000

    def serve(batch: DataFrame, number: int) -> None:
        rows = batch.join(changes.select("layer_id").distinct(), "layer_id", "left_semi")
        rows = rows.withColumn("at", F.floor(F.unix_micros("ts") / F.lit(period)) * period)
        answers = statuses_at(rows.select("layer_id", "at").distinct(), changes)
        rows.join(answers, ["layer_id", "at"]).select("layer_id", "lookup_id", "status").write.mode("overwrite").parquet(f"{path}/batch={number}")

    for_each_batch(lookups, serve, progress)
    return path


def index_updates(footprints: DataFrame, zmin: int, zmax: int, path: str | None = None, progress: str | None = None) -> StateTable:
    """Tile index (z, x, y, source_count) of arriving footprints; one that comes again, in this batch or later, counts once.

    A batch indexes its new footprints and touches only the tiles below them. Of rows of one file_id any one counts.
    """
    spark = footprints.sparkSession
    path = path or _fresh(spark, "index")
    seen = SeenKeys(spark, f"{path}/files", f"file_id {footprints.schema['file_id'].dataType.simpleString()}")
    table = StateTable(spark, f"{path}/tiles", "z long, x long, y long, source_count long", ["z", "x", "y"])

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy("z", "x", "y").agg(F.sum("source_count").alias("source_count"))

    def extend(batch: DataFrame, number: int) -> None:
        new = seen.unseen(batch, number, cut_lineage)
        rows = batch.dropDuplicates(["file_id"]).join(new, "file_id", "left_semi")
        tiles = index.tile_index(index.tile_sources(rows, zmin, zmax)).select("z", "x", "y", F.col("source_count").cast("long").alias("source_count"))
        table.upsert(cut_lineage(tiles), number, total)

    for_each_batch(footprints, extend, progress)
    return table


def merged_index(table: StateTable, store: DataFrame) -> DataFrame:
    """The tile index as it is now, with whether each tile is still to be built."""
    rows = table.read()
    todo = tilesets.missing_tiles(rows, store).withColumn("missing", F.lit(True))
    return rows.join(todo, ["z", "x", "y"], "left").withColumn("missing", F.coalesce("missing", F.lit(False)))
