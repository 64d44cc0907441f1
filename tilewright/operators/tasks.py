"""Tasks, runs, workspaces and catalogue records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import text
from tilewright.session import cut_lineage

from .ordering import CHUNK, running

BASE_RATE = 25.0  # fixed value: tiles per second improvement is measured against


def batch_result(events: DataFrame) -> DataFrame:
    """Processed and failed tiles, duration, speed and success rate per task.

    ``events`` has task_id, ts (timestamp), ok (boolean) and tiles (integer).
    """
    g = events.groupBy("task_id").agg(
        F.sum(F.when(F.col("ok"), F.col("tiles")).otherwise(0)).alias("processed"),
        F.sum(F.when(~F.col("ok"), F.col("tiles")).otherwise(0)).alias("failed"),
        F.max("tiles").alias("largest_batch"),
        (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))).alias("micros"),
    )
    seconds = F.col("micros") / 1e6
    speed = F.coalesce(F.try_divide(F.col("processed"), seconds), F.lit(0.0))
    return g.select(
        "task_id", "processed", "failed", "largest_batch", seconds.alias("seconds"), speed.alias("speed"),
        (speed / BASE_RATE).alias("improvement"),
        F.coalesce(F.try_divide(F.col("processed") * 100.0, F.col("processed") + F.col("failed")), F.lit(0.0)).alias("success_rate"),
    )


def task_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("tasks"))


def recent_tasks(tasks: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest tasks by the time in their id; each task of the job keeps ``n`` rows."""
    return tasks.withColumn("task_time", text.task_time("task_id")).orderBy(F.desc("task_time"), "task_id").limit(n)


def prune_tasks(tasks: DataFrame, keep: int = 100) -> DataFrame:
    """Tasks to drop when only the ``keep`` newest by start time stay.

    The border is found with a bounded top-n, and everything older is one filter away.
    """
    order = F.struct("start_time", "task_id")
    newest = tasks.select(order.alias("k")).orderBy(F.desc("k")).limit(keep)
    border = newest.agg(F.struct(F.count("*").alias("n"), F.min("k").alias("k"))).scalar()
    marked = tasks.withColumn("_b", border)
    return marked.filter((F.col("_b.n") == keep) & (order < F.col("_b.k"))).drop("_b")


def task_progress(events: DataFrame) -> DataFrame:
    """Running processed and failed tiles, speed since the start and its peak, per task.

    ``events`` has event_id, task_id, ts, ok and tiles. A single task may hold any share of the
    events: running values are taken over range partitions.
    """
    micros = F.unix_micros("ts")
    ok = F.col("ok")
    sums = {
        "processed": F.when(ok, F.col("tiles")).otherwise(0).cast("bigint"),
        "failed": F.when(~ok, F.col("tiles")).otherwise(0).cast("bigint"),
    }
    run = running(events, ["task_id"], ["ts", "event_id"], sums, totals_of={"total": F.col("tiles")}, least_of={"_start": micros})
    run = cut_lineage(run)  # read twice below
    elapsed = (F.unix_micros("ts") - F.col("_start")) / 1e6
    speed = F.when(elapsed > 0, F.col("processed") / elapsed).otherwise(0.0)
    run = run.withColumns({"elapsed": elapsed, "speed": speed}).drop("_start")
    peaked = running(run, ["task_id"], ["ts", "event_id"], {}, {"peak_speed": F.col("speed")})
    done = F.col("processed") + F.col("failed")
    return peaked.drop(CHUNK).withColumn("percent", F.coalesce(F.try_divide(done * 100.0, F.col("total")), F.lit(0.0)))


def eta(progress: DataFrame) -> DataFrame:
    """Seconds left at the average speed so far, null while nothing has been processed."""
    left = F.col("total") - F.col("processed") - F.col("failed")
    return progress.withColumns({"remaining": left, "eta_seconds": F.when(F.col("speed") > 0, left / F.col("speed"))})


def resolve_layer(workspace: DataFrame) -> DataFrame:
    """Spaces (type 2) beside their group (type 1)."""
    groups = workspace.filter("type = 1").select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    spaces = workspace.filter("type = 2").select("id", F.col("parent_id").alias("group_id"), F.col("name").alias("space_name"), "status")
    return spaces.join(groups, "group_id")


def enabled_layers(workspace: DataFrame, groups: DataFrame) -> DataFrame:
    """Spaces below the named groups (group_name) that are switched on."""
    return resolve_layer(workspace).filter("status = 1").join(groups.select("group_name"), "group_name", "left_semi")


def catalogue_records(records: DataFrame, workspace: DataFrame) -> DataFrame:
    """Map records with the status of their workspace, null when there is none."""
    layers = resolve_layer(workspace).select(
        F.col("group_name").alias("workspace_group"), F.col("space_name").alias("workspace"), "status"
    )
    return records.join(layers, ["workspace_group", "workspace"], "left")
