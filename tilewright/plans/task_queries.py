"""Queries over tasks, runs, workspaces and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions._cols import as_utc
from tilewright.operators import tasks
from tilewright.operators.ordering import global_position

from .grid_queries import r
from .registry import query


def events(i):
    return i.task_events.select(
        "event_id", "task_id", as_utc("ts").alias("ts"), (F.col("kind") != "failed").alias("ok"),
        F.round("tiles").cast("bigint").alias("tiles"),
    )


EVENTS_SQL = "ev as (select event_id, task_id, epoch_us(ts) as us, kind <> 'failed' as ok, cast(round(tiles) as bigint) as tiles from task_events)"


@query("a13_batch_result", f"""with {EVENTS_SQL},
g as (select task_id, cast(sum(case when ok then tiles else 0 end) as bigint) as processed, cast(sum(case when not ok then tiles else 0 end) as bigint) as failed,
      max(tiles) as largest_batch, (max(us) - min(us)) / 1e6 as seconds from ev group by task_id)
select task_id, processed, failed, largest_batch, round(seconds, 6) as seconds, round(coalesce(processed / nullif(seconds, 0), 0), 6) as speed,
       round(coalesce(processed / nullif(seconds, 0), 0) / 25, 6) as improvement, round(coalesce(processed * 100.0 / nullif(processed + failed, 0), 0), 6) as success_rate from g""")
def a13(i):
    b = tasks.batch_result(events(i))
    return b.withColumns({c: r(F.col(c)) for c in ("seconds", "speed", "improvement", "success_rate")})


@query("a14_task_counts", "select status, count(*) as tasks from tasks group by status")
def a14(i):
    return tasks.task_counts(i.tasks)


@query("s01_recent_tasks", """
select task_id, status, cast(substr(task_id, 8) as bigint) as task_time, centitiles from tasks order by task_time desc, task_id limit 50""")
def s01(i):
    return tasks.recent_tasks(i.tasks).select("task_id", "status", "task_time", "centitiles")


@query("s02_prune_tasks", """
select task_id, status from (select *, row_number() over (order by start_time desc, task_id desc) as k from tasks) q where k > 100""")
def s02(i):
    return tasks.prune_tasks(i.tasks).select("task_id", "status")


PROGRESS_SQL = f"""{EVENTS_SQL},
p as (select *, sum(case when ok then tiles else 0 end) over w as processed, sum(case when not ok then tiles else 0 end) over w as failed,
             (us - min(us) over (partition by task_id)) / 1e6 as elapsed, sum(tiles) over (partition by task_id) as total
      from ev window w as (partition by task_id order by us, event_id rows unbounded preceding)),
s as (select *, case when elapsed > 0 then processed / elapsed else 0 end as speed from p),
pk as (select *, max(speed) over (partition by task_id order by us, event_id rows unbounded preceding) as peak_speed from s)"""


@query("w09_task_progress", f"""with {PROGRESS_SQL}
select event_id, task_id, cast(processed as bigint) as processed, cast(failed as bigint) as failed, cast(total as bigint) as total,
       round(coalesce((processed + failed) * 100.0 / nullif(total, 0), 0), 4) as percent, round(speed, 6) as speed, round(peak_speed, 6) as peak_speed from pk""")
def w09(i):
    p = tasks.task_progress(events(i))
    return p.select("event_id", "task_id", "processed", "failed", "total", r(F.col("percent"), 4).alias("percent"), r(F.col("speed")).alias("speed"), r(F.col("peak_speed")).alias("peak_speed"))


@query("w10_eta", f"""with {PROGRESS_SQL}
select event_id, cast(total - processed - failed as bigint) as remaining, round(case when speed > 0 then (total - processed - failed) / speed end, 3) as eta_seconds from pk""")
def w10(i):
    return tasks.eta(tasks.task_progress(events(i))).select("event_id", "remaining", r(F.col("eta_seconds"), 3).alias("eta_seconds"))


@query("j13_resolve_layer", """
select s.id, g.id as group_id, g.name as group_name, s.name as space_name, s.status from workspace s join workspace g on s.parent_id = g.id where s.type = 2 and g.type = 1""")
def j13(i):
    return tasks.resolve_layer(i.workspace)


@query("f08_enabled_layers", """
select s.id, s.name as space_name from workspace s join workspace g on s.parent_id = g.id where s.type = 2 and g.type = 1 and s.status = 1 and g.name = (select max(name) from workspace where id = 'g5')""")
def f08(i):
    name = i.table("nation").filter("n_nationkey = 5").select(F.col("n_name").alias("group_name"))
    return tasks.enabled_layers(i.workspace, name).select("id", "space_name")


@query("j16_catalogue_records", """
select m.*, w.status from map_record m left join (select g.name as gn, s.name as sn, s.status from workspace s join workspace g on s.parent_id = g.id where s.type = 2) w
  on gn = workspace_group and sn = workspace""")
def j16(i):
    return tasks.catalogue_records(i.map_record, i.workspace)


@query("s04_traversal_order", """
select z, x, y, row_number() over (order by z desc, x, y) as position from (select distinct z, x, y from tile_store) q""")
def s04(i):
    distinct = i.tile_store.select("z", "x", "y").distinct().withColumn("down", -F.col("z"))
    return global_position(distinct, ["down", "x", "y"]).drop("down")
