"""Streams over the given events and orders, run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilewright.functions._cols import as_utc
from tilewright.session import checkpoint_dir
from tilewright.streaming import progress

from .registry import query
from .tileset_queries import INDEX_SQL

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def events(i, source=None):
    """Task events as a stream, built from the events table like the batch input of the same name."""
    e = source or progress.read_events(i.spark, i.sf_dir, "events.parquet", EVENTS)
    kind = (
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "started")
        .when(F.col("event_type") == "purchase", "completed").otherwise("processed")
    )
    return e.select(
        "event_id", F.concat(F.lit("terrain"), (F.col("user_id") + 1700000000).cast("string")).alias("task_id"),
        as_utc("ts").alias("ts"), kind.alias("kind"), F.round("value").cast("bigint").alias("tiles"),
    )


def in_batches(i, name: str, schema: str, key: str, batches: int = 4):
    """A given table as a stream of several batches in which rows come late, and a tenth of them a second time in the last one."""
    folder = f"{checkpoint_dir(i.spark)}/batches-{uuid.uuid4().hex}"
    rows = i.table(name).select(*[f.split()[0] for f in schema.split(", ")])
    at = F.pmod(F.xxhash64(key), F.lit(batches))
    again = rows.where(F.pmod(F.xxhash64(F.lit(3), key), F.lit(10)) == 0).withColumn("_batch", F.lit(batches).cast("bigint"))
    rows.withColumn("_batch", at).unionByName(again).repartition(batches + 1, "_batch").write.partitionBy("_batch").parquet(folder)
    return i.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/_batch=*")


def seconds(c):
    return F.unix_timestamp(c)


EV = "ev as (select event_id, task_id, ts, kind, cast(round(tiles) as bigint) as tiles from task_events)"


@query("st01_stream_status", f"""with {EV}
select task_id, kind, epoch_us(ts) as us, tiles from (select *, row_number() over (partition by task_id order by ts desc, event_id desc) as k from ev) q where k = 1""")
def st01(i):
    s = progress.status(events(i, in_batches(i, "events", EVENTS, "event_id"))).read()
    return s.select("task_id", "kind", F.unix_micros("ts").alias("us"), "tiles")


@query("st02_stream_speed", f"""with {EV}
select cast(epoch_us(ts) // 60000000 * 60 as bigint) as start, cast(sum(tiles) as bigint) as tiles, count(*) as events, round(sum(tiles) / 60, 6) as per_second from ev group by 1""")
def st02(i):
    path = progress.run_to_end(progress.speed(events(i)), "update")
    s = progress.latest(i.spark, path, ["start", "end"])
    return s.select(seconds("start").alias("start"), "tiles", "events", F.round("per_second", 6).alias("per_second"))


@query("st03_stream_speed_sliding", f"""with {EV},
w as (select *, unnest([epoch_us(ts) // 300000000 * 300, epoch_us(ts) // 300000000 * 300 - 300, epoch_us(ts) // 300000000 * 300 - 600]) as s from ev)
select cast(s as bigint) as start, cast(sum(tiles) as bigint) as tiles, count(*) as events, round(sum(tiles) / 900, 6) as per_second from w group by 1""")
def st03(i):
    path = progress.run_to_end(progress.speed(events(i), "15 minutes", "5 minutes"), "update")
    s = progress.latest(i.spark, path, ["start", "end"])
    return s.select(seconds("start").alias("start"), "tiles", "events", F.round("per_second", 6).alias("per_second"))


@query("st04_stream_runs", f"""with {EV},
g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w >= 1800000000 then 1 else 0 end as cut from ev window w as (partition by task_id order by ts, event_id)),
s as (select *, sum(cut) over (partition by task_id order by ts, event_id rows unbounded preceding) as run from g),
r as (select task_id, run, min(epoch_us(ts)) as start, max(epoch_us(ts)) + 1800000000 as stop, count(*) as events, cast(sum(tiles) as bigint) as tiles from s group by task_id, run)
select task_id, start as start_us, stop as end_us, events, tiles from r where stop <= (select max(epoch_us(ts)) from ev) - 600000000""")
def st04(i):
    # append mode: a run is written once the watermark has passed its end
    path = progress.run_to_end(progress.runs(events(i)), "append")
    s = i.spark.read.schema("task_id string, start timestamp, end timestamp, events bigint, tiles bigint").parquet(path)
    return s.select("task_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", "tiles")


@query("st05_stream_footprints", f"""with {INDEX_SQL}
select z, x, y, source_count, not exists (select 1 from tile_store t where t.z = ti.z and t.x = ti.x and t.y = ti.y) as missing from ti""")
def st05(i):
    o = in_batches(i, "orders", "o_orderkey bigint", "o_orderkey")
    k = F.col("o_orderkey")
    fp = o.select(
        k.alias("file_id"), (((k * 7919) % 35700).cast("double") / 100.0 - 180.0).alias("w"), (((k * 104729) % 16700).cast("double") / 100.0 - 85.0).alias("s"),
        ((k * 31) % 200 + 1).alias("dx"), ((k * 17) % 200 + 1).alias("dy"),
    ).select("file_id", "w", "s", (F.col("w") + F.col("dx") / 100.0).alias("e"), (F.col("s") + F.col("dy") / 100.0).alias("n"))
    return progress.merged_index(progress.index_updates(fp, 0, 6), i.tile_store)


@query("st06_stream_dedup", f"with {EV} select distinct task_id, tiles from ev where kind = 'completed'")
def st06(i):
    done = events(i, in_batches(i, "events", EVENTS, "event_id")).filter("kind = 'completed'")
    return progress.dedup(done, ["task_id", "tiles"]).read()


@query("st07_stream_enabled", """
with q as (select 'w' || (user_id % 100) as layer_id, event_id as lookup_id, make_timestamp(epoch_us(ts) // 1800000000 * 1800000000) as at from events)
select distinct lookup_id, q.layer_id, c.status from q asof left join layer_changes c on q.layer_id = c.layer_id and q.at >= c.changed_at
where q.layer_id in (select layer_id from layer_changes)""")
def st07(i):
    lookups = in_batches(i, "events", EVENTS, "event_id").select(
        F.concat(F.lit("w"), (F.col("user_id") % 100).cast("string")).alias("layer_id"), F.col("event_id").alias("lookup_id"), as_utc("ts").alias("ts"))
    changes = i.layer_changes.withColumn("changed_at", as_utc("changed_at"))
    rows = i.spark.read.schema("layer_id string, lookup_id bigint, status int").parquet(progress.enabled(lookups, changes) + "/batch=*")
    return rows.distinct()  # the second coming of a lookup gets the same answer
