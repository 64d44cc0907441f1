"""Global order without a single task: look-ahead and running totals over range partitions.

A window without partition keys, or over one very large group, sorts everything in one task. Here
rows are range-partitioned on the full sort key instead, the window runs inside each partition, and
a summary of one row per partition (or per partition and key) carries values across the borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.session import cut_lineage

CHUNK = "_chunk"


def ordered_chunks(df: DataFrame, order: list[str], chunks: int | None = None) -> DataFrame:
    """Range-partition on ``order`` and number the partitions in that order.

    The result is written to the checkpoint folder, since range borders are sampled and two
    evaluations could otherwise disagree on them.
    """
    chunks = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(chunks, *order)
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id()))


def global_lead(df: DataFrame, order: list[str], columns: list[str], prefix: str = "next_") -> DataFrame:
    """Add the next row's ``columns`` in the overall order (null on the last row)."""
    c = ordered_chunks(df, order)
    picked = F.struct(*columns)
    inside = F.lead(picked).over(Window.partitionBy(CHUNK).orderBy(*order))
    # one row per range partition
    firsts = c.groupBy(CHUNK).agg(F.min_by(picked, F.struct(*order)).alias("_head"))
    following = firsts.select(
        CHUNK, F.lead("_head").over(Window.partitionBy(F.lit(0)).orderBy(CHUNK)).alias("_head")
    )
    joined = c.withColumn("_inside", inside).join(F.broadcast(following), CHUNK, "left")
    nxt = F.coalesce(F.col("_inside"), F.col("_head"))
    return joined.select(*df.columns, *[nxt[k].alias(prefix + k) for k in columns])


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], maxima: dict[str, Column] | None = None,
            totals_of: dict[str, Column] | None = None, least_of: dict[str, Column] | None = None) -> DataFrame:
    """Running sums and maxima per key in ``order``, however many rows one key has.

    ``totals_of`` and ``least_of`` add sums and minima over all rows of the key, carried by the same summaries.

    Each range partition keeps its own running values; what came before it is one row per key and
    partition, added by an equi-join on the keys the window is already partitioned by. Rows that
    already carry their chunk (the output of this function does) are not sorted again.
    """
    maxima, totals_of, least_of = maxima or {}, totals_of or {}, least_of or {}
    c = df.withColumns({**sums, **maxima})
    c = c if CHUNK in df.columns else ordered_chunks(c, [*keys, *order])
    part = [*keys, CHUNK]
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    totals = c.groupBy(*part).agg(
        *[F.sum(k).alias(k) for k in sums], *[F.max(k).alias(k) for k in maxima],
        *[F.sum(v).alias(k) for k, v in totals_of.items()], *[F.min(v).alias(k) for k, v in least_of.items()],
    )
    carried = totals.select(
        *part, *[F.sum(k).over(before).alias(f"_b_{k}") for k in sums], *[F.max(k).over(before).alias(f"_b_{k}") for k in maxima],
        *[F.sum(k).over(every).alias(k) for k in totals_of], *[F.min(k).over(every).alias(k) for k in least_of],
    )
    out = c.withColumns({
        **{f"_l_{k}": F.sum(k).over(local) for k in sums}, **{f"_l_{k}": F.max(k).over(local) for k in maxima},
    }).join(carried, part)
    return out.select(
        *[k for k in c.columns if k not in sums and k not in maxima],
        *[(F.col(f"_l_{k}") + F.coalesce(F.col(f"_b_{k}"), F.lit(0))).alias(k) for k in sums],
        *[F.greatest(f"_l_{k}", f"_b_{k}").alias(k) for k in maxima], *totals_of, *least_of,
    )


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Number the rows 1, 2, ... in the overall order."""
    c = ordered_chunks(df, order)
    counts = c.groupBy(CHUNK).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(CHUNK, F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))
    out = c.withColumn("_local", local).join(F.broadcast(offsets), CHUNK)
    return out.select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))
