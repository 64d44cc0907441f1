"""Mixing of sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal size. Block i (from 0) of a source with share q / Q of the sequence is
released at slot floor(i Q / q) and due at ceil((i + 1) Q / q); in every slot the released block that is due first
is taken. That keeps every source within one block of its share at every point of the sequence. The pattern repeats
after Q slots, so one period is scheduled (the weights are whole parts of ``parts``), not the corpus.

When a source runs out, the others share its slots in proportion: the periods after that have a shorter pattern.
No document is dropped or repeated.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

PARTS = 1000  # weights are multiples of 1 / PARTS (raised for more than a tenth as many sources)
BLOCK_CHARS = 100_000
ALPHA = 0.7  # without given weights, a source weighs its characters to this power


def _blocks(docs: DataFrame, id_col: str, text_col: str, source_col: str, block_chars: int, seed: int) -> DataFrame:
    """id, source, size and block (from 0) of every row, in a seeded random order inside the source.

    Running sizes are added up per (source, bucket), so that no source is brought together; the sums of
    the buckets put these behind each other.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.length(c.text_of(text_col)).cast("long").alias("size"))
    order = F.xxhash64(F.lit(seed), "id", "size")
    rows = rows.withColumn("_order", order).withColumn("_bucket", F.pmod(F.col("_order"), F.lit(c.buckets(docs.sparkSession, 4))))
    key = ["source", "_bucket"]
    sums = rows.groupBy(*key).agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*key).orderBy("_order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = c.join(rows.withColumn("_to", F.sum("size").over(inside)), sums, key)
    at = F.col("_start") + F.col("_to") - F.col("size")  # characters of the source before this row
    return out.select("id", "source", "size", "_order", at.alias("_at"), F.floor(at / F.lit(block_chars)).cast("long").alias("block"))


def _weights(stats: DataFrame, weights: Mapping[str, float] | None, alpha: float) -> Column:
    if weights is None:
        return F.pow(F.greatest(F.col("chars"), F.lit(1)).cast("double"), F.lit(alpha))
    out = F.lit(None).cast("double")
    for k, w in weights.items():
        out = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def _pattern(classes: DataFrame) -> DataFrame:
    """Slots of one period for each class: class, j (place in ``active``), i (block in the period), slot.

    ``active``: structs (q, m) of the sources that still have blocks, q parts of the period, m <= q blocks.
    """
    period = "aggregate(active, 0L, (a, x) -> a + x.q)"
    # State: number taken of each source, and the order so far. Due dates are compared as (due, place).
    pick = f"""
        array_min(transform(filter(sequence(0, size(active) - 1),
            j -> s.taken[j] < active[j].q AND s.taken[j] * period <= t * active[j].q),
            j -> struct(((s.taken[j] + 1) * period + active[j].q - 1) div active[j].q AS due, j AS j))).j"""
    step = f"""
        transform(array({pick}), p -> named_struct(
            'taken', transform(s.taken, (n, j) -> IF(j = p, n + 1L, n)),
            'order', concat(s.order, array(named_struct('j', p, 'i', s.taken[p])))))[0]"""
    order = f"""
        aggregate(sequence(0L, period - 1),
            named_struct('taken', transform(active, x -> 0L), 'order', cast(array() AS array<struct<j: int, i: bigint>>)),
            (s, t) -> {step}).order"""
    slots = classes.withColumn("period", F.expr(period)).select("class", "active", F.posexplode(F.expr(order)).alias("slot", "_p"))
    slots = slots.select("class", F.col("_p.j").alias("j"), F.col("_p.i").alias("i"), "slot", F.expr("active[_p.j].m").alias("m"))
    # A source in its last period may have fewer blocks than slots: close the gaps.
    gapless = F.row_number().over(Window.partitionBy("class").orderBy("slot")) - 1
    return slots.where("i < m").select("class", "j", "i", gapless.cast("long").alias("slot"))


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, block_chars: int = BLOCK_CHARS, parts: int = PARTS,
    seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, source, size (characters), block, slot, place, parts, period.

    Reading blocks by ``slot`` (0, 1, ... without gaps) and rows by ``place`` inside a block follows the target
    weights to less than one block. ``parts`` of ``period`` is the source's share in this row's period.
    ``weights`` by source; sources it doesn't name, or of weight 0, come last (in the smallest share). Without
    it, a source weighs its characters to the power ``alpha``. A null source is a source; a null or empty text
    has size 0. A document lies in the block in which it begins, and one longer than a block spans several
    block numbers, of which the later ones hold no rows of their own. An empty table gives no rows.
    """
    rows = c.save(_blocks(docs, id_col, text_col, source_col, block_chars, seed), "blocks")
    stats = rows.groupBy("source").agg(F.sum("size").alias("chars"), (F.max("block") + 1).alias("n"))
    stats = stats.withColumn("w", _weights(stats, weights, alpha))
    whole = Window.partitionBy()
    parts_ = F.greatest(F.lit(parts), 10 * F.count(F.lit(1)).over(whole))
    q = F.greatest(F.lit(1), F.round(F.col("w") / F.greatest(F.sum("w").over(whole), F.lit(1e-300)) * parts_)).cast("long")
    place = F.row_number().over(Window.orderBy("source")) - 1
    stats = c.save(stats.select("source", "n", q.alias("q"), place.alias("place")).withColumn("ends", F.ceil(F.col("n") / F.col("q"))), "sources")

    # Periods are alike from one change (a source's last period, or the one after it) to the next.
    everything = stats.agg(F.sort_array(F.collect_list(F.struct("place", "q", "n", "source"))).alias("all"))
    change = stats.select(F.explode(F.array(F.lit(0).cast("long"), F.col("ends") - 1, F.col("ends"))).alias("first")).distinct()
    classes = change.withColumn("all", everything.scalar()).where(F.expr("exists(all, x -> x.n > first * x.q)"))
    classes = classes.withColumn("class", F.col("first")).withColumn("active", F.expr("""
        transform(filter(all, x -> x.n > first * x.q),
            x -> named_struct('q', x.q, 'm', least(x.q, x.n - first * x.q), 'source', x.source))"""))
    pattern = _pattern(classes.repartition("class")).join(classes.select("class", "active"), "class")
    pattern = c.save(pattern.select(
        "class", F.expr("active[j].source").alias("source"), "i", "slot", F.expr("active[j].q").alias("parts"),
        F.expr("aggregate(active, 0L, (a, x) -> a + x.q)").alias("period"),
    ), "pattern")

    firsts = pattern.agg(F.array_sort(F.collect_set("class")).alias("firsts"))
    out = c.lookup(rows, stats.select("source", "q"), ["source"], ["id", "size"])
    out = out.withColumn("all", everything.scalar()).withColumn("firsts", firsts.scalar())
    out = out.withColumn("_k", F.expr("block div q")).withColumn("class", F.expr("element_at(filter(firsts, x -> x <= _k), -1)"))
    out = out.withColumn("i", F.expr("block % q"))
    out = out.withColumn("_before", F.expr("aggregate(all, 0L, (a, x) -> a + least(x.n, _k * x.q))")).drop("all", "firsts")
    out = c.lookup(out, pattern, ["class", "source", "i"], ["id", "size"])
    return out.select("id", "source", "size", "block", (F.col("_before") + F.col("slot")).alias("slot"), F.col("_at").alias("place"), "parts", "period")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all of them with all their columns, in the order of :func:`mix` (across and inside
    the partitions, and so across and inside the files they are written to). Rows that agree in id, source and
    length stand together."""
    place = mix(docs, weights, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    key = ["id", "source", "size"]
    place = place.groupBy(*key).agg(F.min(F.struct("slot", "place")).alias("at"))
    rows = docs.select(
        F.struct(*[docs[k] for k in docs.columns]).alias("_row"), docs[id_col].alias("id"), docs[source_col].alias("source"),
        F.length(F.coalesce(docs[text_col], F.lit(""))).cast("long").alias("size"),
    )
    rows = c.join(rows, place, key).select("_row", "at.slot", "at.place", "id")
    return rows.repartitionByRange("slot", "place", "id").sortWithinPartitions("slot", "place", "id").select("_row.*")


def file_order(docs: DataFrame) -> dict[str, Column]:
    """Columns that put the rows of ``docs`` in the order of the files they are read from, such as those of :func:`mixed`:
    the number of the task that wrote the file, the number of its file and the row inside it. ``docs`` must come
    straight from Parquet files that Spark has written; else ``_metadata`` isn't found, or the cast fails."""
    name = F.col("_metadata.file_name")
    return {
        "_task": F.regexp_extract(name, r"^part-([0-9]+)", 1).cast("long"), "_file": F.regexp_extract(name, r"-c([0-9]+)\.", 1).cast("long"),
        "_row": F.col("_metadata.row_index"),
    }
