"""Helpers shared by the corpus operators: saved tables, keyed statistics and lookups that survive hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"  # the white space that separates words
HOT = 1000  # a key is hot when it holds more than 1 / HOT of all rows, so there are fewer than HOT hot keys
SMALL_ROWS = 20_000  # lookups up to this many rows (and SMALL_BYTES) are broadcast
SMALL_BYTES = 16_000_000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def buckets(spark: SparkSession, factor: int = 1) -> int:
    """Number of buckets for work that is dealt out by a hash; follows the shuffle setting, which follows the data."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of the keys that holds between nulls, too. ``right`` has them as ``_r_<key>``."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_r_{k}"])
    return on


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in df.columns])


def join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped."""
    r = _renamed(right, keys)
    out = left.join(r, same(left, r, keys), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def attach(rows: DataFrame, keys: Sequence[str], total: int, **aggregates: Column) -> DataFrame:
    """``rows`` with aggregates over the rows of equal keys, without bringing a hot key's rows together.

    The aggregates are reduced map-side. Keys with more than 1 / HOT of ``total`` rows (fewer than HOT of
    them) come back by broadcast, which moves no row; all other keys come back by a join on the key.
    ``total`` must not be below the number of rows. Nulls are keys like any other.
    """
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[v.alias(k) for k, v in aggregates.items()])
    return routed(rows, found, keys, total)


def routed(rows: DataFrame, found: DataFrame, keys: Sequence[str], total: int, nulls: bool = True) -> DataFrame:
    """``rows`` joined to ``found`` (one row per key, ``_n`` rows of it), as in :func:`attach`.

    Without ``nulls`` in the keys the join is on the keys as they are, and a ``found`` that is already dealt by them
    isn't dealt again.
    """
    hot = found.where(F.col("_n") * HOT > total)
    cold = found.where(F.col("_n") * HOT <= total).drop("_n")
    few, hot = F.broadcast(hot.select(*keys)), F.broadcast(hot.drop("_n"))
    if nulls:
        return join(rows, hot, keys).unionByName(join(join(rows, few, keys, "left_anti"), cold, keys))
    keys = list(keys)
    return rows.join(hot, keys).unionByName(rows.join(few, keys, "left_anti").join(cold, keys))


def named(rows: DataFrame, keys: Sequence[str], total: int, name: str) -> DataFrame:
    """``rows`` with an integer name for their keys: equal keys, equal name; different keys, different names.

    The distinct keys are sorted inside the shuffle partition that owns them and numbered there. Names of
    hot keys are taken from a second reading of the same numbers, which adaptive execution may have cut into
    other partitions; they are negative, so they can't meet the others. Keys must not be null.
    """
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).sortWithinPartitions(*keys)
    found = found.withColumn(name, F.monotonically_increasing_id())
    hot = F.col("_n") * HOT > total
    found = found.withColumn(name, F.when(hot, -1 - F.col(name)).otherwise(F.col(name)))
    return routed(rows, found, keys, total, nulls=False)


def lookup(rows: DataFrame, small: DataFrame, keys: Sequence[str], salt_on: Sequence[str], size: Column | None = None) -> DataFrame:
    """``rows`` with the columns of ``small`` (one row per key; kept where there is none).

    ``small`` is counted and measured first (``size``: bytes of a row): within the bounds it is broadcast,
    beyond them both sides are salted, so that a hot key is spread over SALTS tasks.
    """
    size = F.lit(64) if size is None else size
    n, width = small.agg(F.count(F.lit(1)), F.sum(size)).first()
    if n <= SMALL_ROWS and (width or 0) <= SMALL_BYTES:
        return join(rows, F.broadcast(small), keys, "left")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)).cast("int"))
    return join(out, salted, [*keys, "_salt"], "left").drop("_salt")
