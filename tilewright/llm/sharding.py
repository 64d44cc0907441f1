"""Shards by a Feistel permutation of global row numbers.

Rows get global numbers 0 .. n-1; a keyed Feistel network, walked until it stays below n, permutes them. Row r at
position p goes to shard p mod k, slot p div k. Shard and slot of a row number, and the row number in any slot, can
be computed from (n, k, seed) alone, so a reader can find a row without an index; counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

ROUNDS = 6
NUMBER_BUCKETS = 4096  # row numbers run bucket by bucket, so they don't depend on the size of the cluster


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of 0 .. n-1 and its inverse."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        with np.errstate(over="ignore"):
            self.keys = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right + k) & mask)
        # The halves are swapped at the end, so that the same steps with the keys reversed undo it.
        return (right << half) | left

    def _walked(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._network(np.asarray(x, dtype=np.uint64), keys)
            over = np.flatnonzero(out >= self.n)
            while len(over):  # the domain is under four times n, and every walk ends where it began at the latest
                out[over] = self._network(out[over], keys)
                over = over[out[over] >= self.n]
        return out.astype(np.int64)

    def position(self, row: np.ndarray) -> np.ndarray:
        return self._walked(row, self.keys)

    def row(self, position: np.ndarray) -> np.ndarray:
        return self._walked(position, self.keys[::-1])


def numbered(rows: DataFrame, order: list[str | Column], deal: list[str]) -> DataFrame:
    """``rows`` with ``row_number`` 0 .. n-1: by a hash bucket of ``deal`` and by ``order`` inside it.

    Only the bucket counts (NUMBER_BUCKETS rows) are brought together.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*deal), F.lit(NUMBER_BUCKETS)).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    out = rows.withColumn("_inside", inside).join(F.broadcast(starts), "_bucket")
    return out.withColumn("row_number", F.col("_start") + F.col("_inside") - 1).drop("_bucket", "_start", "_inside")


def shard(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, row_number, position, shard, slot.

    ``size`` is the text's bytes plus 8, ``text_crc32`` its checksum; a null text has no bytes. Row numbers
    follow (id, checksum, size) inside hash buckets; rows equal in all three may swap places, which no column
    shows. Null ids are numbered like others. Shards beyond the number of rows stay empty. An empty table
    gives no rows.
    """
    raw = F.encode(c.text_of(text_col), "utf-8")
    rows = docs.select(F.col(id_col).alias("id"), (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = c.save(numbered(rows, ["id", "text_crc32", "size"], ["id", "text_crc32", "size"]), "numbers")
    return placed(rows, rows.count(), shards, seed)


def placed(rows: DataFrame, n: int, shards: int, seed: int = 0) -> DataFrame:
    """Position, shard and slot of rows that carry a ``row_number`` below n."""
    permutation = Permutation(n, seed)

    @F.pandas_udf("long")
    def position(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in numbers:
            yield pd.Series(permutation.position(x.to_numpy()))

    at = rows.withColumn("position", position("row_number"))
    return at.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.floor(F.col("position") / F.lit(shards)).cast("long"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet folders shard=0 .. with the rows of each in slot order."""
    place = shard(docs, shards, seed, id_col, text_col).select(
        F.col("id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot",
    )
    # Rows that repeat id and text are told apart by their place among each other.
    nth = F.row_number().over(Window.partitionBy("_id", "_crc").orderBy(F.lit(0)))
    rows = docs.select(F.struct(*[docs[k] for k in docs.columns]).alias("_row"), docs[id_col].alias("_id"), F.crc32(F.encode(F.coalesce(docs[text_col], F.lit("")), "utf-8")).alias("_crc"))
    rows = c.join(rows.withColumn("_nth", nth), place.withColumn("_nth", nth), ["_id", "_crc", "_nth"])
    rows.repartition("shard").sortWithinPartitions("shard", "slot").select("_row.*", "shard", "slot").write.partitionBy("shard").parquet(path)
